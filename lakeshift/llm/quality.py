"""Quality rules: text statistics and an n-gram likelihood ratio, all as DataFrame expressions.

The verdict compares two multinomials over hashed n-grams: one counted over
the documents of a trusted target, one over the whole raw corpus. Tokens are
runs of letters, digits and marks, or runs of other visible characters; the
features are each token and each token with its predecessor, hashed into a
fixed number of buckets. A document's score is the mean of
``ln p_target - ln p_raw`` over its n-grams, and every document is kept or
rejected by one fixed threshold on that mean.

Corpus counts shuffle one partial row per bucket and task; texts are shuffled
only where the trusted ids are too many to send to all tasks. The ratios, one
number per bucket (parameter ``buckets``), become a literal, and statistics,
score and verdict are computed inside each row.

Null text has no words and no lines; a document without n-grams scores 0; an
empty target gives every document 0, so that only the rules decide; repeated
rows are counted and judged each; NULL ids are never trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshift.llm.common import let, stored, words_of

#: Characters counted as symbols (fixed value).
SYMBOLS = "[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+"
WINDOW = 5
BUCKETS = 1 << 16
THRESHOLD = -0.5
#: Up to so many trusted ids are sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_IDS = 500_000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of ``words`` lie in a window of ``window`` words that the text has twice or more.

    Windows are compared by their 64-bit hash. Sorting (hash, position) puts
    equal windows side by side; only texts that have any pay for it.
    """
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            twin = F.filter(p, lambda s, j: (F.get(p, j - 1)["h"] == s["h"]) | (F.get(p, j + 1)["h"] == s["h"]))
            return F.array_sort(F.transform(twin, lambda s: s["i"]))

        def count(starts: Column) -> Column:
            reach = F.transform(starts, lambda s, j: F.least(F.lit(window),
                                                             F.coalesce(F.get(starts, j + 1) - s, F.lit(window))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, n: a + n)

        return let(placed, lambda p: let(repeats(p), count))

    def within(w: Column) -> Column:
        hashes = F.when(F.size(w) >= window, F.transform(
            F.sequence(F.lit(0), F.size(w) - window),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])))
        return let(F.coalesce(hashes, F.array().cast("array<long>")), lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(words, within)


def statistics(text: Column) -> Column:
    """Struct of the text statistics of one document."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    symbols = (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long")
    doubles = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(words.alias("words"), symbols.alias("n_symbols"), doubles.alias("n_dup_lines"))


def rules(docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """``docs`` with struct ``rules``: the statistics and ``base_failed``."""
    def judged(s: Column) -> Column:
        n, repeat = s["words"]["n_words"], s["words"]["n_repeat_words"]
        failed = (n < min_words) | (100 * repeat > max_repeat_pct * n)
        return F.struct(n.alias("n_words"), s["words"]["word_chars"].alias("word_chars"),
                        s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"),
                        repeat.alias("n_repeat_words"), failed.alias("base_failed"))

    return docs.withColumn("rules", let(statistics(F.col(text_col)), judged))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the tokens of ``text`` and of each token with the one before it ('' before the first)."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets).cast("long")).cast("int")

    return let(tokens, lambda t: F.concat(
        F.transform(t, lambda x: bucket(x)),
        F.transform(t, lambda x, i: bucket(F.coalesce(F.get(t, i - 1), F.lit("")), x))))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """``(bucket, llr)`` for every bucket that the corpus fills; ``trusted`` has the target's ids in ``id_col``.

    Every row of ``docs`` counts as raw, those with a trusted id as target too.
    """
    target = trusted.select(F.col(id_col).alias("t_id")).filter("t_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    how = "broadcast" if target.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else "shuffle_hash"
    marked = rows.join(target.withColumn("t", F.lit(1)).hint(how), rows.id == target.t_id, "left")
    grams = marked.select(F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"), "t")
    counts = stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("t").alias("target")), "ngrams")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total.target:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    space = smoothing * buckets

    def log_p(name: str) -> Column:
        return F.log((F.col(name) + smoothing) / F.lit(total[name] + space))
    return counts.select("bucket", (log_p("target") - log_p("raw")).alias("llr"))


def weights(model: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The ratio of every bucket, 0 for those that the corpus leaves empty; ``buckets`` numbers."""
    found = [0.0] * buckets
    for row in model.collect():
        found[row.bucket] = round(row.llr, 9)
    return found


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams of ``text``, looked up inside the row."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a literal

    def mean(grams: Column) -> Column:
        total = let(table, lambda m: F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(m, b)))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

    return let(ngram_buckets(text, len(ratios)), mean)


def assess(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with struct ``rules``, ``llr`` and ``kept``, which replace columns of those names."""
    ratios = weights(fit(docs, trusted, id_col, text_col, buckets), buckets)
    found = rules(docs.withColumn("llr", mean_ratio(F.col(text_col).cast("string"), ratios)), text_col)
    return found.withColumn("kept", ~F.col("rules.base_failed") & (F.col("llr") >= threshold))


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    own = F.struct(*docs.columns).alias("doc")
    packed = docs.select(own, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return assess(packed, trusted.select(F.col(id_col).alias("id")), "id", "text", **options).filter("kept").select(
        "doc.*")
