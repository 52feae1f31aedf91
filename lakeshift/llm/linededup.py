"""Line dedup: repeated runs of lines found by winnowing over line hashes.

A *window* is the shortest sequence of consecutive lines from a given line on
that has at least ``min_words`` words; lines without a word do not count. Each
line starts one, as far as the document goes.

1. **Winnow.** Each window selects its smallest line hash, the last one where
   it has several. Neighbouring windows mostly select the same line, so the
   selected positions are fewer than the lines. Equal windows select the same
   line wherever they stand: a passage of ``min_words`` words or more cannot
   be repeated without a repeated fingerprint.
2. **Join positions.** The table of positions has a row per selected line,
   with its fingerprint and the windows that selected it. Positions whose
   fingerprint stands nowhere else are dropped. The windows of the others are
   matched by fingerprint and 128 bits over their lines, in groups and never
   in pairs, so that a line which a third of the corpus shares costs one row
   per occurrence.
3. **Extend.** The windows around a position reach to the left as far as the
   passage goes, as each of its lines starts one. To the right a repeated
   window grows line by line while what follows its first line has fewer than
   ``min_words`` words (beyond, the next window takes over), and each longer
   run is matched in the same way, among repeated windows alone.
4. **Delete.** All lines of a run that occurs earlier in the corpus, in the
   order of (id, text hash, line number), are deleted. The first occurrence
   stays, and with it a run that overlaps it in the same document.

A passage is found by its whole lines: these must hold ``min_words`` words.
What repeats inside a line, or with fewer words in whole lines, stays.

Null text stays NULL; a document deleted as a whole keeps its row with an
empty text; rows equal in id and text are one document and get the same
result; lines without a word inside a deleted passage go with it. A long
document is one group of its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshift.llm.common import let, stored

WORD = r"[^\x20\x09-\x0D]+"


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash, line, words, h1, h2)`` for each line with a word, partitioned by document."""
    text = F.col(text_col).cast("string")
    lines = (docs.filter(text.isNotNull())
             .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"),
                     F.posexplode(F.split(text, "\n", -1)).alias("line", "s"))
             .select("id", "hash", "line", F.regexp_count("s", F.lit(WORD)).alias("words"),
                     F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"))
             .filter("words > 0"))
    # rows equal in id and text are one document; uses the partitioning by document
    return (lines.repartition("id", "hash").groupBy("id", "hash", "line")
            .agg(*[F.first(c).alias(c) for c in ("words", "h1", "h2")]))


def windows(lines: DataFrame, min_words: int = 50) -> DataFrame:
    """``(id, hash, first, last, at, print, k1, k2, more)``: the window that starts at each line.

    ``at`` is the line it selects and ``print`` that line's hash; ``k1``,
    ``k2`` hash all its lines; ``more`` has the lines by which it may grow.
    """
    doc = Window.partitionBy("id", "hash").orderBy("line")
    placed = (lines.withColumn("after", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("before", F.col("after") - F.col("words")))
    over = Window.partitionBy("id", "hash").orderBy("before").rangeBetween(0, min_words - 1)
    beyond = Window.partitionBy("id", "hash").orderBy("after").rangeBetween(0, min_words - 1)
    low = F.min(F.struct("h1", (-F.col("line")).alias("up"))).over(over)
    found = placed.select(
        "id", "hash", F.col("line").alias("first"), F.max("line").over(over).alias("last"),
        F.sum("words").over(over).alias("n"), low.alias("low"), F.collect_list("h1").over(over).alias("l1"),
        F.collect_list("h2").over(over).alias("l2"),
        F.collect_list(F.struct("line", "h1", "h2")).over(beyond).alias("near")).filter(F.col("n") >= min_words)
    return found.select("id", "hash", "first", "last", (-F.col("low.up")).alias("at"), F.col("low.h1").alias("print"),
                        F.xxhash64("l1").alias("k1"), F.xxhash64("l2").alias("k2"),
                        F.filter("near", lambda x: x["line"] > F.col("last")).alias("more"))


def positions(found: DataFrame) -> DataFrame:
    """``(id, hash, at, print, windows)``: the selected lines; uses the partitioning by document."""
    window = F.struct("first", "last", "k1", "k2", "more")
    return found.groupBy("id", "hash", "at", "print").agg(F.collect_list(window).alias("windows"))


def earlier(runs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of ``runs (id, hash, first, last, key, ...)`` those whose key stands more than once, and of
    these those that occur earlier in the corpus."""
    start = F.struct("id", "hash", "first", "last")
    earliest = (runs.groupBy(*key).agg(F.min(start).alias("low"), F.max(start).alias("high"))
                .filter("low <> high").drop("high"))
    earliest = stored(earliest, "earliest")  # so that a hot run is split in the join
    several = runs.join(earliest, key)
    # a run that overlaps the first occurrence is part of what stays
    overlaps = (F.col("id").eqNullSafe(F.col("low.id")) & (F.col("hash") == F.col("low.hash"))
                & (F.col("first") <= F.col("low.last")))
    return several, several.filter(~overlaps).select("id", "hash", "first", "last")


def grown(several: DataFrame) -> DataFrame:
    """``(id, hash, first, last, k1, k2)``: repeated windows with one or more of the lines after them."""
    def key(own: str, name: str):
        return lambda x, i: F.xxhash64(F.col(own), F.transform(F.slice("more", 1, i + 1), lambda y: y[name]))

    longer = F.arrays_zip(F.transform("more", lambda x: x["line"]).alias("last"),
                          F.transform("more", key("k1", "h1")).alias("k1"),
                          F.transform("more", key("k2", "h2")).alias("k2"))
    return several.filter(F.size("more") > 0).select("id", "hash", "first", F.inline(longer))


def repeated(found: DataFrame) -> DataFrame:
    """``(id, hash, first, last)`` of the runs that occur earlier in the corpus; ``found`` are positions."""
    found = stored(found, "positions")
    # one row per print and task before the shuffle; stored, so that a hot print is split in the join
    seeds = stored(found.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "prints")
    matched = (found.join(seeds, "print", "left_semi")
               .select("id", "hash", "print", F.inline("windows")))
    several, later = earlier(stored(matched, "matched"), ["print", "k1", "k2"])
    _, extended = earlier(stored(grown(several), "grown"), ["k1", "k2"])
    return later.union(extended)


def disjoint(spans: DataFrame) -> DataFrame:
    """``(id, hash, first, last)``: the lines of ``spans``, each in one span only."""
    longest = spans.groupBy("id", "hash", "first").agg(F.max("last").alias("last"))
    before = Window.partitionBy("id", "hash").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("last").over(before), F.lit(-1))
    rest = longest.select("id", "hash", F.greatest("first", covered + 1).alias("first"), "last")
    return rest.filter("first <= last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text_col``, and ``n_lines``, ``n_cut`` beside it.

    Columns of those two names that ``docs`` already has are replaced.
    """
    later = repeated(positions(windows(line_table(docs, id_col, text_col), min_words)))
    cuts = (disjoint(later).groupBy("id", "hash").agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("cut"))
            .withColumnsRenamed({"id": "cut_id", "hash": "cut_hash"}))
    cuts = stored(cuts, "cuts")
    text = F.col(text_col).cast("string")
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("key_id"),
                        F.xxhash64(text).alias("key_hash"), text.alias("key_text"))
    same = inner.key_id.eqNullSafe(cuts.cut_id) & (inner.key_hash == cuts.cut_hash)
    joined = inner.join(cuts.hint("shuffle_hash"), same, "left")  # texts are shuffled, not sorted
    lines = F.split("key_text", "\n", -1)
    size = F.coalesce(F.size(lines), F.lit(0))
    rest = let(lines, lambda a: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("cut")), lambda i: F.get(a, i)), "\n"))
    return joined.select(
        *[F.when(F.col("cut").isNull(), F.col("key_text")).otherwise(rest).alias(c) if c == text_col
          else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_cut")],
        F.when(F.col("key_text").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_cut"))
