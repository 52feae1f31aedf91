"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshift.llm import (
    decontaminate, language, licenses, linededup, packing, pseudonyms, quality, resample, simhash, toxicity, trie,
    warc, wavelet,
)
from lakeshift.llm.common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled as good: the target of the quality rules."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives in segments and read back."""
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=16384, min_bytes=1000)
    found = warc.read_archives(spark, path)
    body = F.coalesce("payload", F.lit("").cast("binary"))
    revisit = F.col("record_type") == "revisit"
    return found.select(
        F.col("row_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length(body).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha1(body)).alias("payload_digest"), "record_type",
        "refers_to", (F.col("digest").eqNullSafe(F.sha1(body)) | revisit).alias("verified"), "error")


OP1_SQL = """
WITH pages AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
seen AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS latest FROM pages),
kinds AS (SELECT *, payload_bytes >= 1000 AND latest <> page_id AS again FROM seen)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN latest END AS refers_to, true AS verified, CAST(NULL AS VARCHAR) AS error
FROM kinds
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                         capacity=2048, end_id=0)
    return found.withColumnRenamed("id", "doc_id")


#: The key of the registered query. A real run takes it from a secret store.
DEMO_KEY = "lakeshift demonstration key"


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms of the same format."""
    found = pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    return found.select("doc_id", "n_pseudonyms", "kinds", "text")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to wavelet shards and read back."""
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  shared_path(spark, "wavelet"), end_id=0)
    return wavelet.read_shards(shards).withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words or more that occur earlier."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "n_lines", "n_cut", "text")


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line, parts[i] AS s,
         len(regexp_extract_all(parts[i], '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
placed AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS after
  FROM lines WHERE words > 0),
runs AS (
  SELECT doc_id, line AS first, max(line) OVER w AS last, list(s) OVER w AS k, sum(words) OVER w AS n
  FROM (SELECT *, after - words AS before FROM placed)
  WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(line) OVER w AS first, line AS last, list(s) OVER w AS k, sum(words) OVER w AS n
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
full_runs AS (
  SELECT *, min(struct_pack(d := doc_id, f := first, l := last)) OVER (PARTITION BY k) AS low FROM runs WHERE n >= 50),
cut AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM full_runs
  WHERE doc_id > low.d OR (doc_id = low.d AND first > low.l)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.line) AS n_cut,
         coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE c.line IS NULL), '') AS text
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.line = c.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_cut, 0) AS n_cut, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.assess(docs, trusted(spark, sf_dir))
    return found.select("doc_id", "rules.*", "kept", "llr")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))

    weights, bias = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, weights, bias).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), every=20, most=3)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the distribution of the benchmark texts."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10,
                              min_words=20, size=10_000, longest=1, seed=2024)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of UTF-8 text bit by bit, as DuckDB has no function for it.
SQL_CRC32 = """xor(4294967295, list_reduce(
  [4294967295] || list_transform(range(0, octet_length(encode({0}))),
                                 lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {SQL_CRC32.format("s")} % 4 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM turns)),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, role, text
  FROM (SELECT v.c, false AS own, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 20 AND t.pos <= v.h
        UNION ALL
        SELECT v.c, true, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h)),
paths AS (
  SELECT c, depth, text, string_agg(sha256(len(role) || ':' || role || text), '')
         OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k
  FROM rebuilt UNION ALL SELECT c, 0, '', '' FROM convs),
nodes AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved
  FROM paths GROUP BY k, depth),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes m WHERE m.depth = n.depth + 1
         AND left(m.k, len(n.k)) = n.k) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.k = left(n.k, len(n.k) - 64) AND n.depth > 0),
below AS (
  SELECT a.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, CAST(sum(x.saved) AS BIGINT) AS saved_tokens
  FROM counted x JOIN paths a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY a.k),
ended AS (
  SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM paths) WHERE depth = last GROUP BY k)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM counted JOIN below USING (k) LEFT JOIN ended USING (k)
"""

OP12_SQL = f"""
WITH texts AS (
  SELECT 0 AS part, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT part, id, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hashed AS (SELECT w, {SQL_CRC32.format("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words)),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE part = 0) AS s, count(*) FILTER (WHERE part = 1) AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000)::DOUBLE
                                      / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM counts, totals),
weights AS (
  SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE part = 0 GROUP BY id),
scored AS (
  SELECT t.id, t.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || coalesce(CAST(t.doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296))) AS BIGINT) AS score
  FROM texts t LEFT JOIN weights USING (id) WHERE part = 0),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (id)
"""


def op13_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labels outside the held-out fourth."""
    docs = table(spark, sf_dir, "documents")

    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))

    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    return language.predict(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {
    "op1_warc_roundtrip": op1_warc_roundtrip,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_subword_toxicity": op10_subword_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_output_codes": op13_output_codes,
}

#: DuckDB twins, where SQL can express the whole result.
ORACLE: dict[str, str] = {
    "op1_warc_roundtrip": OP1_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
