"""The corpus pipeline, stage by stage against brute force."""
import collections

import pytest

import corpus_pipeline as cp
from lakeshift.llm import quality
from test_decontaminate import brute as brute_matches
from test_linededup import brute as brute_lines
from test_packing import brute_pieces, check_places
from test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        out.append((name, cp.stored(stage(spark, out[-1][1], SF), name)))
    return [(name, df, df.collect()) for name, df in out]


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages][1:] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    assert all(df.columns == stages[0][1].columns for _, df, _ in stages[:-1])


def test_quality_stage(spark, stages):
    trusted = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    want = {r.doc_id for r in quality.assess(stages[0][1], trusted).filter("kept").collect()}
    assert {r.doc_id for r in stages[1][2]} == want
    assert 0 < len(want) < len(stages[0][2])


def test_line_stage(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[1][2])
    texts, _ = brute_lines(docs, 50)
    assert {r.doc_id: r.text for r in stages[2][2]} == {d: t for (d, _), t in zip(docs, texts)}
    assert all(r.n_chars == len(r.text) for r in stages[2][2])


def test_near_duplicate_stage(stages):
    prints = sorted((r.doc_id, brute_print(r.text)) for r in stages[2][2])
    first = set(brute_components(prints, 2))
    assert {r.doc_id for r in stages[3][2]} == first


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_matches([(r.doc_id, r.text) for r in stages[3][2]], items)}
    assert {r.doc_id for r in stages[4][2]} == {r.doc_id for r in stages[3][2]} - leaks


def test_packing_stage(stages):
    want = collections.Counter(brute_pieces([(r.doc_id, r.text) for r in stages[4][2]]))
    rows = stages[5][2]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows, 2048)


def test_run_gives_the_same_pieces(spark, stages):
    got = collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, SF).collect())
    assert got == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in stages[5][2])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_and_odd_tables(spark, k):
    name, stage = cp.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2),
                                 (2, "word " * 4000, None, None, None, None)], schema)
    out = stage(spark, odd, SF)
    assert out.count() > 0 or name == "quality_rules"
    assert name == "best_fit_packing" or out.columns == odd.columns
