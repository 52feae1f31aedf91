"""Line dedup against brute force and its SQL twin."""
import random

from pyspark.sql import functions as F

from lakeshift.llm import linededup, queries

SF = "/root/testdata/sf0.001"


def brute(docs, min_words):
    """``docs``: list of (id, text) in corpus order; text without repeated runs."""
    rows = []
    for d, (_, text) in enumerate(docs):
        lines = text.split("\n")
        solid = [k for k, s in enumerate(lines) if s.split()]
        for a in range(len(solid)):
            words = 0
            for b in range(a, len(solid)):
                words += len(lines[solid[b]].split())
                if words >= min_words:
                    rows.append((tuple(lines[k] for k in solid[a:b + 1]), d, solid[a], solid[b]))
                    # every longer run is a union of minimal runs that start or end in it
                    break
        for b in range(len(solid)):
            words = 0
            for a in range(b, -1, -1):
                words += len(lines[solid[a]].split())
                if words >= min_words:
                    rows.append((tuple(lines[k] for k in solid[a:b + 1]), d, solid[a], solid[b]))
                    break
    first = {}
    for key, d, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(key, (d, b))
    cut = [set() for _ in docs]
    for key, d, a, b in rows:
        if (d, a) > first[key]:  # starts after the end of the first occurrence
            cut[d].update(range(a, b + 1))
    return ["\n".join(s for k, s in enumerate(t.split("\n")) if k not in cut[d]) for d, (_, t) in enumerate(docs)], cut


def test_query_matches_sql(spark, duck):
    got = {r.doc_id: tuple(r) for r in queries.op7_line_dedup(spark, SF).collect()}
    want = {r[0]: tuple(r) for r in duck(SF).sql(queries.OP7_SQL).fetchall()}
    assert got == want
    assert any(r[2] for r in got.values())


def test_random_documents_match_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))) for _ in range(8)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    frame = spark.createDataFrame([(i, t, 9, "c") for i, t in docs], "doc_id long, text string, n_cut int, cut string")
    want, cut = brute(docs, 8)
    got = {r.doc_id: r for r in linededup.dedup_lines(frame, min_words=8).collect()}
    assert [got[i].text for i, _ in docs] == want
    assert [got[i].n_cut for i, _ in docs] == [len(c) for c in cut]
    assert all(r["cut"] == "c" for r in got.values())


def test_positions_are_sparse_and_carry_the_windows(spark):
    """Neighbouring windows select the same line, and every window hangs on the position that it selected."""
    lines = linededup.line_table(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    found = linededup.windows(lines).cache()
    placed = linededup.positions(found).collect()
    assert len(placed) < 0.75 * found.count() and len(placed) < 0.75 * lines.count()
    assert sum(len(r.windows) for r in placed) == found.count()
    assert all(w.first <= r["at"] <= w.last for r in placed for w in r.windows)
    hashes = {(r.id, r.hash, r.line): r.h1 for r in lines.collect()}
    assert all(hashes[r.id, r.hash, r["at"]] == r.print for r in placed)


def test_matches_come_through_the_fingerprints(spark, monkeypatch):
    """Windows that select lines by anything but their content are not matched."""
    passage = "\n".join(f"line {k} of the passage has some words here" for k in range(9))
    docs = [(1, f"own\n{passage}"), (2, f"other one\nand two\n{passage}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sum(r.n_cut for r in linededup.dedup_lines(frame).collect()) == 9
    by_content = linededup.windows

    def by_place(lines, min_words):
        return by_content(lines, min_words).withColumn("print", F.xxhash64("id", "first"))
    monkeypatch.setattr(linededup, "windows", by_place)
    assert sum(r.n_cut for r in linededup.dedup_lines(frame).collect()) == 0


def test_growth_to_the_right(spark):
    """A short line after the last whole window is cut where any earlier text goes on with it."""
    base = "\n".join(" ".join(f"w{k}x{i}" for i in range(10)) for k in range(5))
    docs = [(1, base), (2, f"{base}\nshort end"), (3, f"{base}\nshort end\nmore"), (4, f"x\n{base}\nother end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    # no document before 2 has the end; without its first line, the passage of 3 has too few words to start anew
    assert got == {1: base, 2: "short end", 3: "more", 4: "x\nother end"}
    want, _ = brute(docs, 50)
    assert [got[i] for i, _ in docs] == want
    # a first line of 2 words: what follows it holds 50 words with the short end, so that the run starts anew there
    longer = "two words\n" + base
    docs = [(1, longer), (2, f"{longer}\nshort end"), (3, f"{longer}\nshort end\nmore"), (4, f"{base}\nshort end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    want, _ = brute(docs, 50)
    assert [got[i] for i, _ in docs] == want


def test_passage_of_several_lines_is_cut_whole(spark):
    passage = "\n".join(f"line {k} of the passage has some words here" for k in range(9)) + "\nshort end"
    docs = [(1, f"own start\n{passage}\nown end"), (2, f"other\n\n{passage}\n\nlast"), (3, passage), (4, "line 1"), (5, passage[:40])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    assert got == {1: docs[0][1], 2: "other\n\n\nlast", 3: "", 4: "line 1", 5: docs[4][1]}


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (None, long), (5, "x\n" * 30000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.dedup_lines(frame).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == "\n\n"
    # ids that are NULL come first, so theirs is the first occurrence; equal rows are one document
    assert by[None][0].text == long and [r.text for r in by[4]] == ["", ""]
    assert by[5][0].n_cut == 30000 - 50 and by[5][0].text.count("x") == 50


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
