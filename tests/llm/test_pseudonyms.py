"""Format-preserving pseudonyms."""
import re

from pyspark.sql import functions as F

from lakeshift.llm import pseudonyms, queries

SF = "/root/testdata/sf0.01"


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pseudonyms.pseudonymize(docs, key).collect(), key=lambda r: r.doc_id)]


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_formats_stay_and_values_link(spark):
    values = {"card": "4041894974608795", "phone": "(988) 555-2485", "email": "bosbt.42@mail8.example.com",
              "secret": "password=b7db7aa4a5fcc78305", "ssn": "123-45-6789"}
    rows = run(spark, [f"see {v} there" for v in values.values()] + [f"again: {v}." for v in values.values()])
    n = len(values)
    for k, (kind, v) in enumerate(values.items()):
        one, two = rows[k].text[4:-6], rows[n + k].text[7:-1]
        assert one == two != v and shape(one) == shape(v)
        assert rows[k].kinds == kind and rows[k].n_pseudonyms == 1
    assert luhn(rows[0].text)
    assert rows[2].text.endswith(".com there")


def test_another_key_gives_other_values(spark):
    text = "4041894974608795 and 42.144.35.254"
    assert run(spark, [text], "a")[0].text != run(spark, [text], "b")[0].text


def test_dates_and_addresses_stay_valid(spark):
    rows = run(spark, ["1984-02-29", "31/12/1999", "31.12.1999", "1999/12/31", "42.144.35.254"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", rows[0].text) and re.fullmatch(r"\d\d/\d\d/\d{4}", rows[1].text)
    d, m, y = rows[1].text.split("/")
    assert rows[2].text == f"{d}.{m}.{y}" and rows[3].text == f"{y}/{m}/{d}"
    assert all(0 <= int(x) <= 255 for x in rows[4].text.split("."))


def test_invalid_values_stay(spark):
    texts = ["31/13/1999", "1999-02-30", "300.1.1.1", "1234567890123456", "000-12-3456", "version 4.0", "", "x"]
    assert [r.text for r in run(spark, texts)] == texts
    assert all(r.n_pseudonyms == 0 for r in run(spark, texts))


def test_networks_are_permutations(spark):
    for n in (1, 2, 3, 4):
        total = 10 ** n
        digits = F.lpad(F.col("id").cast("string"), n, "0")
        got = spark.range(total).select(pseudonyms.permute_digits(digits, F.lit("t"), "k").alias("p"))
        assert got.distinct().count() == total and got.filter(f"length(p) <> {n}").count() == 0
    days = spark.range(146097).select(
        F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select(pseudonyms.date_pseudonym(F.col("d"), "k").alias("p")).filter("p is not null")
    assert made.distinct().count() == 146097
    words = spark.range(26 * 26 * 10).select(F.concat(
        F.char(97 + F.col("id") % 26), F.char(65 + F.floor(F.col("id") / 26) % 26),
        F.floor(F.col("id") / 676).cast("string")).alias("w"))
    got = words.select(pseudonyms.permute_alnum(F.col("w"), F.lit("t"), "k").alias("p"))
    assert got.distinct().count() == 6760 and got.filter("not p rlike '^[a-z][A-Z][0-9]$'").count() == 0


def test_query_leaves_nothing_planted(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    planted = re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com|\(\d{3}\) 555-\d{4}|\b4\d{15}\b|\bAKIA[A-Z0-9]{16}\b|password=[0-9a-f]{18}"
                         r"|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")
    hits = 0
    for r in queries.op5_feistel_pseudonyms(spark, SF).collect():
        found = planted.findall(texts[r.doc_id])
        hits += len(found)
        assert not any(v in r.text for v in found)
        if not r.n_pseudonyms:
            assert r.text == texts[r.doc_id]
    assert hits > 20


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (3, "mail a.b1@c.de " * 5000, 5, "x"), (3, "a", 5, "x")],
                                 "doc_id long, text string, n_pseudonyms int, _found string")
    rows = sorted(pseudonyms.pseudonymize(docs, "k").collect(), key=lambda r: (r.doc_id, len(r.text or "")))
    assert [r.n_pseudonyms for r in rows] == [0, 0, 0, 5000]
    assert rows[0].text is None and rows[1].text == ""
    assert pseudonyms.pseudonymize(docs.limit(0), "k").count() == 0


def test_neighbours_do_not_hide_values(spark):
    card, phone, date, ssn, address = "4111 1111 1111 1111", "555-123-4567", "2021-01-02", "123-45-6789", "42.144.35.254"
    other = "5500 0000 0000 0004"
    alone = dict(zip([card, "4111111111111111", other, phone, date, ssn, address],
                     (r.text for r in run(spark, [card, "4111111111111111", other, phone, date, ssn, address]))))
    cases = [("card {} 12/27", [card], 1), ("{} 123", ["4111111111111111"], 1), ("ssn {} 1234567", [ssn], 1),
             ("{} {}", [phone, date], 2), ("{} {}", [phone, phone], 2), ("{} {}", [ssn, ssn], 2), ("1234 {}", [ssn], 1),
             ("{} {}", [card, ssn], 2), ("{} {}", [card, address], 2), ("{} {}", [card, "4111111111111111"], 2),
             ("{} {}", [card, other], 2), ("12 34 {} 5", [card], 1), ("1 {} 12 {} 7", [card, other], 2)]
    got = run(spark, [form.format(*values) for form, values, _ in cases])
    assert [r.text for r in got] == [form.format(*[alone[v] for v in values]) for form, values, _ in cases]
    assert [r.n_pseudonyms for r in got] == [n for _, _, n in cases]
    long = run(spark, ["1 " * 3000 + "12345678901234567890 " + card])[0]
    assert long.text.endswith(alone[card])


def test_month_first_dates(spark):
    rows = [r.text for r in run(spark, ["1990-12-25", "12/25/1990", "12.25.1990", "25/12/1990", "05/06/1990", "1990-06-05"])]
    y, m, d = rows[0].split("-")
    assert rows[1:4] == [f"{m}/{d}/{y}", f"{m}.{d}.{y}", f"{d}/{m}/{y}"] and rows[0] != "1990-12-25"
    y, m, d = rows[5].split("-")
    assert rows[4] == f"{d}/{m}/{y}"
