"""License scans: ordered signature rules behind a keyword prefilter, as DataFrame expressions.

Text is lower-cased in A-Z and reduced to its words, joined by single
spaces; rules are regular expressions over that form, each with a label, a
keyword, a priority and a confidence. A document goes on to the rules of a
keyword only if the keyword stands in it, and only then is its text
normalised. Each detection is an interval of words. A detection is
suppressed if its interval lies inside that of a better one: better priority
first, then the longer interval, then the earlier rule. Per document this is
one sort and a running maximum of interval ends per priority, so a text with
thousands of license lines stays linear.

Priorities: 0 identifiers (SPDX tags), 1 full statements with a version,
2 statements, 3 names alone, 4 the base phrases. Base phrases are reported
apart and are never suppressed there.

Null and empty texts have no words and no detections; repeated rows (equal
id and text) give repeated results; rows with NULL id are documents of their
own text; other columns are not used.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeshift.llm.common import ascii_lower, let, stored

#: A run of these is a word of the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on the text as it stands (A-Z still to be lower-cased).
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the base rules (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, keyword, name (regular expression over normalised words), versions. The keyword stands in every text that the
#: name matches; alternatives without a common one are families of their own.
#: A version stands in normalised text as words: "2.0" is "2 0".
FAMILIES = [
    ("gpl", "gnu general public", r"gnu general public licen[sc]e", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e", ("2 1", "3")),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e", ("2",)),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2 1", "2", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", ("1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", r"(?:the )?mit licen[sc]e", ()),
    ("mit", "expat", r"(?:the )?expat licen[sc]e", ()),
    ("mit", "x11", r"(?:the )?x11 licen[sc]e", ()),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised )?bsd(?: style)? licen[sc]e", ()),
    ("bsd-2-clause", "clause bsd", r"(?:2 clause|two clause) bsd(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "clause bsd", r"(?:3 clause|three clause) bsd(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "bsd 2", r"bsd 2 clause(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause(?: licen[sc]e)?", ()),
    ("bsd-0-clause", "bsd", r"(?:0bsd|zero clause bsd)(?: licen[sc]e)?", ()),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", ("1 0",)),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[sc]e", ("1 0",)),
    ("ipl", "ibm public", r"ibm public licen[sc]e", ("1 0",)),
    ("eupl", "european union public", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 1", "1 2")),
    ("artistic", "artistic", r"(?:clarified )?artistic licen[sc]e", ("1 0", "2 0")),
    ("boost", "boost software", r"boost software licen[sc]e", ("1 0",)),
    ("boost", "bsl", r"bsl", ("1 0",)),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("python", "python software foundation", r"python software foundation licen[sc]e", ("2",)),
    ("php", "php", r"php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby", r"ruby licen[sc]e", ()),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "database licen", r"open (?:data commons )?(?:open )?database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1 0",)),
    ("pddl", "public domain dedication", r"public domain dedication(?: and)? licen[sc]e", ("1 0",)),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 1", "2 0", "2 1", "3 0")),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", ()),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)", ("1", "2")),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("curl", "curl", r"curl licen[sc]e", ()),
    ("bsl-business", "business source", r"business source licen[sc]e", ("1 1",)),
    ("sspl", "server side public", r"server side public licen[sc]e", ("1",)),
    ("elastic", "elastic", r"elastic licen[sc]e", ("1 0", "2 0")),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e condition)?", ("1 0",)),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0|public domain dedication)", ("1 0",)),
    ("cc-by", "cc by", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc", r"cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd", r"cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative commons", r"creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s", ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike",
     ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s",
     ("2 0", "2 5", "3 0", "4 0")),
]

#: label, keyword, sentence of a license's own text (regular expression), in priority order.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("gpl", "under the terms of the gnu", r"under the terms of the gnu general public licen[sc]e as published by"),
    ("lgpl", "under the terms of the gnu", r"under the terms of the gnu lesser general public licen[sc]e as published by"),
    ("agpl", "under the terms of the gnu", r"under the terms of the gnu affero general public licen[sc]e as published by"),
    ("mpl", "this source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "this software is provided as is", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to"),
    ("public-domain", "public domain", r"(?:is|are|released|placed|dedicated)(?: hereby)? (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary"),
    ("boost", "boost software", r"distributed under the boost software licen[sc]e"),
    ("ofl", "sil open font", r"this font software is licensed under the sil open font licen[sc]e"),
]

#: label, SPDX identifier.
SPDX = [
    ("0bsd", "0BSD"), ("afl", "AFL-3.0"), ("agpl", "AGPL-3.0"), ("agpl", "AGPL-3.0-only"),
    ("agpl", "AGPL-3.0-or-later"), ("apache", "Apache-1.1"), ("apache", "Apache-2.0"), ("artistic", "Artistic-2.0"),
    ("boost", "BSL-1.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"),
    ("bsl-business", "BUSL-1.1"), ("cc-by", "CC-BY-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("cc-by-nd", "CC-BY-ND-4.0"),
    ("cc-by-sa", "CC-BY-SA-4.0"), ("cc0", "CC0-1.0"), ("cddl", "CDDL-1.0"), ("cpl", "CPL-1.0"), ("edl", "EDL-1.0"),
    ("elastic", "Elastic-2.0"), ("epl", "EPL-1.0"), ("epl", "EPL-2.0"), ("eupl", "EUPL-1.2"),
    ("gfdl", "GFDL-1.3-only"), ("gpl", "GPL-2.0"), ("gpl", "GPL-2.0-only"), ("gpl", "GPL-2.0-or-later"),
    ("gpl", "GPL-3.0"), ("gpl", "GPL-3.0-only"), ("gpl", "GPL-3.0-or-later"), ("isc", "ISC"),
    ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-2.1-only"), ("lgpl", "LGPL-2.1-or-later"), ("lgpl", "LGPL-3.0"),
    ("lgpl", "LGPL-3.0-only"), ("lgpl", "LGPL-3.0-or-later"), ("mit", "MIT"), ("mit", "MIT-0"), ("mpl", "MPL-1.1"),
    ("mpl", "MPL-2.0"), ("ms-pl", "MS-PL"), ("ms-rl", "MS-RL"), ("mulan", "MulanPSL-2.0"), ("ncsa", "NCSA"),
    ("odbl", "ODbL-1.0"), ("ofl", "OFL-1.1"), ("osl", "OSL-3.0"), ("php", "PHP-3.01"), ("postgresql", "PostgreSQL"),
    ("python", "PSF-2.0"), ("sspl", "SSPL-1.0"), ("unlicense", "Unlicense"), ("wtfpl", "WTFPL"), ("zlib", "Zlib"),
]

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"


class Rule(NamedTuple):
    rule_id: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def signature_rules() -> list[Rule]:
    """All rules in order: identifiers, versions, statements, sentences, names, base phrases."""
    parts: list[tuple[str, str, str, int, float]] = []
    for label, name in SPDX:
        words = name.lower().replace("-", " ").replace(".", " ")
        parts.append((label, "spdx", rf"spdx licen[sc]e identifier {words}(?! only| or later)", 0, 1.0))
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            tail = r"(?: or (?:any )?later(?: version)?)?"
            parts.append((label, keyword, rf"(?:{GRANT})?{name}(?: international| unported)? (?:v|version )?{v}{tail}",
                          1, 0.95))
    for label, keyword, sentence in SENTENCES:
        parts.append((label, keyword, sentence, 1, 0.9))
    for label, keyword, name, _ in FAMILIES:
        parts.append((label, keyword, GRANT + name, 2, 0.85))
    for label, keyword, name, _ in FAMILIES:
        parts.append((label, keyword, name, 3, 0.6))
    for phrase, label in BASE.items():
        parts.append((label, phrase, phrase, 4, 0.5))
    return [Rule(i, label, key, f"(?<= )(?:{pattern})(?= )", prio, conf)
            for i, (label, key, pattern, prio, conf) in enumerate(parts)]


def normalised(text: Column) -> Column:
    """The words of ``text``, one space before and after each."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def anchors(rules: list[Rule]) -> list[str]:
    """Short strings of which the lower-cased text of any detection holds one, but for those of "cc by"."""
    def anchor(rule: Rule) -> str:
        must = rule.pattern[len("(?<= )(?:"): -len(")(?= )")]
        for group in (r"\(\?:[^()]*\)\?", r"\(\?:[^()]*\)"):  # optional parts, then alternatives
            while (rest := re.sub(group, " ", must)) != must:
                must = rest
        return "licen" if "licen" in must and "|" not in must else max(rule.keyword.split(" "), key=len)
    found = {anchor(r) for r in rules} - {"cc"}
    return sorted(a for a in found if not any(o != a and o in a for o in found))


def gate(text: Column, rules: list[Rule]) -> Column:
    """Whether ``text`` may hold a detection."""
    plain = F.array(*[F.lit(a) for a in anchors(rules)])
    return let(F.lower(text), lambda t: F.exists(plain, lambda a: F.contains(t, a))
               | t.rlike(f"cc{BETWEEN}by"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    kind = ("array<struct<rule_id:int,label:string,keyword:string,pattern:string,priority:int,confidence:double>>")
    rows = json.dumps([r._asdict() for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))


def pieces(text: Column, pattern: Column) -> Column:
    """``array<(gap, hit)>``: for each match of ``pattern`` in normalised ``text``, the words before and in it."""
    def words(s: Column) -> Column:  # spaces: each match and each gap holds those of its words
        return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.transform(pairs, lambda p: F.struct(words(p["gap"]).alias("gap"), words(p["hit"]).alias("hit")))


def detections(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Every rule's matches: ``(id, hash, rule_id, label, priority, confidence, first, last)``, none suppressed.

    Partitioned by document; rows equal in id and text are one document. The
    places of a rule's matches are running sums over its rows.
    """
    rules = signature_rules() if rules is None else rules
    spark: SparkSession = docs.sparkSession
    keywords = list(dict.fromkeys(r.keyword for r in rules))
    text = F.col(text_col).cast("string")
    gated = (docs.filter(gate(text, rules))
             .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), normalised(text).alias("norm")))
    # the keywords that stand in a document, then the rules of those
    present = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains("norm", k))
    keyed = gated.select("id", "hash", "norm", F.explode(present).alias("keyword"))
    # the rule table is a constant of this module
    rule = ["rule_id", "label", "priority", "confidence"]
    found = (keyed.join(F.broadcast(rule_table(spark, rules)), "keyword")
             .select("id", "hash", *rule, F.posexplode(pieces(F.col("norm"), F.col("pattern"))).alias("at", "p"))
             .select("id", "hash", *rule, "at", "p.gap", "p.hit"))
    found = found.repartition("id", "hash").dropDuplicates(["id", "hash", "rule_id", "at"])
    before = (Window.partitionBy("id", "hash", "rule_id").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("gap") + F.col("hit")).over(before)
    return found.select("id", "hash", *rule, (end - F.col("hit") - 1).alias("first"), (end - 1).alias("last"))


def resolve(found: DataFrame, levels: int = 5) -> DataFrame:
    """``found`` with ``kept``: false where the interval lies inside that of a better detection."""
    doc = Window.partitionBy("id", "hash")
    # before a detection come those that start earlier, and at one start the longer, then the better rule
    order = doc.orderBy("first", F.desc("last"), "priority", "rule_id")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    # a better rule may also start at the same word and end later or at the same word: the order puts it before,
    # unless priority is better and the interval equal, which the order settles too
    inside = [F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("last"))).over(above) >= F.col("last"),
                         F.lit(False)) for p in range(levels)]
    worse = reduce(lambda a, p: a | ((F.col("priority") == p) & inside[p]), range(levels), F.lit(False))
    return found.withColumn("kept", ~worse)


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: words, base phrases, labels and score."""
    rules = signature_rules() if rules is None else rules
    text = F.col(text_col).cast("string")
    found = resolve(detections(docs, rules, id_col, text_col))
    base = F.col("priority") == 4
    per_doc = (found.groupBy("id", "hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("kept"), F.col("confidence"))).alias("score"),
        F.count(F.when(F.col("kept"), 1)).alias("n_detections"))
        .withColumnsRenamed({"id": "f_id", "hash": "f_hash"}))
    per_doc = stored(per_doc, "licenses")
    thin = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
                       F.regexp_count(F.coalesce(text, F.lit("")), F.lit(RAW_WORD)).cast("long").alias("n_words"))
    joined = thin.join(per_doc, thin.id.eqNullSafe(per_doc.f_id) & (thin.hash == per_doc.f_hash), "left")
    return joined.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0).cast("long")).alias("n_detections"))
