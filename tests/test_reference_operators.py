import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text as tx
from tessera.operators import attribution as at
from tessera.operators import corpus as cp
from tessera.operators import language as lg
from tessera.operators import manifest as mf
from tessera.operators import mixture as mx
from tessera.operators import personal as pn
from tessera.operators import quality as ql
from tessera.plans import queries as plans
from tessera.sources import tables as tb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(plans.ORACLE_SQL[name])
    names = sorted(want.columns)
    expected = sorted((tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()), key=str)
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    found = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-6) for x, y in zip(a, b)), (a, b)


def test_cleaning(spark):
    raw = ["&amp;amp;lt;b&amp;gt; x​ y   z ", "éa", "a‌b‍c", "﻿\u0007 ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    once = rows.select("i", tx.clean_text(F.col("t")).alias("t"))
    got = {r["i"]: r["t"] for r in once.collect()}
    assert got == {0: "<b> x y z", 1: "éa", 2: "a‌b‍c", 3: "", 4: None}
    assert {r["i"]: r["t"] for r in once.select("i", tx.clean_text(F.col("t")).alias("t")).collect()} == got


def test_rule_breakers(spark):
    good = "the cat and the dog have to be of that house with a lamp. " + " ".join(f"Word{i} near the old mill{i}." for i in range(20))
    bad = {"word_count": "the and.", "symbol_to_word_ratio": good + " #" * 60, "ellipsis_lines": "the and of to " * 5 + "x... " * 60, "stop_words": " ".join(f"alpha{i} beta{i}." for i in range(40)), "top_bigram": "the and " * 60 + "."}
    rows = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    failing = {r["doc_id"]: r["failing"] for r in ql.judged(ql.measures(rows)).collect()}
    assert failing["good"] == []
    for rule in bad:
        assert rule in failing[rule]


def test_personal_data(spark):
    texts = ["mail a.b+c@example.com or 555-123-4567, host 192.168.0.255, 01:23:45:67:89:ab", "1234 5678 9012 ABCDE1234F (499) 555-6503 +91 98450 12345", "no 256.1.1.1 nor 12:34", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: {k: r[f"n_{k}"] for k in cp.PII_PATTERNS if r[f"n_{k}"]} for r in cp.pii_counts(rows).collect()}
    assert got == {0: {"email": 1, "phone": 1, "ipv4": 1, "mac": 1}, 1: {"aadhaar": 1, "pan": 1, "phone": 2}, 2: {}, 3: {}}


def test_detection_finds_the_language_it_was_trained_on(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and runs away ", "le renard brun saute par dessus le chien paresseux et part "
    rows = spark.createDataFrame([(1, "en", en * 3), (2, "fr", fr * 3), (3, "en", "short")], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["detected"] for r in lg.detect_language(rows, lg.language_profiles(rows)).collect()}
    assert got == {1: "en", 2: "fr", 3: None}


def test_seams_and_shares(spark):
    stages = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.8), (2, "b", 0.2), (3, "a", 0.8), (3, "b", 0.2)], "ord int, lane string, share double")
    got = {r["ord"]: round(abs(r["shift"]), 6) for r in mx.seams(stages).collect()}
    assert got == {2: 0.3, 3: 0.0}
    kept = mx.renormalised(stages.where("ord = 1"), stages.where("lane = 'a'"), "lane").collect()
    assert [(r["lane"], r["share"]) for r in kept] == [("a", 1.0)]


def test_masking(spark):
    texts = ["mail a.b+c@example.com or 555-123-4567", "Priya met Xavier near Emma", "", None, "host 10.0.0.1 " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    off, low, high = ({r["doc_id"]: r["masked"] for r in pn.mask(rows, d).collect()} for d in (0.0, 0.5, 0.9))
    assert off[0] == "mail [EMAIL] or [PHONE]" and off[1] == texts[1] and off[2] == off[3] == "" and off[4] == "host [IP] " * 500
    assert low[1] == "[NAME] met Xavier near [NAME]" and high[1] == "[NAME] met [NAME] near [NAME]"
    assert {r["kind"]: (r["n_spans"], r["n_docs"]) for r in pn.masked_by_kind(pn.mask(rows)).collect()} == {"email": (1, 1), "phone": (1, 1), "ipv4": (500, 1)}
    assert pn.settled([(3, 9, "b", ""), (0, 5, "a", ""), (0, 4, "c", ""), (9, 10, "d", "")]) == [(0, 5, "a", ""), (9, 10, "d", "")]
    assert pn.mask(rows.limit(0)).count() == 0


def test_attributed_index_and_canaries(spark):
    seven, five = "one two three four five six seven", "a b c d e"
    items = spark.createDataFrame([(1, seven), (2, five), (3, None)], "item_id int, text string")
    assert tuple(at.refused(items).first()) == (0, 1, 2)
    index = at.item_index(items, F.lit("small"))
    docs = spark.createDataFrame([(1, f"x {seven.upper()} y {seven}"), (2, "one two three four five six"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in at.collisions(docs, index).collect()] == [(1, "small", 1)]
    assert at.collisions(docs, index.limit(0)).count() == 0
    planted = at.canaries(spark, 3, seed=7)
    found = cp.contaminated(planted.select(F.col("canary").alias("doc_id"), F.concat(F.lit("pre "), "text").alias("text")), planted)
    assert {r["doc_id"] for r in found.collect()} == {0, 1, 2}
    assert (at.coverage(0, 0), at.coverage(0, 3), at.coverage(5, 3)) == ("unchecked", "canary-only", "held-out")


def test_files_and_fingerprints(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", None, "s"), (2, None, "en", "t")], tb.DOCUMENT)
    tb.write_jsonl(rows, f"{tmp_path}/docs.jsonl")
    tb.write_parquet(rows, f"{tmp_path}/docs", by="source")
    assert sorted(tb.read_documents(spark, f"{tmp_path}/docs.jsonl").collect()) == sorted(rows.collect())
    assert tb.read_documents(spark, f"{tmp_path}/docs").count() == 2
    assert mf.config_fingerprint({"a": 1, "b": 2}) == mf.config_fingerprint({"b": 2, "a": 1}) != mf.config_fingerprint({"a": 1})
    (tmp_path / "m.py").write_text("x = 1")
    before = mf.code_fingerprint(str(tmp_path))
    (tmp_path / "m.py").write_text("x = 2")
    assert mf.code_fingerprint(str(tmp_path)) != before and mf.run_id("lite", "a", "b", "c").startswith("run-lite-")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not re.search(r"\blimit\b", " ".join(entry.oracle_sql().values()).lower())
