"""Core operators against direct versions of their definitions: languages, near duplicates, budgets, files, sinks, tokens."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import attribution as at
from tessera.operators import conversations as cv
from tessera.operators import corpus as cp
from tessera.operators import language as lg
from tessera.operators import mixture as mx
from tessera.operators import neardup as nd
from tessera.operators import personal as pn
from tessera.operators import quality as ql
from tessera.operators import reports as rp
from tessera.operators import similarity as sm
from tessera.operators import tokens as tk
from tessera.sources import files as fl
from tessera.sources import sinks


def docs_of(spark, texts, more=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_text_scalars(spark):
    odd = ["a &amp;amp; b", "é x", "plain", None, "", "Å &#233;", "tab   end 　", "x‌y‍z​"]
    got = docs_of(spark, odd).select("doc_id", tx.unescape_nfc(F.col("text")).alias("u"), tx.nfc(F.col("text")).alias("n"), tx.strip(F.col("text")).alias("s"), tx.clean_text(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [r["u"] for r in got][:3] == ["a & b", "é x", "plain"] and got[5]["u"] == "Å é" and got[3]["u"] is None
    assert [r["n"] for r in got] == [t if t is None else unicodedata.normalize("NFC", t) for t in odd]
    assert got[6]["s"] == "tab   end" and got[6]["c"] == "tab end" and got[7]["c"] == "x‌y‍z"
    scripts = docs_of(spark, ["abc", "कख a", "కఖగ ab", "12 !", "", "字字"]).select(tx.dominant_script(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in scripts] == ["Latin", "Devanagari", "Telugu", "Unknown", "Unknown", "Unknown"]
    long = spark.createDataFrame([("ab c " * 40_000,)], "text string").select(F.size(tx.trigrams(F.col("text"))).alias("n")).first()
    assert long["n"] == 199_999


def test_stage_findings(spark):
    texts = ["one &lt;b&gt; two", "one &amp;lt; two", "a​  b", "a b", "​", None, "x‌y"]
    found = {r["doc_id"]: r for r in rp.findings(docs_of(spark, texts)).collect()}
    assert [found[i]["entities"] for i in range(7)] == [1, 1, 0, 0, 0, 0, 0] and found[1]["double_escaped"] == 1 and found[0]["double_escaped"] == 0
    assert found[2]["zero_width"] == 1 and found[2]["space_runs"] == 1 and found[6]["joiner_zwnj"] == 1
    r = rp.normalise_report(rp.findings(docs_of(spark, texts))).first()
    assert (r["docs_in"], r["docs_out"], r["collisions_gained"], r["entities"]) == (7, 5, 1, 2)


def test_language_detection_is_the_definition(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcde fg", "bb": "efghi jk", "cc": "कखगघ ङ"}
    make = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    train = [(lang, make(lang, 4000)) for lang in alphabets]
    profiles = lg.language_profiles(spark.createDataFrame(train, "lang string, text string"), top=60)
    weights = {lang: {r["gram"]: r["weight"] for r in profiles.where(F.col("lang") == lang).collect()} for lang in alphabets}
    grams = lambda t: Counter(f" {' '.join(t.split())} "[i : i + 3] for i in range(len(" ".join(t.split()))))
    for lang, text in train:
        top = sorted(grams(text).items(), key=lambda x: (-x[1], x[0]))[:60]
        total = sum(n for _, n in top) + len(top)
        assert weights[lang].keys() == {g for g, _ in top} and all(abs(weights[lang][g] - math.log((n + 1) / total)) < 1e-12 for g, n in top)
    texts = [make("aa", 80), make("bb", 300), make("cc", 90), make("aa", 39), "", None, "12 34 " * 20, "字" * 50, make("aa", 60) + make("cc", 30), make("aa", 50) + " Й"]
    got = {r["doc_id"]: r for r in lg.detect_language(docs_of(spark, texts), profiles).collect()}
    assert len(got) == len(texts)
    assert [got[i]["detected"] for i in range(8)] == ["aa", "bb", "cc", None, None, None, None, None]
    assert got[7]["script"] == "Cjk" and got[7]["reason"] == "no profile of the script" and got[6]["script"] == "Unknown" and got[2]["confidence"] == 1.0
    assert got[8]["code_switched"] and not got[9]["code_switched"]
    for i in (0, 1):
        g = grams(texts[i])
        scores = sorted((sum(n * weights[k].get(x, -20.0) for x, n in g.items()) / sum(g.values()) for k in ("aa", "bb")), reverse=True)
        assert abs(got[i]["score"] - scores[0]) < 1e-9 and abs(got[i]["runner_up"] - scores[1]) < 1e-9
    claimed = docs_of(spark, texts).withColumn("lang", F.lit("bb"))
    report = {(r["kind"], r["key"]): r["n"] for r in lg.language_report(lg.detect_language(claimed, profiles), profiles).collect()}
    assert report[("detected", "undecided")] == 5 and report[("mismatch", "bb->aa")] == 3 and report[("code_switched", "")] == 1
    unknown = lg.language_report(lg.detect_language(claimed.withColumn("lang", F.lit("zz")), profiles), profiles)
    assert unknown.where("kind = 'unadjudicable'").first()["n"] == 5
    assert lg.detect_language(docs_of(spark, []), profiles).count() == 0


def test_near_pass_is_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "one two", "One TWO"]
    for _ in range(6):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(7):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    found = nd.near_pass(docs_of(spark, texts))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for t in texts)]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in found.candidates.collect():
        assert abs(r["jaccard"] - like(sets[r["a"]], sets[r["b"]])) < 1e-12
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(r["a"], r["b"]) for r in found.verified.collect()] + [(r["rep"], r["doc_id"]) for r in found.members.collect()]
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["keep_id"] for r in found.dropped().collect()} == {i: find(i) for i in range(len(texts)) if find(i) != i}
    report = found.report().first()
    assert report["removed"] == sum(find(i) != i for i in range(len(texts))) and report["verified_pairs"] == found.verified.count()
    assert sum(r["size"] * r["n"] for r in found.cluster_sizes().collect()) == report["removed"] + report["clusters"]
    assert found.examples(5).count() <= 5
    keys = spark.createDataFrame([(i, k) for k in range(3) for i in range(700) if i % (k + 1) == 0], "rep long, key long")
    assert nd.candidate_pairs(keys).count() == 700 * 699 // 2  # in blocks, every pair once
    assert nd.near_pass(docs_of(spark, [])).dropped().count() == 0


def test_budgets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(1, 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")

    def direct(budget_of):
        out, counted, shards = set(), 0, [None, "a", "b"]
        for k, shard in enumerate(shards):
            share, total = budget_of(counted, len(shards) - k), 0
            of = [r for r in rows if r[1] == shard]
            for c in range(0, len(of), 7):
                if total >= share:
                    break
                out |= {r[0] for r in of[c : c + 7]}
                total += sum(r[2] for r in of[c : c + 7])
            counted += total
        return out

    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(cp.budgeted(docs, F.col("n"), 400, chunk=7)) == direct(lambda counted, left: 400)
    assert ids(cp.budgeted_corpus(docs, F.col("n"), 3000, chunk=7)) == direct(lambda counted, left: max((3000 - counted) // left, 1) if counted < 3000 else 0)
    assert cp.budgeted_corpus(docs.where("false"), F.col("n"), 10).count() == 0
    assert [r["doc_id"] for r in cp.probed(docs, 3).collect()] == [0, 1, 2]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "seed.csv").write_bytes("﻿name,note\nx,\"two\nlines \"\"quoted\"\"\"\ny,\n".encode())
    rows = fl.csv_rows(spark, f"file://{tmp_path}/seed.csv").collect()
    assert rows[0].asDict() == {"name": "x", "note": 'two\nlines "quoted"'} and rows[1]["note"] is None
    (tmp_path / "m.json").write_text('{"deals": [{"id": "a", "v": 1}, {"id": "b"}], "trends": []}')
    assert sorted(r["id"] for r in fl.json_records(spark, f"file://{tmp_path}/m.json", "deals").collect()) == ["a", "b"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        fl.json_records(spark, f"file://{tmp_path}/bad.json", schema="id string").collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "en.txt").write_text("a\nb")
    assert fl.text_files(spark, f"file://{tmp_path}/t").first().asDict() == {"name": "en", "text": "a\nb"}
    path = f"file://{tmp_path}/p"
    spark.range(100).selectExpr("id", "id * 2 as twice").coalesce(1).write.parquet(path)
    file = next(p for p in (tmp_path / "p").iterdir() if p.suffix == ".parquet")
    planned = spark.createDataFrame([("c", f"file://{file}", file.stat().st_size), ("c", f"file://{tmp_path}/none", 1)], "corpus string, path string, size long")
    a, b = fl.survey(planned).collect()
    assert (a["reachable"], a["n_rows"], a["row_groups"], a["columns"], a["size_matches"], b["reachable"]) == (True, 100, 1, ["id", "twice"], True, False)
    placed = fl.in_file_order(spark, path, ("twice", "no")).collect()
    assert all(r["twice"] == 2 * r["row"] for r in placed)
    with pytest.raises(ValueError):
        fl.question_items(spark.range(1), ())

    small = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    n = sinks.write_bundle({"one": small, "two": small.limit(0)}, f"file://{tmp_path}/bundle.json")
    assert (tmp_path / "bundle.json").read_text() == '{"one": [{"a": 1, "b": "x"}, {"a": 2}], "two": []}' and n == (tmp_path / "bundle.json").stat().st_size
    with pytest.raises(ValueError):
        sinks.write_bundle({"one": small}, f"file://{tmp_path}/no.json", limit=3)
    items = docs_of(spark, ["a b c d e f g", "h i j k l m n o p q r s t u v", "no"]).withColumnRenamed("doc_id", "item_id")
    payload = sinks.write_index(at.item_index(items, F.lit("bench")), at.refused(items), f"file://{tmp_path}/idx", f"file://{tmp_path}/idx.json")
    assert payload == {"shingles": 4, "widths": [7, 13], "benchmarks": {"bench": 4}, "full": 1, "narrow": 1, "refused": 1}
    sinks.save_merges(spark, f"file://{tmp_path}/v.json", {"a": 0}, [("a", "b")])
    assert sinks.load_merges(spark, f"file://{tmp_path}/v.json") == ({"a": 0}, [("a", "b")])
    sinks.write_results(small, f"file://{tmp_path}/res")
    assert spark.read.json(f"file://{tmp_path}/res").count() == 2


def test_tokens(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["The quick brown fox", "", None, "naïve café 2024!", "The quick brown fox"]
    got = {r["doc_id"]: r for r in tk.counted_once(docs_of(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        assert (got[i]["tokens"], got[i]["words"]) == (len(t.encode(x or "", add_special_tokens=False).ids), len((x or "").split()))
    bytes_path = public.path("byte_bpe_50k.json")
    assert all(r["faithful"] for r in tk.round_trip(docs_of(spark, [x or "" for x in texts]), bytes_path).collect())
    cache = f"file://{tmp_path}/ids"
    first = sinks.cached_ids(docs_of(spark, texts), bytes_path, cache).count()
    assert first == 3 and sinks.cached_ids(docs_of(spark, [*texts, "new"]), bytes_path, cache).count() == 4
    assert sinks.cached_ids(docs_of(spark, texts), bytes_path, cache).count() == 4

    merges = [("l", "o"), ("lo", "w"), ("▁", "low"), ("e", "r")]
    vocabulary = {s: i for i, s in enumerate(["<unk>", "▁", "l", "o", "w", "e", "r", "lo", "low", "▁low", "er"])}
    coded = tk.merge_encode(docs_of(spark, ["low lower", "slow ｌow", "", None]), vocabulary, merges)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert ids == {0: [9, 9, 10], 1: [1, 0, 8, 9], 2: [], 3: []}
    assert tk.merge_decode(coded.where("doc_id = 0"), vocabulary).first()["text"] == "low lower"
    assert tk.merged("aaaa", {("a", "a"): 0, ("aa", "aa"): 1}) == ["aaaa"] and tk.merged("", {}) == []


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "User", "  hi 　"), (1, 1, None, " "), (1, 2, "gpt", "yes")], "conv_id int, turn int, role string, text string")
    r = cv.rendered(turns).first()
    assert (r["turns"], r["content"], r["samvaad"]) == (3, "hi\n\nyes", "[USER] hi [ASSISTANT] yes")
    cost = {x["format"]: x["per_turn"] for x in cv.cost_per_turn(cv.rendered(turns)).collect()}
    assert cost["content"] == 0 and cost["samvaad"] == round((len(r["samvaad"]) - len(r["content"])) / 3, 2)
    assert cv.cost_per_turn(cv.rendered(turns.limit(0))).first()["per_turn"] is None


def test_decontamination_finds_canaries(spark):
    planted = at.canaries(spark, 3)
    words = " ".join(f"w{i}" for i in range(20))
    texts = ["x " + planted.first()["text"], words, "clean text of few words", None]
    kept, report = at.decontaminated(docs_of(spark, texts), docs_of(spark, [words]), planted)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert report.first().asDict() == {"docs_in": 4, "flagged": 2, "canary_only": 1, "docs_out": 2, "coverage": "held-out"}
    none = at.decontaminated(docs_of(spark, texts), docs_of(spark, []))[1].first()
    assert none["coverage"] == "unchecked" and none["flagged"] == 0


def test_masking_counts_agree(spark):
    texts = ["mail a.b@c.org or +91 98765 43210", "1234 5678 9012 and 10.0.0.1", "ABCDE1234F aa:bb:cc:dd:ee:ff", None]
    docs = docs_of(spark, texts).withColumn("source", F.lit("s"))
    masked = pn.mask(docs)
    by_kind = {r["kind"]: r["n_spans"] for r in pn.masked_by_kind(masked).collect()}
    counted = cp.pii_counts(docs).agg(*[F.sum(f"n_{k}").alias(k) for k in cp.PII_PATTERNS]).first().asDict()
    assert by_kind == {k: n for k, n in counted.items() if n} == {k: 1 for k in cp.PII_PATTERNS}
    assert rp.masked_by_corpus(masked, docs).first().asDict() == {"corpus": "s", "n_spans": 6, "n_docs": 3}


def test_draws_resume_and_refuse(spark):
    lanes = spark.createDataFrame([("a", 0.7, 1000), ("b", 0.3, 5000)], "lane string, share double, tokens long")
    rows = lambda n, first: sorted(map(tuple, mx.mixture_draws(lanes, n, 100, seed=1, first=first).collect()))
    whole = rows(2000, 0)
    assert len(whole) == 2000 and rows(500, 1500) == whole[1500:]
    assert abs(sum(lane == "a" for _, lane, _ in whole) / 2000 - 0.7) < 0.04
    assert all(0 <= start < {"a": 1000, "b": 5000}[lane] - 100 for _, lane, start in whole)
    with pytest.raises(Exception, match="too short"):
        mx.mixture_draws(lanes, 5, 2000).collect()


def test_quality_gate_and_rules(spark):
    text = ("The river is long and it runs to the sea with that of many hills. " * 6).strip()
    docs = docs_of(spark, [text, "short", None])
    m = ql.measures(docs)
    assert [r["doc_id"] for r in rp.quality_survivors(docs, m, gate=3.0).collect()] == []  # repeats its sentences
    assert rp.by_rule(ql.judged(m)).set_index("rule")["n"]["word_count"] == 2
    assert sm.threshold() == pytest.approx(0.719, abs=1e-3)
