import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.markup import markdown
from tessera.operators import catalogue as ct
from tessera.operators import mixture as mx
from tessera.operators import similarity as sm
from tessera.operators import tokens as tk
from tessera.sources import records as rc
from tessera.streaming.store import ShardStore


def _rows(df, *keys):
    return sorted((tuple(r[k] for k in (keys or df.columns)) for r in df.collect()), key=str)


def _greedy(sets, least):
    kept, gone = [], {}
    for i, s in sorted(sets.items()):
        like = [k for k in kept if (1.0 if not s and not sets[k] else len(s & sets[k]) / len(s | sets[k])) >= least]
        if like:
            gone[i] = like
        else:
            kept.append(i)
    return gone


def test_greedy_survivors_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.randrange(10_000) for _ in range(40)] for _ in range(6)]
    sets = {}
    for i in range(150):
        s = set(base[i % 6])
        for _ in range(rng.randrange(8)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10_000))
        sets[i] = s if i % 10 else set()
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "ord long, set array<long>")
    want = _greedy(sets, 0.719)
    got = {r["ord"]: r["by"] for r in sm.greedy_dropped(rows, 0.719).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] in want[i] for i in got)
    assert sm.greedy_dropped(rows.where("false"), 0.719).count() == 0


def test_greedy_is_not_transitive(spark):
    chain = {0: range(0, 20), 1: range(3, 23), 2: range(6, 26)}
    rows = spark.createDataFrame([(i, list(s)) for i, s in chain.items()], "ord long, set array<long>")
    assert _rows(sm.greedy_dropped(rows, 0.7)) == [(1, 0)]


def test_signature_estimates_similarity(spark):
    a, b = list(range(1000)), list(range(200, 1200))
    row = spark.createDataFrame([(a, b, [])], "a array<long>, b array<long>, e array<long>")
    r = row.select(sm.estimate(sm.signature(F.col("a")), sm.signature(F.col("b"))).alias("x"), sm.jaccard(F.col("a"), F.col("b")).alias("j"), sm.signature(F.col("e")).alias("e"), sm.jaccard(F.col("e"), F.col("e")).alias("je")).first()
    assert abs(r["x"] - r["j"]) < 0.15 and abs(r["j"] - 800 / 1200) < 1e-9
    assert set(r["e"]) == {sm.PRIME} and r["je"] == 1.0
    assert abs(sm.threshold() - 0.719) < 1e-3 and abs(sm.threshold(6, 4) - 0.639) < 1e-3


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _prose(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(120))


def test_store(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store")
    assert store.documents() is None and store.manifest().count() == 0
    a, b, c = _prose(1), _prose(2), _prose(3)
    first = store.add(_docs(spark, [(1, a), (2, b), (3, a + " tail"), (4, None), (5, "...")]), "s0", "web")
    assert (first["offered"], first["kept"], first["dropped_within"], first["dropped_across"]) == (5, 3, 2, 0)
    assert first["tokens"] == 240
    second = store.add(_docs(spark, [(11, b), (12, c), (13, c)]), "s1", "web", held_out=True)
    assert (second["kept"], second["dropped_within"], second["dropped_across"]) == (1, 1, 1)
    third = store.add(_docs(spark, [(21, a), (22, c)]), "s2", "books")
    assert (third["kept"], third["dropped_across"]) == (0, 2)
    assert store.add(_docs(spark, [(99, _prose(9))]), "s1", "web") == second  # committed already
    assert [r[0] for r in _rows(store.documents(), "doc_id")] == [1, 12, 2, 4]
    assert [r[0] for r in _rows(store.trainable(), "doc_id")] == [1, 2, 4]
    assert _rows(store.totals()) == [("books", 0), ("web", 240)]


def test_store_takes_a_stream(spark, tmp_path):
    _docs(spark, [(1, _prose(1)), (2, _prose(1)), (3, _prose(2))]).coalesce(1).write.json(f"{tmp_path}/in")
    store = ShardStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("doc_id long, text string").json(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        store.ingest(stream, "batch", "web", f"{tmp_path}/progress").awaitTermination()
    assert _rows(store.manifest(), "offered", "kept") == [(3, 2)]


def test_markdown():
    page = '<html><head><title>no</title></head><body><h2>Head</h2><p>a&nbsp;<b>bold</b> <a href="/x">link</a></p><script>var t="</p>";</script><ol><li>one<li>two</ol><table><tr><td>1</td><td>2</td></tr></table><pre>x  y</pre><img src="i.png" alt="pic">'
    got = markdown(page, "https://example.org/d/")
    for part in ("## Head", "a **bold** [link](https://example.org/x)", "1. one", "2. two", "| 1 | 2 |", "```\nx  y\n```", "![pic](https://example.org/d/i.png)"):
        assert part in got, got
    assert "no" not in got.split() and "var" not in got
    assert markdown(None) == markdown("") == "" and markdown("<p>open <b>end") == "open **end"
    assert markdown("<a href='http://[bad'>t</a>", "https://e.org") == "[t](http://[bad)"


def test_records(spark):
    row = spark.sql(
        "select ' ' as a, ' b ' as b, array(named_struct('content', ' x '), named_struct('content', ''), named_struct('content', 'y')) as t, cast(null as array<struct<content:string>>) as none, 'q' as q, array(named_struct('text', 'r'), named_struct('text', ' ')) as ans"
    )
    got = row.select(rc.first_text("a", "b"), rc.conversation_text(F.col("t")), rc.turn_count(F.col("t")), rc.conversation_text(F.col("none")), rc.turn_count(F.col("none")), rc.question_text(F.col("q"), F.col("ans"))).first()
    assert tuple(got) == ("b", "x\n\ny", 3, "", 1, "q\n\nr")
    assert rc.numbered(_docs(spark, []), "c", "doc_id").count() == 0


def test_token_metrics(spark):
    counts = spark.createDataFrame([("en", 100, 100), ("hi", 180, 100), ("xx", None, 5), ("xx", 3, 5)], "lang string, tokens long, units long")
    table = tk.fertility(counts)
    assert {r["lang"]: r["fertility"] for r in table.collect()} == {"en": 1.0, "hi": 1.8, "xx": None}
    s = tk.scores(table.where("lang != 'xx'")).first()
    assert math.isclose(s["score"], 1250) and math.isclose(s["penalty"], math.exp(0.5)) and math.isclose(s["mean"], 1.4)
    assert tk.scores(table.where("lang = 'en'")).first()["score"] == math.inf
    worse = spark.createDataFrame([("en", 1.5), ("hi", 1.6)], "lang string, fertility double")
    assert tk.degrades_best(worse, table.where("lang != 'xx'")).first()["degraded"]
    sizes = spark.createDataFrame([("a", 100), ("b", 25)], "lang string, size long")
    assert _rows(tk.corpus_weights(sizes)) == [("a", 1.0, 1), ("b", 4.0, 4)]
    assert _rows(tk.corpus_weights(sizes, "sqrt"), "lang", "weight") == [("a", 1.0), ("b", 2.0)]
    assert _rows(tk.corpus_weights(sizes, "manual", manual={"a": 2.0}), "lang", "weight") == [("a", 2.0), ("b", 1.0)]
    exp = spark.createDataFrame([("t", "en", 2.0), ("t", "hi", 5.0)], "tokenizer string, lang string, fertility double")
    assert _rows(tk.expansion(exp), "lang", "expansion") == [("en", 1.0), ("hi", 2.5)]
    use = spark.createDataFrame([(100, 5), (100, 6), (0, 0)], "t long, u long").select(tk.usable_count(F.col("t"), F.col("u")).alias("n"))
    assert [r["n"] for r in use.collect()] == [100, None, None]


def test_catalogue(spark):
    size = spark.createDataFrame([("251B tokens total: Verified 64B / Unverified 24B / Synthetic 162B",), ("3.5 GB",), (None,), ("1.5m Tokens",)], "s string")
    got = size.select(ct.stated_tokens(F.col("s")).alias("n"), ct.stated_parts(F.col("s")).alias("p")).collect()
    assert [r["n"] for r in got] == [251e9, None, None, 1.5e6]
    assert got[0]["p"] == {"verified": 64e9, "unverified": 24e9, "synthetic": 162e9} and got[2]["p"] == {}
    lic = spark.createDataFrame([("CC-BY-4.0",), ("CC-BY-NC-SA 4.0",), ("see site",), (None,)], "l string").select(ct.licence_flags(F.col("l")).alias("f"))
    assert [tuple(r["f"]) for r in lic.collect()] == [(True, True, None), (False, True, True), (None, None, None), (None, None, None)]
    gates = [("a", dict.fromkeys(ct.GATES, "PASS"), False), ("b", {"provenance": "PASS", "composition": "CONDITIONAL", "contamination": "PASS", "yield": "UNKNOWN", "evidence": "PASS"}, False), ("c", {"provenance": "PASS", "evidence": "PASS"}, None), ("x", {"provenance": "FAIL"}, False), ("y", dict.fromkeys(ct.GATES, "PASS"), True)]
    rows = spark.createDataFrame(gates, "id string, gates map<string,string>, blocking boolean")
    assert _rows(ct.graded(rows), "id", "score", "grade") == [("a", 10, "A"), ("b", 7, "B"), ("c", 4, "C"), ("x", 0, "X"), ("y", 10, "X")]
    tiers = spark.createDataFrame([("t", 100.0, False), ("s", 10.0, True), ("none", 5.0, False)], "tier string, required double, is_synthetic boolean")
    held = spark.createDataFrame([("t", "big", 90.0, 60.0, []), ("t", "part", 30.0, None, ["big"]), ("t", "other", None, None, ["elsewhere"]), ("s", "syn", 20.0, 1.0, [])], "tier string, id string, tokens double, verified double, parents array<string>")
    assert _rows(ct.supply_plan(tiers, held), "tier", "supply", "datasets", "unmeasured", "shortfall", "coverage") == [("none", 0.0, 0, 0, 5.0, 0.0), ("s", 20.0, 1, 0, 0.0, 2.0), ("t", 60.0, 2, 1, 40.0, 0.6)]
    caps = spark.createDataFrame([("math", ["math"], ["aftermath"]), ("code", ["code"], None)], "capability string, include array<string>, exclude array<string>")
    marks = spark.createDataFrame([("b1", "Grade school MATH"), ("b2", "the aftermath of war")], "benchmark string, about string")
    assert _rows(ct.capability_matrix(caps, marks), "capability", "n") == [("code", 0), ("math", 1)]
    t2, b2 = spark.createDataFrame([("x", ["p"]), ("y", ["q"]), ("z", [])], "tier string, capabilities array<string>"), spark.createDataFrame([("m", ["p"])], "benchmark string, capabilities array<string>")
    assert _rows(ct.orphans(t2, b2), "tier") == [("y",), ("z",)]
    ids = spark.createDataFrame([("i", "ok"), ("i", "odd")], "id string, kind string")
    assert _rows(ct.violations(ids, {"kind": ("ok",)}, 3), "kind", "detail") == [("count", "2"), ("repeated", "2"), ("value", "kind=odd")]
    best = ct.best_vocabulary(ct.vocabulary_sweep(spark, 131_072, 2.11, 4096, 32)).first()
    assert best["recommended"] % 128 == 0 and best["recommended"] - best["peak"] in range(128)


def test_mixture_statistics(spark):
    inv, head = spark.createDataFrame([("a", 10.0), ("a", None), ("b", 5.0)], "lane string, tokens double"), spark.createDataFrame([("a", 12.0), ("b", 5.05)], "lane string, headline double")
    assert _rows(mx.lane_supply(inv, head), "lane", "tokens", "n_unknown", "disagrees") == [("a", 10.0, 1, True), ("b", 5.0, 0, False)]
    stages = spark.createDataFrame([(0, 0.75, "a", 1.0), (1, 0.25, "a", 0.0), (1, 0.25, "b", 1.0)], "ord int, duration double, lane string, share double")
    assert _rows(mx.realised_mixture(stages)) == [("a", 0.75), ("b", 0.25)]
    sched = mx.sequence_schedule(spark.createDataFrame([(0, 10, 4096), (1, 5, 8192), (2, 5, 32768)], "ord int, tokens long, sequence_length int"))
    assert _rows(sched, "ord", "start", "end", "ok") == [(0, 0, 10, True), (1, 10, 15, True), (2, 15, 20, False)]
    one, two = spark.createDataFrame([("a", 1.0)], "lane string, share double"), spark.createDataFrame([("b", 1.0)], "lane string, share double")
    assert _rows(mx.seam_blend(one, two, 0.25)) == [("a", 0.75), ("b", 0.25)]
    arm = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("c", 0.2)], "lane string, share double")
    assert [(k, round(s, 9)) for k, s in _rows(mx.with_frozen(arm, ("a",)))] == [("a", 0.2), ("b", 0.4), ("c", 0.4)]
    vals, w = spark.createDataFrame([("r", "a", 2.0), ("r", "b", 4.0), ("r", "c", None)], "run string, lane string, score double"), spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "lane string, weight double")
    assert _rows(mx.weighted_score(vals, w)) == [("r", 2.5)]
    rep = spark.createDataFrame([(1, 2.0), (2, 2.2), (4, 2.1)], "epochs int, score double")
    assert _rows(mx.repetition_reading(rep, 0.15), "epochs", "beyond_noise", "inverted") == [(1, False, False), (2, True, True), (4, False, False)]
    loss = spark.createDataFrame([(i, 2.0 if i < 100 else 3.0 if i == 101 else 2.5) for i in range(50, 160)], "step int, loss double")
    assert mx.seam_peak(loss, 100).first()["ratio"] == pytest.approx(1.5)
    sc = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 2.5)], "scale int, arm string, score double")
    assert _rows(mx.rank_inversions(sc)) == [(1, 2, "a", "b")]
