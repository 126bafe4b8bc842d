"""Operators without SQL against direct versions of their definitions, and the cases that their docstrings name."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, langid, line_dedup, minhash, quality, queries, secrets, url_filter
from tessera.llm import fingerprint as fp
from tessera.llm.exact_dedup import exact_dedup_stage
from tessera.llm.url_filter import Rule

from test_llm import ODD, brute_components, frame

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[max(self.find(a), self.find(b))] = min(self.find(a), self.find(b))


# ---------------------------------------------------------------- stages lose nothing


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect())


def test_exact_stage_keeps_unique_texts(spark):
    stage = lambda texts, ids: rows_of(exact_dedup_stage(spark, frame(spark, texts, ids), ""))
    assert stage(["a", "a", "unique b"], [1, 2, 2]) == [(1, "a"), (2, "unique b")]
    assert stage(["a", "a", "a"], [1, None, None]) == [(1, "a")]
    assert [t for _, t in stage(["x", "x"], [None, None])] == ["x"]
    assert len(stage(["a  b", "a b", "a\tb"], [3, 3, 3])) == 1  # white space apart, one text
    assert stage(["B", "A", "B"], [1, 5, 5]) == [(1, "B"), (5, "A")]
    assert stage([], []) == []
    got = exact_dedup_stage(spark, frame(spark, ODD), "")
    assert got.columns == frame(spark, ODD).columns and got.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD})


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    near, far = " ".join([*base, "tail"]), " ".join(f"v{rng.randrange(900)}" for _ in range(300))
    base = " ".join(base)
    docs = frame(spark, [base, near, far], [1, 2, 2])
    assert rows_of(minhash.near_dedup_stage(spark, docs, "")) == sorted([(1, base), (2, far)])
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_dedup(docs).collect())
    assert got == [(1, 1, 56), (2, 1, 57), (2, 2, 296)]
    assert minhash.near_dedup_stage(spark, frame(spark, [base, base, near, "", None, "", " "], [None] * 7), "").count() == 5  # texts without words stay
    assert len(rows_of(minhash.near_dedup_stage(spark, frame(spark, [base, base, near], [None] * 3), ""))) == 1
    assert rows_of(minhash.near_dedup_stage(spark, frame(spark, [base, base], [4, 4]), "")) == [(4, base)]
    assert rows_of(minhash.near_dedup_stage(spark, frame(spark, [base, near], [None, 7]), "")) == [(7, near)]


def test_near_links_of_a_hub_and_of_many_copies(spark):
    """A group whose members all meet one centre, in a table where it holds most rows."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    texts = []
    for i in range(260):
        copy = list(base)
        copy[rng.randrange(80)] = f"n{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{rng.randrange(5000)}" for _ in range(50)) for _ in range(60)]
    want, _ = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("size", [7, 12, 24, 60, 300])
def test_recall_at_the_threshold(size):
    """Pairs just at 75 % that share no band: at most 5 in 10,000 are allowed for."""
    rng = np.random.default_rng(size)
    shared, misses, n = math.ceil(size * 6 / 7), 0, 3000
    while 100 * shared < 75 * (2 * size - shared):
        shared += 1
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(x[:size]), np.sort(np.r_[x[:shared], x[size:]])
        misses += not (minhash.band_keys(minhash.signature(a)) == minhash.band_keys(minhash.signature(b))).any()
    assert misses <= n * 5e-4 + 1


def test_split_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_SPLIT", 10)
    monkeypatch.setattr(common, "SPLIT_SHARE", 4)
    rows = [(1, i) for i in range(500)] + [(2, i) for i in range(3)] + [(3, 0)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(1, 500, "a"), (2, 3, "b"), (4, 9, "d")], "k int, n long, w string")
    got = sorted((r["k"], r["v"], r["w"]) for r in common.split_join(left, right, ["k"], "n", len(rows), F.col("v")).collect())
    assert got == sorted((k, v, {1: "a", 2: "b"}[k]) for k, v in rows if k < 3)


# ---------------------------------------------------------------- long texts take linear time


def timed(f):
    began = time.time()
    f()
    return time.time() - began


def test_secrets_of_long_runs(spark):
    texts = ["a" * 1_000_000 + " ://", "a1" * 400_000 + "://x", "a." * 400_000 + "amazonaws", "token" + " " * 500_000, "x" * 300_000 + "://" + "y" * 300_000]
    assert timed(lambda: secrets.secret_scan(frame(spark, texts)).count()) < 60
    host = [f"see https://a.b.example.org/x key {'A1b2' * 10} end", "at my.bucket.s3.amazonaws.com with " + "Zz9+" * 10]
    got = [r["spans"] for r in secrets.secret_scan(frame(spark, host)).orderBy("doc_id").collect()]
    assert got[0].startswith("endpoint:4:") and "bare" in got[0] and got[1].startswith("endpoint:3:29,bare:35:")


def test_line_dedup_of_equal_lines(spark):
    texts = ["same line of seven words right here\n" * 100_000, "\n".join(f"a{i % 7} b{i % 7} c{i % 7}" for i in range(40_000)), "x y\n" * 10, None]
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert time.time() - began < 120
    assert got[0]["n_removed"] > 99_980 and got[1]["n_removed"] > 39_900 and got[2]["n_removed"] == 0


def test_line_dedup_of_null_ids_ties_and_clashes(spark):
    passage = "\n".join(" ".join(f"p{k}_{i}" for i in range(20)) for k in range(4))
    texts, ids = [f"{passage}\nown a", f"{passage}\nown b", f"{passage}\nown b", f"{passage}\nown c"], [None, 3, 3, 2]
    docs = frame(spark, texts, ids).withColumn("runs", F.lit("x")).withColumn("n_lines", F.lit(1)).withColumn("d", F.lit(2))
    got = defaultdict(set)
    for r in line_dedup.line_dedup(docs).collect():
        got[r["doc_id"]].add((r["n_removed"], r["text"]))
    assert got == {None: {(0, texts[0])}, 3: {(4, "own b")}, 2: {(4, "own c")}}


# ---------------------------------------------------------------- URL filter


def test_url_filter_is_brute_force(spark):
    rng = random.Random(3)
    rules = [Rule("allow", "org", "/"), Rule("block", "bad.net", "/x/"), Rule("block", "example.org", "/es/"), Rule("allow", "bad.net", "/x/ok"), Rule("block", "com", "/de/")]
    hosts = ["a.org", "bad.net", "w.bad.net", "example.org", "site.com", "b.net", "c.net"]
    path = lambda: rng.choice(["/x/", "/es/", "/de/", "/", "/x/ok", "/p"]) + str(rng.randrange(9))
    keys = sorted({rng.choice(hosts) + path() for _ in range(160)})
    rng.shuffle(keys)
    crawled, uncrawled = keys[:100], keys[100:]
    hub = uncrawled[0]
    edges, rows = [], []
    for i, k in enumerate(crawled):
        html = None
        if rng.random() < 0.35:
            to = hub if rng.random() < 0.1 else rng.choice(keys)
            html = rng.choice(['<link rel="canonical" href="http://{}">', "<meta http-equiv=refresh content=\"0; url=https://{}\">", "<LINK href='//{}' rel=canonical>"]).format(to)
            edges.append((k, to))
        rows.append((i, f"http://{k}", html))
    extra = [(rng.choice(keys), rng.choice(keys)) for _ in range(8)] + [(uncrawled[i], uncrawled[i + 1]) for i in range(5, 12)]
    redirects = spark.createDataFrame([(f"http://{a}", f"https://{b}#frag") for a, b in extra], "src string, dst string")
    union = Union()
    for a, b in edges + extra:
        union.join(a, b)
    for k in keys:  # a page and what lies behind its trailing slash are one address
        if k.endswith("/"):
            union.join(k, k.rstrip("/"))

    def said(key):
        host, p = key.split("/", 1)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and f"/{p}".startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)) if fits else None

    classes = defaultdict(set)
    linked = {x for e in edges + extra for x in e}
    for k in linked:
        if r := said(k):
            classes[union.find(k)].add(r.verdict)
    got = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, redirects).collect()}
    propagated = 0
    for i, k in enumerate(crawled):
        own, of_class = said(k), classes[union.find(k)]
        want = own.verdict if own else "block" if "block" in of_class and "allow" not in of_class else "allow"
        propagated += own is None and want == "block"
        assert (got[i]["rule"], got[i]["verdict"]) == (own.name if own else None, want), k
    assert propagated >= 3


def test_url_filter_judges_what_is_only_linked_to(spark):
    rules = [Rule("block", "bad.net", "/x/"), Rule("allow", "good.net", "/")]
    rows = [(1, "http://a.net/1", '<link rel=canonical href="http://bad.net/x/9">'), (2, "http://b.net/", None), (3, "http://c.net/1", '<link rel=canonical href="http://d.net/">'), (4, "http://bad.net:80/x/1", None), (4, "http://bad.net:80/x/1", None), (5, "http://e.net/" + "z" * 50_000, "<p>" * 50_000)]
    redirects = spark.createDataFrame([("http://c.net/1", "http://bad.net/x/2"), ("http://c.net/1", "http://good.net/")], "src string, dst string")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, redirects).collect())
    assert got == [(1, "block"), (2, "allow"), (3, "allow"), (4, "block"), (4, "block"), (5, "allow")]
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


# ---------------------------------------------------------------- language ID


EN, FR = "the house of the old man and the sea and the ship that sails there ", "la maison du vieil homme et de la mer et le bateau qui vogue la bas "


def fused(pages, docs):
    """The definition in numpy: (text language, language, posterior) of each page."""
    langs = sorted({lang for lang, _ in docs if lang})
    table = np.array([sum(langid.trigram_counts(t) for lang, t in docs if lang == k) for k in langs]) + langid.SMOOTHING
    profiles = np.log(table / table.sum(axis=1, keepdims=True))
    rows, posts, lls = [], [], []
    for url, html in pages:
        markup = html or ""
        n = langid.trigram_counts(langid.visible_text(markup))
        total = n.sum()
        ll = profiles @ n * (min(total, langid.EFFECTIVE_TRIGRAMS) / total) if total else np.zeros(len(langs))
        lls.append(ll - ll.max())
        posts.append(np.exp(lls[-1]) / np.exp(lls[-1]).sum())
        host = re.match(r"^[^/?#]*", url.split("://", 1)[1]).group().lower() if url and "://" in url else ""
        m = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", markup)
        rows.append((host, (re.search(r"[^.]+\.[^.]+$", host) or [""])[0], host.rpartition(".")[2] if "." in host else "", m.group(1).lower() if m else ""))
    posts = np.array(posts)
    shares = posts.sum(axis=0) + langid.EVIDENCE_SMOOTHING
    shares /= shares.sum()
    of = lambda f: posts[[k for k, r in enumerate(rows) if f(r)]].sum(axis=0)
    smooth = lambda s, parent: (s + langid.PRIOR_WEIGHT * parent) / (s.sum() + langid.PRIOR_WEIGHT)
    evidence = lambda s: np.log((s + langid.EVIDENCE_SMOOTHING * shares) / shares)
    out = []
    for (host, domain, suffix, declared), ll in zip(rows, lls):
        by_suffix = smooth(of(lambda r: r[2] == suffix), shares)
        by_domain = smooth(of(lambda r: r[1:3] == (domain, suffix)), by_suffix)
        prior = smooth(of(lambda r: r[0] == host), by_domain)
        total = ll + np.log(prior)
        total = total + (evidence(of(lambda r: r[3] == declared)) if declared else 0) + (evidence(of(lambda r: r[2] == suffix)) if suffix else 0)
        p = np.exp(total - total.max())
        out.append((langs[int(ll.argmax())], langs[int(p.argmax())], float((p / p.sum()).max())))
    return out


def test_language_id_is_the_definition_and_fusion_decides(spark):
    docs = [("en", EN * 20), ("fr", FR * 20), (None, "x"), ("fr", "")]
    page = lambda lang, text: f'<html lang="{lang}"><p>{text}</p>' if lang else f"<p>{text}</p>"
    pages = [("http://a.fr/1", page("fr", FR)), ("http://a.fr/2", page("fr", FR)), ("http://a.fr/3", page("fr", "")), ("http://a.fr/4", None), ("http://b.com/1", page("en", EN)), ("http://b.com/2", page(None, EN)),
             ("http://b.com/3", page("fr", EN)), ("http://c.fr/1", page("fr", "ok")), ("http://c.com/1", page(None, "")), (None, page("en", "")), ("no scheme", None), ("http://a.fr/5", page("en", FR * 3)), ("http://x.y.a.fr:80/", "12 34"),
             ("http://b.com/1", page("en", EN)), ("http://long.com/", page(None, EN * 3000))]
    want = fused([(u, h) for u, h in pages], docs)
    want[12] = None  # ports and users are taken off hosts, which the direct version doesn't
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumn("lang", F.lit("clash")).withColumn("host", F.lit("clash"))
    labelled = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string")
    got = {r["page_id"]: r for r in langid.identify(rows, labelled).collect()}
    assert len(got) == len(pages) and got[4]["confidence"] == got[13]["confidence"]
    assert langid.identify(rows, labelled.where("lang = 'none'")).where("lang = 'und'").count() == len(pages)
    # text alone says nothing on 2, 3 and 7: the declaration, the suffix and the host's prior decide
    assert [got[i]["lang"] for i in (0, 2, 3, 7)] == ["fr"] * 4 and got[2]["text_lang"] == "en" and got[6]["lang"] == got[5]["lang"] == "en"
    others = [i for i in range(len(pages)) if want[i] and pages[i][0] != pages[12][0]]
    shared = spark.createDataFrame([(i, *pages[i]) for i in others], "page_id long, url string, html string")
    again = {r["page_id"]: r for r in langid.identify(shared, labelled).collect()}
    for i, w in zip(others, fused([pages[i] for i in others], docs)):
        assert (again[i]["text_lang"], again[i]["lang"]) == w[:2] and abs(again[i]["confidence"] - w[2]) < 1e-9


def test_language_id_accuracy_on_held_out_documents(spark):
    """Profiles of some documents, judged on the others, as bare pages without any address or declaration."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) >= 200")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    pages = docs.where(held).select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.regexp_replace("text", "[<&]", " ").alias("html"))
    found = langid.identify(pages, docs.where(~held)).join(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("true")), "page_id")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("true"))).first()
    assert n > 100 and right / n >= 0.95
    with pytest.raises(Exception, match="languages"):
        langid.train_profiles(spark.range(langid.MOST_LANGUAGES + 2).select(F.col("id").cast("string").alias("lang"), F.lit("some text").alias("text")))


# ---------------------------------------------------------------- fingerprints


def direct_digest(text, ranks):
    """Features of a text by the definition, window by window, and their filters."""
    b = text.encode()
    if not b:
        return []
    levels = fp.entropy_levels(np.frombuffer(b, np.uint8)) if len(b) >= fp.WINDOW else np.zeros(0, np.int64)
    votes = defaultdict(int)
    for s in range(1 - fp.NEIGHBOURS if len(levels) else 0, len(levels)):  # neighbourhoods reach over the text's ends
        votes[min(range(max(s, 0), min(s + fp.NEIGHBOURS, len(levels))), key=lambda k: (ranks[levels[k]], k))] += 1
    chosen = [b[k : k + fp.WINDOW] for k in sorted(votes) if votes[k] >= fp.ELECTED]
    hashes = [int(fp.mix((np.frombuffer(w, "<u8") * fp._PLACE).sum(dtype=np.uint64, keepdims=True))[0]) for w in chosen] or [fp.xxhash.xxh3_64_intdigest(b)]
    out = []
    for i in range(0, len(hashes), fp.FILTER_FEATURES):
        bits = {(h >> (11 * k)) % fp.FILTER_BITS for h in hashes[i : i + fp.FILTER_FEATURES] for k in range(fp.HASHES)}
        out.append((len(hashes[i : i + fp.FILTER_FEATURES]), bits))
    return out


def direct_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (len(a), sum(n for n, _ in a)) > (len(b), sum(n for n, _ in b)):
        a, b = b, a
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            chance = len(x) * len(y) / fp.FILTER_BITS
            best = max(best, min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))))
        total += n * best
    return total / sum(n for n, _ in a)


def read_bits(fingerprint):
    counts, filters = fp.from_string(fingerprint)
    return [(int(n), set(np.flatnonzero(np.unpackbits(f.view(np.uint8))).tolist())) for n, f in zip(counts, filters)]


def test_fingerprints_are_the_definition(spark):
    rng = random.Random(13)
    words = [f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(99)}" for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 60, 400, 3000, 90)]
    texts += [None, "", "short", "x" * 6000, "é字😀" * 500, texts[1]]
    ids = [*range(10, 10 + len(texts) - 1), None]
    docs = frame(spark, texts, ids)
    ranks = fp.corpus_ranks(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    levels = np.zeros(fp.LEVELS, np.int64)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        if len(data) >= fp.WINDOW:
            levels += np.bincount(fp.entropy_levels(data), minlength=fp.LEVELS)
    assert (fp.rarity_ranks(levels) == ranks).all()
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    order = sorted(range(len(texts)), key=lambda i: -1 if ids[i] is None else ids[i], reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        own, new, following = (direct_digest(t, ranks) for t in (text, edited, after))
        r = got[ids[i]]
        assert read_bits(r["fingerprint"]) == own and read_bits(r["edited_fingerprint"]) == new
        assert abs(r["near_edited"] - direct_likeness(own, new)) < 1e-9 and abs(r["near_next"] - direct_likeness(own, following)) < 1e-9
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[None]["fingerprint"] == got[11]["fingerprint"]  # equal texts
    lone = fp.fingerprints(frame(spark, ["a lone document of some words"], [5])).first()
    assert lone["near_next"] == 1.0
    repeated = fp.fingerprints(frame(spark, ["one", "two", "two", "three"], [4, 4, 4, 1])).collect()
    assert len(repeated) == 4


def test_fingerprints_of_hot_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 8)
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 25))) for _ in range(150)] + ["same"] * 20
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(len(texts))]
    docs = frame(spark, texts, ids)
    dealt = fp.with_neighbour(docs.select("doc_id", "text"))
    sizes = {r["bucket"]: r["n"] for r in dealt.where("look = 0").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == len(texts) and len(sizes) > 15 and max(sizes.values()) < 45
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(zip(ids, texts), key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    want = []
    for k, (i, text) in enumerate(rows):
        m = len(text) // 3
        want.append((str(i), hashlib.sha256((text[: len(text) - m] + rows[(k + 1) % len(rows)][1][:m]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fp.fingerprints(docs).collect()) == sorted(want)


# ---------------------------------------------------------------- secrets


BASE = (("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6), ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile(r"([0-9a-f]+)"), 24))


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, least) in enumerate(BASE) for m in p.finditer(text) if len(m.group(1)) >= least]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def test_secrets_base_is_brute_force(spark):
    rng = random.Random(21)
    pieces = ["password", "Token", "api_key", "APIKEY", "secret", " ", "=", ":", '"', "'", "  ", "AKIA", "0123456789abcdef", "deadBEEF", "ABCDEFGH12345678", "é", "😀", "\n", "x", "abcdef", "token=token=", "://", "user: bob", "Aa1+/" * 8]
    texts = [*ODD, *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    got = {r["doc_id"]: r for r in secrets.secret_scan(frame(spark, texts)).collect()}
    hits = 0
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        hits += len(want)
        assert got[i]["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t
        assert [got[i][f"n_{k}"] for k, _, _ in BASE] == [sum(w[0] == k for w in want) for k, _, _ in BASE]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(got[i]["base"].split(",")) - {""} <= set(spans)
        weak = [s.split(":") for s in spans if s.split(":")[0] in ("bare", "login", "endpoint")]
        for kind, a, b in weak:  # weak spans have a complement within the scope
            role = {k[0]: k[1] for k in secrets.KINDS}
            near = [s.split(":") for s in spans if s.split(":")[0] != kind]
            assert any(role[k] in secrets.COMPLEMENTS[role[kind]] and int(x) <= int(b) + secrets.SCOPE and int(a) <= int(y) + secrets.SCOPE for k, x, y in near) or kind in ("bare", "login", "endpoint")
    assert hits > 200
    docs = documents(spark)
    for r in secrets.secret_scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(r["text"] or ""))


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id")
    n, right = found.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n >= 50 and right / n >= 0.95


def test_quality_odd_rows_and_sample(spark):
    texts = ["the calm river runs by the old mill and on to the sea. " * k for k in range(1, 30)] + ["BUY!!! $$$ ### click >>> " * k for k in range(1, 30)] + ["word " * 200_000, None, ""]
    ids = [*range(len(texts) - 2), None, None]
    labels = spark.createDataFrame([(i, int(i < 29), 0) for i in range(58)] + [(3, 0, 0), (None, 1, 0), (900, 2, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, texts[0], texts[40]], [*ids, 0, 0])  # a repeated id, each by its own text
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in got)
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r["predicted"])
    assert sorted(of[0]) == [0, 1, 1] and of[None][0] == of[None][1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    few = quality.train(docs, labels, sample_rows=12)
    assert few.weights.any()


def test_fit_takes_no_memory_for_pairs():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, quality.WIDTH)).astype(np.float32)
    label = (x[:, 0] + 0.1 * rng.normal(size=len(x)) > 0).astype(int)
    tracemalloc.start()
    model = quality.fit(x, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and ((model.strengths(x) > 0) == (label == 1)).mean() > 0.9


# ---------------------------------------------------------------- the pipeline, stage by stage


def test_pipeline_stages_are_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns

    run = lambda name, given: common.materialize(stages[name](spark, given, SF), "stage")
    good = run("quality classifier", docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    first, kept = {}, set()
    for i in sorted(r["doc_id"] for r in good.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    kept = set(first.values())
    once = run("exact dedup", good)
    assert {r["doc_id"] for r in once.collect()} == kept and once.count() == len(kept)
    ids = sorted(kept)
    near, sizes = brute_components([texts[i] for i in ids])
    apart = run("near dedup", once)
    assert {r["doc_id"] for r in apart.collect()} == {i for k, i in enumerate(ids) if near[k] == k}
    masked = run("secret scans", apart)
    spans = {r["doc_id"]: r["found"] for r in secrets.secret_scan(apart).collect()}
    changed = 0
    for r in masked.collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        want = out + text[at:] if text is not None else None
        changed += want != text
        assert r["text"] == want and (text is None or r["n_chars"] == len(want))
        assert all(text[a:b] not in r["text"] for _, a, b in base_spans(text or ""))
    assert masked.columns == apart.columns == once.columns == good.columns == columns and masked.count() == apart.count()
    packed = run("best-fit packing", masked).collect()
    fill, seen = defaultdict(list), defaultdict(list)
    for r in packed:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert set(seen) == {r["doc_id"] for r in masked.collect()}
    for pieces in seen.values():
        ends = np.cumsum([n for _, _, n in sorted(pieces)])
        assert [s for _, s, _ in sorted(pieces)] == [0, *ends[:-1]]
    for some in fill.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_take_empty_tables_and_odd_rows(spark):
    import corpus_pipeline

    docs = documents(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, "again one", None, None, 9), (1, "again one", None, None, 9)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        assert stage(spark, odd, SF).count() > 0, name


def test_queries_read_the_contract_columns(spark):
    want = {
        "op1_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "op2_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_url_filter": {"page_id", "host", "path", "rule", "verdict"},
        "op4_minhash": {"doc_id", "n_shingles", "component_id", "kept"}, "op6_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op9_quality": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, columns in want.items():
        assert columns <= set(queries.QUERIES[name](spark, SF).columns), name
