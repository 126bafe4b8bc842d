"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_decode, bpe_encode
from tessera.llm.common import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.fingerprint import fingerprints
from tessera.llm.langid import identify
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash import near_dedup
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import quality_scores
from tessera.llm.secrets import secret_scan
from tessera.llm.url_filter import TRACKING, Rule, url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


#: The contract's rules.
URL_RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_url_filter, op4_minhash, op5_language_id, op6_fingerprints, op7_secrets, op8_packing, op9_quality, op10_line_dedup)
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

#: Reachable nodes by a recursive union over both directions of the edges l(a, b): (node, least).
_REACHED = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), q AS (SELECT a AS n, a AS m FROM e UNION SELECT e.b, q.m FROM q JOIN e ON e.a = q.n),
        c AS (SELECT n AS node, min(m) AS least FROM q GROUP BY n)"""
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_sql(host: str, path: str, what: str) -> str:
    """The longest rule that fits, as what(rule); else NULL."""
    whens = [f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name))]
    return f"CASE {' '.join(whens)} END"


def _conventional_sql(key: str) -> str:
    host = f"regexp_replace(regexp_replace(regexp_extract({key}, '^[^/?]*'), '^www\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({key}, '^[^/?]*([^?]*)', 1), '/(index\\.(html?|php))?$', '')"
    params = f"list_sort(list_filter(string_split(regexp_extract({key}, '^[^?]*\\?(.*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{TRACKING}')))"
    return f"{host} || {path} || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"


def _resource_sql(url: str) -> str:
    rest = f"regexp_extract(CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^#]*')"
    return f"translate(regexp_extract({rest}, '^[^/?]*'), '{_UP}', '{_LOW}') || regexp_extract({rest}, '^[^/?]*(.*)', 1)"


_HREF, _PLAIN = "trim(href)", "regexp_extract(trim(href), '^[^#]*')"
_SITE, _FOLDER = "regexp_extract(key, '^[^/?]*')", "regexp_extract(key, '^([^/?]*(?:/[^?/]*)*/)[^?/]*', 1)"
_PAGES = rf"""p AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, {_resource_sql("coalesce(url, '')")} AS key FROM pages),
        j AS (SELECT page_id, html, key, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        h AS (SELECT key, unnest([regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
          regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS href FROM j WHERE host <> ''),
        t AS (SELECT key, CASE WHEN contains({_HREF}, '://') THEN {_resource_sql(_HREF)} WHEN starts_with({_HREF}, '//') THEN {_resource_sql(f"('x:' || {_HREF})")} WHEN starts_with({_HREF}, '/') THEN {_SITE} || {_PLAIN}
          WHEN {_PLAIN} <> '' THEN CASE WHEN {_FOLDER} <> '' THEN {_FOLDER} ELSE {_SITE} || '/' END || {_PLAIN} END AS "to" FROM h UNION SELECT key, {_conventional_sql('key')} FROM j WHERE host <> ''),
        l AS (SELECT key AS a, "to" AS b FROM t WHERE key <> "to" UNION SELECT "to", {_conventional_sql('"to"')} FROM t WHERE "to" <> {_conventional_sql('"to"')})"""


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
        WITH RECURSIVE {_PAGES}, {_REACHED},
        n AS (SELECT node, least, regexp_extract(node, '^[^/?]*') AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path FROM c),
        v AS (SELECT least, bool_or(said = 'block') AND NOT bool_or(said = 'allow') AS spread FROM (SELECT least, {_rule_sql('host', 'path', 'verdict')} AS said FROM n) WHERE said IS NOT NULL GROUP BY least)
        SELECT page_id, host, path, {_rule_sql('host', 'path', 'name')} AS rule, coalesce({_rule_sql('host', 'path', 'verdict')}, CASE WHEN spread AND host <> '' THEN 'block' END, 'allow') AS verdict
        FROM j LEFT JOIN c ON c.node = j.key LEFT JOIN v ON v.least = c.least""",
    "op4_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        g AS (SELECT doc_id, unnest(s) AS g FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)), {_REACHED}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON c.node = s.doc_id""",
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
}
