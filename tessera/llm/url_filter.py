"""URL filters with redirect equivalence.

Explicit rules (host suffix and path prefix, the longest wins) decide what they fit. Pages that no rule fits take the
decision of their equivalence class: connected components over redirect and canonical-link edges, which come from
rel=canonical links, meta refreshes, an optional table of observed redirects, and the redirects that sites serve by
convention (fragment, `www.`, default port, trailing slash, index page and tracking parameters lead to one address).
Rules are held against every address of a class, also those that are only linked to and aren't among the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid|sessionid)(=|$)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(name, verdict) of the longest rule that fits, of equal ones an allow; else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resource(url: Column) -> Column:
    """A url's identity: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(after_scheme(url), "^[^#]*", 0)
    host = F.translate(F.regexp_extract(rest, "^[^/?]*", 0), UPPER, LOWER)
    return F.concat(host, F.regexp_extract(rest, "^[^/?]*(.*)", 1))


def conventional(key: Column) -> Column:
    """Where a resource leads by convention."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(key, "^[^/?]*", 0), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(key, r"^[^/?]*([^?]*)", 1), r"/(index\.(html?|php))?$", "")
    params = F.filter(F.split(F.regexp_extract(key, r"^[^?]*\?(.*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolved(href: Column, key: Column) -> Column:
    """The resource that a link on page `key` leads to; null for an empty link."""
    href = F.trim(href)
    host = F.regexp_extract(key, "^[^/?]*", 0)
    folder = F.regexp_extract(key, r"^([^/?]*(?:/[^?/]*)*/)[^?/]*", 1)
    plain = F.regexp_extract(href, "^[^#]*", 0)
    return (
        F.when(href.contains("://"), resource(href))
        .when(href.startswith("//"), resource(F.concat(F.lit("x:"), href)))
        .when(href.startswith("/"), F.concat(host, plain))
        .when(plain != "", F.concat(F.when(folder != "", folder).otherwise(F.concat(host, F.lit("/"))), plain))
    )


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)


def declared_links(html: Column) -> Column:
    """Array of the canonical link's and the meta refresh's targets, empty strings where there is none."""
    link = F.regexp_extract(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    target = F.regexp_extract(refresh, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    return F.array(_attribute(link, "href"), target)


def url_filter(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, component (of its resource).

    Host and path are empty for a null url or one without `://`; such pages have no links and are allowed. The verdict is
    the fitting rule's. Without one it is `block` when a rule blocks an address of the page's class, crawled or not, and
    none allows one (explicit allow has precedence over a propagated block), else `allow`. Null html declares no links. Repeated
    rows each get their row; an empty table gives an empty table; other columns are not read. redirects: optional
    (src, dst) urls."""
    html = F.coalesce(F.col(html_col), F.lit("")) if html_col else F.lit("")
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), resource(url).alias("key"), declared_links(html).alias("links"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    judged = materialize(judged.select("page_id", "host", "path", "key", F.md5("key").alias("node"), "links", F.col("best.name").alias("rule"), F.col("best.verdict").alias("said")), "judged")

    linked = judged.where("host != ''").select("key", F.explode(F.array_union(F.array(conventional(F.col("key"))), F.array_compact(F.transform("links", lambda h: resolved(h, F.col("key")))))).alias("to"))
    if redirects is not None:
        linked = linked.unionAll(redirects.select(resource(F.col("src")).alias("key"), resource(F.col("dst")).alias("to")))
    # A target's own conventional address joins it to pages that reach it in another form.
    linked = materialize(linked.unionAll(linked.select(F.col("to").alias("key"), conventional(F.col("to")).alias("to"))).where("key != to").distinct(), "linked")
    components = materialize(connected_components(linked.select(F.md5("key").alias("a"), F.md5("to").alias("b"))), "components")

    address = F.concat(F.lit("x://"), F.col("key"))
    ends = linked.select("key").unionAll(linked.select(F.col("to").alias("key"))).distinct()
    ruled = ends.select(F.md5("key").alias("node"), best_rule(host_of(address), path_of(address), rules)["verdict"].alias("said")).where("said is not null")
    said = ruled.join(components, "node").groupBy("component").agg(F.bool_or(F.col("said") == "block").alias("blocked"), F.bool_or(F.col("said") == "allow").alias("allowed"))
    spread = said.where("blocked and not allowed").select(F.col("component").alias("__class"), F.lit(True).alias("spread"))
    # A page without edges is alone in its class, and its own rule is all that is said there.
    classes = components.join(spread, F.col("component") == F.col("__class"), "left").select("node", "component", "spread")
    verdict = F.coalesce("said", F.when(F.col("spread") & (F.col("host") != ""), "block"), F.lit("allow"))
    return judged.join(classes, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))
