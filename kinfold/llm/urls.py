"""URL filters whose block decisions travel along redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import components
from kinfold.runtime import join_hot, materialize

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = F.regexp_replace(found, r"(?is)^[a-z-]+\s*=\s*", "")
    return F.nullif(F.trim(F.regexp_replace(bare, r"""^["']|["']$""", "")), F.lit(""))


def link_targets(html: Column) -> Column:
    """Targets of canonical links and refresh redirects, as written in the page."""
    tags = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def target(tag: Column) -> Column:
        canonical = F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)") & tag.rlike("(?i)^<link")
        refresh = (F.lower(_attribute(tag, "http-equiv")) == "refresh") & tag.rlike("(?i)^<meta")
        to = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, F.nullif(F.trim(to), F.lit("")))

    return F.array_compact(F.transform(tags, target))


def absolute(target: Column, url: Column) -> Column:
    """target against the page's url: absolute, scheme-relative, from the root, or beside the page."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, target)).otherwise(F.concat(folder, target))


def node_of(url: Column) -> Column:
    """Long key of an address: host, path and query; scheme and fragment don't tell pages apart."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), path_of(url), query))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), by_alias.

    A page's own rule decides. A page without one takes the decision of its aliases, the addresses that redirects
    and canonical links join it to over any number of steps, also those that aren't in the table: allow if a rule
    allows one of them, else block if a rule blocks one, else allow. by_alias tells the pages that aliases decide.

    Null urls and those without :// have empty host and path, no rule and no aliases; null html has no links.
    Repeated rows are kept. An empty table gives no rows. Other columns aren't read.
    """
    raw = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = raw.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"), "url")
    own = own.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    rows = materialize(own.select("page_id", "host", "path", "node", "own"), "pages")

    links = raw.filter("url IS NOT NULL").select("url", F.explode(link_targets(F.col("html"))).alias("to"))
    links = links.select("url", absolute(F.col("to"), F.col("url")).alias("to"))
    verdict = lambda url: rule_for(host_of(url), path_of(url), rules)["verdict"]
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"), verdict(F.col("url")).alias("va"), verdict(F.col("to")).alias("vb"))
    edges = materialize(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")

    roots = components(edges)
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("va").alias("v")), F.struct(F.col("b").alias("node"), F.col("vb").alias("v")))))
    ends = ends.groupBy("node").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    members = materialize(roots.join(ends, "node"), "members")
    sizes = members.groupBy("root").agg(F.max("allow").alias("allow"), F.max("block").alias("block"), F.count("*").alias("n"))
    told = sizes.select("root", "n", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("alias_verdict"))
    known = materialize(join_hot(members.select("node", "root"), materialize(told, "told"), "root", "inner").select("node", "alias_verdict").filter("alias_verdict IS NOT NULL"), "known")
    counted = rows.groupBy("node").agg(F.count("*").alias("n")).join(known, "node")
    out = join_hot(rows, materialize(counted, "counted"), "node", "left", total=rows.count())
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
        (F.col("own").isNull() & F.col("alias_verdict").isNotNull()).alias("by_alias"),
    )
