"""URL filters with redirect equivalence.

Rules allow or block a host with its subdomains under a path; the longest rule that fits a url decides. Urls are aliases if
they differ only in scheme, a leading ``www.`` or ``m.``, the fragment, tracking parameters, dot segments or slashes at the end of the path, or if a redirect (a
refresh in the page, or a given edge) or a canonical link leads from one to the other. Connected components over these edges carry decisions to
aliases: a url without a rule of its own is allowed if its component holds an allowed url, else blocked if it holds a blocked
one, else allowed. An explicit rule always has precedence for its own url.

Only built-in column functions and joins. The rules are joined on host suffixes, so a block list may be a large table; which side is
broadcast is left to Spark.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule and no aliases, and are allowed; of equal rules that
both allow and block, allow holds; repeated pages get equal verdicts; references to other schemes (``mailto:``) make no edge; empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoforge.functions.text import unescape
from promoforge.llm.common import BLANKS, ascii_lower, let
from promoforge.llm.components import connected_components
from promoforge.session import written_once
from promoforge.sources.links import resolve, visible_markup, without_dots

TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)="
# Tags that may say where a page is to be found, with quoted values taken whole.
_TAGS = r"""(?i)<(?:link|meta|base)(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*+>"""
_REFRESH_URL = r"""(?is)^[\s\d.]*[;,]?\s*(?:url\s*=\s*)?["']?\s*(.*?)\s*["']?$"""


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty without it.

    Attributes are read one after the other, so what stands in another's value is none.
    """
    before = r"""(?is)^<[a-z]+(?:[\s/]+(?!NAME[\s=/>])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+[\s/]+NAME\s*=\s*"""
    value = F.regexp_extract(tag, before.replace("NAME", name) + r"""("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.btrim(value, F.lit("\"'"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.when(url.isNull() | ~url.contains("://"), F.lit("")).otherwise(
        F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """What aliases by spelling have in common; null for what is no url."""
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    host = F.regexp_replace(host_of(url), "^(www|m)\\.", "")
    # Dot segments are resolved only where there are some.
    path = F.when(path_of(url).rlike(r"/\.\.?(?:/|$)"), path_of(without_dots(url))).otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): refreshes and canonical links that the pages themselves state, outside comments, scripts, styles and templates.

    References are resolved against the page's ``base``, else against its url.
    """
    page = F.col(html_col)
    stating = pages.where(F.col(url_col).isNotNull() & page.rlike("(?i)canonical|refresh"))
    tags = stating.select(F.col(url_col).alias("src"), F.regexp_extract_all(visible_markup(page), F.lit(_TAGS), F.lit(0)).alias("tags"))
    base = F.coalesce(F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base\s.*?href\s*=")), F.lit(0)), F.lit(""))
    read = tags.select("src", F.explode("tags").alias("tag"), base.alias("base_tag")).select(
        "src", attribute(F.col("base_tag"), "href").alias("base"), *[attribute(F.col("tag"), n).alias(n) for n in ("rel", "href", "http-equiv", "content")])
    canonical = F.exists(F.split(F.lower("rel"), f"[{BLANKS}]+"), lambda r: r == "canonical")
    refresh = F.lower("http-equiv") == "refresh"
    links = read.select("src", "base", F.when(canonical, F.col("href")).when(refresh, F.col("content")).alias("raw"), (refresh & ~canonical).alias("refresh")).where("raw <> ''")

    # References are decoded and resolved once, as bound values: both are large expressions.
    def decoded(raw: Column, refresh: Column) -> Column:
        return let(F.btrim(unescape(raw), F.lit(BLANKS)), lambda v: F.when(refresh, F.regexp_extract(v, _REFRESH_URL, 1)).otherwise(v))

    base = F.when(F.col("base") == "", F.col("src")).otherwise(let(decoded(F.col("base"), F.lit(False)), lambda v: resolve(F.col("src"), v)))
    target = let(decoded(F.col("raw"), F.col("refresh")), lambda v: F.when(v != "", let(base, lambda b: resolve(b, v))))
    return links.select("src", target.alias("dst")).where(F.col("dst").contains("://"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for the distinct ``urls`` (column url) that a rule fits: the longest one."""
    suffixes = let(F.split("host", "\\."), lambda labels: F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    asked = parts.select("url", "path", F.explode(suffixes).alias("host"))
    stated = rules.select(F.col("host"), F.col("path").alias("under"), F.concat("host", "path").alias("rule"), "verdict")
    fits = asked.join(stated, "host").where(F.col("path").startswith(F.col("under")))
    best = F.struct(F.length("rule").alias("length"), "rule", (F.col("verdict") == "allow").alias("allow"))
    return fits.groupBy("url").agg(F.max(best).alias("best")).select("url", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict and ``component``. ``rules`` has verdict, host, path; ``edges`` may add known redirects (src, dst)."""
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    links = page_edges(given)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst").where("src is not null and dst is not null"))
    links = written_once(links.distinct(), "url-links")
    urls = given.select("url").unionByName(links.select(F.col("src").alias("url"))).unionByName(links.select(F.col("dst").alias("url"))).distinct()
    urls = written_once(urls.where("url is not null").select("url", alias_key(F.col("url")).alias("key")), "urls")
    ruled = written_once(fitting_rules(urls.select("url"), rules), "url-rules")
    groups = connected_components(links.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")))
    placed = urls.where("key is not null").join(groups, urls["key"] == groups["node"], "left").select("url", F.coalesce("component", "key").alias("component"))
    placed = written_once(placed, "url-components")
    spread = placed.join(ruled, "url").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    spread = spread.select(F.col("component").alias("sc"), F.when(F.col("allowed"), "allow").otherwise("block").alias("carried"))
    known = placed.join(spread, F.col("component") == F.col("sc"), "left").join(ruled, "url", "left").select(
        F.col("url").alias("ku"), "component", "rule", F.coalesce("verdict", "carried", F.lit("allow")).alias("verdict"))
    found = given.select("id", "url").join(written_once(known, "url-verdicts"), F.col("url") == F.col("ku"), "left")
    return found.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component")
