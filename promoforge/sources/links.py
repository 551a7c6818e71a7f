"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.functions.text import bound, markup_text, unescape

_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
_ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?(?=</a\s*>|<a\b|$)"""
_HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*)$"""
_TAG = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>"""
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def visible_markup(html: Column) -> Column:
    """The page without comments and script, style and template bodies."""
    return F.regexp_replace(html, _HIDDEN, " ")


def without_dots(url: Column) -> Column:
    """An absolute URL with the dot segments of its path removed, however many there are."""
    origin = F.regexp_extract(url, _ORIGIN, 1)
    path = F.regexp_extract(url, _ORIGIN + "([^?#]*)", 2)
    rest = F.regexp_extract(url, _ORIGIN + "[^?#]*(.*)$", 2)
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)

    def step(kept: Column, segment: Column) -> Column:
        return (F.when(segment == ".", kept).when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .otherwise(F.array_append(kept, segment)))

    # A dot segment at the end leaves a folder.
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    folded = F.aggregate(closed, F.array().cast("array<string>"), step)
    return F.when(F.rlike(path, F.lit(r"(?:^|/)\.\.?(?:/|$)")), F.concat(origin, F.lit("/"), F.array_join(folded, "/"), rest)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a reference, with dot segments removed from its path."""
    origin = F.regexp_extract(base, _ORIGIN, 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.rlike(page, F.lit(_ORIGIN + "/")), F.regexp_replace(page, "/[^/]*$", "/")).otherwise(
        F.concat(page, F.lit("/"))
    )
    joined = without_dots(F.concat(folder, href))
    return (
        F.when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), without_dots(F.concat(origin, href)))
        .when(href == "", page)
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(joined)
    )


def anchors(html: Column) -> Column:
    """Array of ``(href, text)`` in page order."""
    found = F.regexp_extract_all(visible_markup(html), F.lit(_ANCHOR), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(
            unescape(F.concat(F.regexp_extract(a, _HREF, 1), F.regexp_extract(a, _HREF, 2))).alias("href"),
            markup_text(F.regexp_extract(a, _HREF, 3)).alias("text"),
        ),
    )


def hrefs(html: Column) -> Column:
    """References of the anchors in page order, without reading what the anchors say."""
    tags = F.regexp_extract_all(visible_markup(html), F.lit(_TAG), F.lit(0))
    return F.transform(tags, lambda tag: bound(F.concat(F.regexp_extract(tag, _TAG, 1), F.regexp_extract(tag, _TAG, 2)), unescape))


def extract_links(pages: DataFrame, html: str = "body", url: str = "url", keep=None) -> DataFrame:
    """One row per distinct link of a page with its position among them; ``keep`` filters.

    Order-preserving and within the page, so there is no shuffle.
    """
    links = F.transform(F.array_distinct(hrefs(F.col(html))), lambda href: resolve(F.col(url), href))
    links = F.array_distinct(links)
    if keep is not None:
        links = F.filter(links, keep)
    columns = [c for c in pages.columns if c not in (html, url)]
    # The outer form: for the inner one Spark would evaluate the links once more in a filter.
    return pages.select(*columns, F.posexplode_outer(links).alias("pos", "link")).where(F.col("pos").isNotNull())
