"""Links that a store's own page has to confirm before a catalog or a voucher behind it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoforge.functions.text import normalized
from promoforge.sources.links import resolve
from promoforge.sources.markup import Node, read_cards, text_of

# Where catalogs and vouchers lie, and how a catalog code is written.
CATALOG_HOST = "https://service-volantino.mdspa.it/"
CATALOG_CODE = "^[a-z0-9_]{1,80}$"
VOUCHER_FOLDER = "https://www.coopalleanza3-0.it/volantino/promozione/featured/"
VOUCHER_SLUG = "spendi-riprendi-scuola.html"


def _read_catalog(page: Node):
    scope = page.first(id="go_back")
    code = page.first(**{"data-flyer": True, "data-flyer-code": True})
    return {"p_scope": text_of(scope) if scope is not None else None, "p_code": code.attrs["data-flyer-code"] if code is not None else None}, []


def catalog_links(captures: DataFrame) -> DataFrame:
    """``link`` of each store page to its catalog, or the ``reason`` why there is none: the page is another store's, or it has no catalog code."""
    rows = read_cards(captures, _read_catalog, ["p_scope", "p_code"], [])
    scope = F.coalesce(normalized(F.col("p_scope")) == normalized(F.col("scope_label")), F.lit(False))
    code = F.coalesce(F.rlike("p_code", F.lit(CATALOG_CODE)), F.lit(False))
    return rows.select("capture_id", "source_id", "url", F.when(scope & code, F.concat(F.lit(CATALOG_HOST), "p_code")).alias("link"),
                       F.when(~scope, "scope").when(~code, "catalog_link").alias("reason"))


def _read_voucher_links(page: Node):
    canonical = page.first("link", rel="canonical")
    # Line breaks separate references; inside one they are no part of it.
    hrefs = ["".join(a.attrs["href"].split("\n")) for a in page.all("a", href=True)]
    return {"p_canonical": canonical.attrs.get("href") if canonical is not None else None, "p_links": "\n".join(hrefs)}, []


def voucher_links(captures: DataFrame) -> DataFrame:
    """``link`` of each store page to its voucher, or the ``reason``: the page is not the store's own, or does not link to the voucher any more."""
    rows = read_cards(captures, _read_voucher_links, ["p_canonical", "p_links"], [])
    path = F.regexp_replace(F.regexp_extract("entry_url", "([^/]*)$", 1), r"\.html$", "")
    expected = F.concat(F.lit(VOUCHER_FOLDER), path, F.lit("/" + VOUCHER_SLUG))
    own = F.coalesce(F.col("p_canonical") == F.col("entry_url"), F.lit(False))
    linked = F.exists(F.split("p_links", "\n"), lambda href: resolve(F.col("entry_url"), href) == expected)
    return rows.select("capture_id", "source_id", "url", F.when(own & linked, expected).alias("link"), F.when(~own, "canonical").when(~linked, "voucher_link").alias("reason"))
