"""Faceted offer search: one request, one filtered plan, facets and a page from it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.functions.text import normalized_literal
from promoforge.operators import predicates as P
from promoforge.operators.facets import facet_counts
from promoforge.operators.predicates import with_time_states
from promoforge.operators.ranking import after_key, order_columns, page
from promoforge.sources.catalog import CatalogStore
from promoforge.sources.postings import Postings
from promoforge.values import CATEGORIES, MAX_TARGETS

_CHOICES = {
    "validity": ("current", "future", "all"),
    "loyalty": ("all", "required", "not_required", "unknown"),
    "minimum_quantity": ("all", "required", "not_required", "unknown"),
    "sort": ("relevance", "recent", "expiry", "price"),
    "price_basis": (None, "pack", "kg", "l", "piece"),
}


@dataclass(frozen=True)
class SearchRequest:
    """Arguments of a search. ``targets=None`` searches every source."""

    now: datetime
    targets: tuple[str, ...] | None = None
    query: str = ""
    category_ids: tuple[str, ...] = ()
    retailer_ids: tuple[str, ...] = ()
    validity: str = "current"
    loyalty: str = "all"
    minimum_quantity: str = "all"
    sort: str = "recent"
    price_basis: str | None = None
    limit: int = 24
    offset: int = 0
    require_live: bool = False
    after: dict | None = field(default=None, hash=False)

    def __post_init__(self):
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.targets is not None:
            unique = tuple(sorted(set(self.targets)))
            if not 1 <= len(unique) <= MAX_TARGETS:
                raise ValueError(f"between 1 and {MAX_TARGETS} targets")
            object.__setattr__(self, "targets", unique)
        known = {c for c, _ in CATEGORIES}
        if not set(self.category_ids) <= known:
            raise ValueError("unknown category")
        if self.sort == "price" and self.price_basis is None:
            raise ValueError("a price order needs a price basis")
        if not 1 <= self.limit <= 100 or self.offset < 0 or len(self.query) > 120:
            raise ValueError("page or query out of bounds")

    @property
    def now_column(self) -> Column:
        aware = self.now if self.now.tzinfo else self.now.replace(tzinfo=UTC)
        return F.lit(aware)

    @property
    def tokens(self) -> list[str]:
        return normalized_literal(self.query).split()


def candidates(catalog: DataFrame, request: SearchRequest) -> DataFrame:
    """Rows all facets are counted on: everything but the category and validity choices.

    Cheap conditions on stored columns come first and reach the scan; keyword matching is last.
    """
    condition = F.lit(True) if request.targets is None else F.col("source_id").isin(*request.targets)
    condition = condition & P.visible_at(request.now_column) & P.is_product()
    if request.require_live:
        condition = condition & (F.col("data_origin") == "official_live")
    if request.retailer_ids:
        condition = condition & F.col("retailer_id").isin(*request.retailer_ids)
    condition = condition & P.loyalty_is(request.loyalty) & P.minimum_quantity_is(request.minimum_quantity)
    if request.sort == "price":
        condition = condition & P.price_is_comparable(request.price_basis)
    rows = P.with_time_states(catalog.where(condition), request.now_column)
    return rows.where(P.keyword_match(request.tokens)) if request.tokens else rows


def facets(catalog: DataFrame, request: SearchRequest) -> DataFrame:
    return facet_counts(candidates(catalog, request), request.validity, request.category_ids)


def selected(catalog: DataFrame, request: SearchRequest) -> DataFrame:
    rows = candidates(catalog, request).where(P.validity_is(request.validity))
    if request.category_ids:
        rows = rows.where(F.col("category_id").isin(*request.category_ids))
    return rows


def result_page(catalog: DataFrame, request: SearchRequest) -> DataFrame:
    """The requested page with ``rank`` and ``has_more``."""
    rows = selected(catalog, request)
    if request.after is not None:
        rows = rows.where(after_key(request.sort, request.after))
    return page(rows, order_columns(request.sort, request.query), request.limit, request.offset)


def stored_offers(store: CatalogStore, request: SearchRequest, postings: Postings | None = None) -> DataFrame:
    """What a search of a stored catalog has to read: the shards of its targets, and with ``postings`` only the offers of its tokens."""
    if postings is not None and request.tokens:
        return postings.offers(request.tokens, request.targets)
    return store.read(request.targets)


def stored_page(store: CatalogStore, request: SearchRequest, postings: Postings | None = None) -> DataFrame:
    """:func:`result_page` of a stored catalog, fetched late: first the keys of the page from the columns that filter and order, then its rows.

    The keys of a page (at most ``limit``) go to the driver and come back as conditions on the sorted columns of the store, so the
    wide columns are read only where the page's offers lie.
    """
    keys = result_page(stored_offers(store, request, postings), request).select("source_id", "id", "rank", "has_more").collect()
    ranks = store.spark.createDataFrame(keys, "source_id string, id string, rank int, has_more boolean")
    rows = store.read(sorted({k.source_id for k in keys})).where(F.col("id").isin(*[k.id for k in keys]))
    # A page has at most as many rows as a request may ask for.
    return with_time_states(rows.join(F.broadcast(ranks), ["source_id", "id"]), request.now_column)
