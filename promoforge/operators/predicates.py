"""Row predicates of search, vouchers and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.functions.dates import freshness, temporal_status
from promoforge.functions.text import matches_tokens, normalized
from promoforge.values import HIDDEN_SECONDS, PRODUCT_TYPES

TRISTATE = {"required": True, "not_required": False, "unknown": None}


def with_time_states(offers: DataFrame, now: Column) -> DataFrame:
    """Add ``temporal_status`` and ``freshness`` as of ``now``."""
    return offers.withColumns({
        "temporal_status": temporal_status(F.col("validity.start_at"), F.col("validity.end_at_exclusive"), now),
        "freshness": freshness(F.col("last_verified_at"), now),
    })


def visible_at(now: Column) -> Column:
    """Not withdrawn, not quarantined, verified within 48 hours, not over.

    Says "not hidden and not expired" on the stored columns, so it reaches the Parquet scan.
    """
    end = F.col("validity.end_at_exclusive")
    return (
        ~F.col("withdrawn")
        & (F.col("quality") != "quarantined")
        & (F.col("last_verified_at") >= now - F.expr(f"INTERVAL {HIDDEN_SECONDS} SECONDS"))
        & (end.isNull() | (end > now))
    )


def is_product() -> Column:
    return F.coalesce(F.col("offer_type"), F.lit("product_offer")).isin(*PRODUCT_TYPES)


def is_voucher() -> Column:
    return F.col("benefit").isNotNull()


def loyalty_is(choice: str) -> Column:
    """Tri-state loyalty: ``unknown`` matches null only, never false."""
    if choice == "all":
        return F.lit(True)
    return F.col("conditions.loyalty_required").eqNullSafe(F.lit(TRISTATE[choice]).cast("boolean"))


def minimum_quantity_is(choice: str) -> Column:
    count = F.col("conditions.minimum_pack_count")
    return {
        "all": F.lit(True),
        "required": F.coalesce(count >= 2, F.lit(False)),
        "not_required": F.coalesce(count == 1, F.lit(False)),
        "unknown": count.isNull(),
    }[choice]


def price_is_comparable(basis: str) -> Column:
    """Same basis and no minimum above one pack."""
    count = F.col("conditions.minimum_pack_count")
    return (F.col("price.basis") == basis) & (count.isNull() | (count <= 1))


def period_of(status: Column) -> Column:
    """Facet period: future, or current for active and unknown."""
    return F.when(status == "future", "future").otherwise("current")


def validity_is(choice: str) -> Column:
    return {
        "all": F.lit(True),
        "current": F.col("temporal_status") != "future",
        "future": F.col("temporal_status") == "future",
    }[choice]


def keyword_match(tokens: list[str]) -> Column:
    searchable = normalized(F.concat_ws(" ", F.col("title"), F.coalesce(F.col("brand"), F.lit(""))))
    return matches_tokens(searchable, tokens)


def public_projection(offers: DataFrame, now: Column) -> DataFrame:
    """What a reader may see: time states added, the private capture reference dropped."""
    return with_time_states(offers, now).withColumn(
        "evidence", F.when(F.col("evidence").isNotNull(), F.col("evidence").dropFields("capture_id"))
    )


def find_offer(catalog: DataFrame, offer_id: Column | str, now: Column) -> DataFrame:
    """Point lookup: quarantined rows are not found, expired and withdrawn ones are, flagged."""
    wanted = F.lit(offer_id) if isinstance(offer_id, str) else offer_id
    return public_projection(
        catalog.where((F.col("id") == wanted) & (F.col("quality") != "quarantined")), now
    )


def current_vouchers(catalog: DataFrame, now: Column) -> DataFrame:
    """Vouchers that can be used now, first to end first; the earning window may be over."""
    rows = public_projection(catalog.where(is_voucher() & visible_at(now)), now).where(
        F.col("temporal_status") != "future"
    )
    ended = F.col("benefit.earning_validity.end_at_exclusive") <= now
    return rows.withColumn("earning_ended", F.coalesce(ended, F.lit(False)))


def voucher_order() -> list[Column]:
    return [F.asc_nulls_last("validity.end_at_exclusive"), F.asc("id")]
