"""Admission rules: every failed rule is recorded, the first one is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*rules: tuple[str, Column]) -> Column:
    """Array of the names of failed rules, in rule order. A null condition counts as a pass."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules]))


def admit(rows: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Split rows into accepted (without the reasons) and quarantined (with them)."""
    accepted = rows.where(F.size(column) == 0).drop(column)
    return accepted, rows.where(F.size(column) > 0)


def first_reason(column: str | Column = "reasons") -> Column:
    array = F.col(column) if isinstance(column, str) else column
    return F.get(array, F.lit(0))


def mentions(text_normalized: Column, fragments) -> Column:
    """True where the normalised text contains any of the fragments."""
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(text_normalized, F.lit(fragment))
    return found


def economic_kind_ok(offer_type: Column, price: Column, benefit: Column) -> Column:
    """Products carry a price and no benefit, every other kind the reverse."""
    product = F.coalesce(offer_type, F.lit("product_offer")).isin("product_offer", "product_coupon")
    return F.when(product, price.isNotNull() & benefit.isNull()).otherwise(
        price.isNull() & benefit.isNotNull()
    )


# What the enumerated fields of an offer may hold.
CHOICES = {
    "data_origin": ("official_live", "synthetic_fixture"),
    "offer_type": ("product_offer", "product_coupon", "basket_coupon", "future_voucher", "loyalty_benefit"),
    "classification_level": ("exact_mapping", "specific_rule", "generic_rule", "unclassified"),
    "quality": ("publishable", "limited", "quarantined"),
    "package.quantity_basis": ("net", "drained", "unknown"),
    "conditions.status": ("complete", "partial", "unknown"),
    "validity.timezone": ("Europe/Rome",),
    "validity.evidence_level": ("explicit_dates", "unknown"),
}
# Those of a price or benefit that is there.
PRICE_CHOICES = {"price.currency": ("EUR",), "price.basis": ("pack", "kg", "l", "piece", "bundle", "from", "unknown"), "benefit.currency": ("EUR",)}
# These may be null.
OPTIONAL_CHOICES = {"package.quantity_unit": ("g", "kg", "ml", "l"), "price.unit_price_basis": ("kg", "l")}
REQUIRED = ("id", "retailer_id", "source_id", "campaign_id", "target_ids", "title_normalized", "category_id", "category_rule_id", "classification_version", "package", "conditions",
            "validity", "scope", "source_url", "evidence", "parser_version", "first_seen_at", "last_seen_at", "last_verified_at")
TITLE_LENGTH = 500


def shape_reasons() -> Column:
    """What keeps a row from being an offer at all: missing fields, values outside their choices, a title or amounts out of range."""
    def outside(field: str, allowed: tuple[str, ...]) -> Column:
        return F.coalesce(~F.col(field).isin(*allowed), F.lit(True))

    def not_positive(field: str) -> Column:
        return F.coalesce(F.col(field) <= 0, F.lit(True))

    price, benefit = F.col("price").isNotNull(), F.col("benefit").isNotNull()
    title = F.char_length("title")
    counts = ("amount_cents", "earning_minimum_spend_cents", "redemption_minimum_spend_cents", "maximum_vouchers_per_receipt", "maximum_discount_cents")
    return reasons(
        *[(f, F.col(f).isNull()) for f in REQUIRED],
        ("title", F.coalesce((title < 1) | (title > TITLE_LENGTH), F.lit(True))),
        *[(f, outside(f, allowed)) for f, allowed in CHOICES.items()],
        *[(f, (price if f.startswith("price") else benefit) & outside(f, allowed)) for f, allowed in PRICE_CHOICES.items()],
        *[(f, F.col(f).isNotNull() & outside(f, allowed)) for f, allowed in OPTIONAL_CHOICES.items()],
        ("price.advertised_amount_cents", price & not_positive("price.advertised_amount_cents")),
        ("price.raw_text", price & F.col("price.raw_text").isNull()),
        *[(f"benefit.{f}", benefit & not_positive(f"benefit.{f}")) for f in counts],
    )
