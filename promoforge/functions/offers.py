"""Parts of an offer: package, price, conditions, and their cross checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.functions.money import euro_text, package_parts, published_price, unit_base, unit_price
from promoforge.functions.text import ascii_digits, strip_space, text_map
from promoforge.schemas import CONDITIONS, EVIDENCE, QUANTITY, UNIT_PRICE



def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def with_package_and_price(
    rows: DataFrame, raw: Column, amount: Column, basis: Column, raw_price: Column,
    published: Column | None = None,
) -> DataFrame:
    """Add the ``package`` and ``price`` structs of an advertised amount.

    The package is understood only if its text is a quantity and nothing else. A pack price
    then gets a calculated unit price; a printed unit price overrides the base; a price per
    kilogram or litre is its own unit price. Steps are separate columns, so every pattern is
    evaluated once per row.
    """
    col = F.col
    stated_text = _null("string") if published is None else published
    rows = rows.withColumns({
        "_pp_raw": raw, "_pp_amount": amount, "_pp_basis": basis, "_pp_raw_price": raw_price,
        "_pp_clean": ascii_digits(strip_space(raw)), "_pp_stated": ascii_digits(strip_space(stated_text)),
    })
    parts, stated = package_parts(col("_pp_clean")), published_price(col("_pp_stated"))
    rows = rows.withColumns({
        "_pp_units": parts["units"], "_pp_quantity": parts["quantity"], "_pp_unit": parts["unit"],
        "_pp_stated_amount": stated["amount"], "_pp_stated_base": stated["base"],
    })
    rows = rows.withColumn("_pp_total", (col("_pp_quantity") * col("_pp_units").cast("decimal(12,0)")).cast("decimal(36,9)"))
    rows = rows.withColumn("_pp_known", F.coalesce(col("_pp_total") > 0, F.lit(False)))
    rows = rows.withColumn("_pp_calculable", col("_pp_known") & (col("_pp_basis") == "pack"))
    rows = rows.withColumn(
        "_pp_calculated", F.when(col("_pp_calculable"), unit_price(col("_pp_amount"), col("_pp_total"), col("_pp_unit")))
    )

    def known(column: str) -> Column:
        return F.when(col("_pp_known"), col(column))

    package = F.struct(
        F.nullif(col("_pp_raw"), F.lit("")).alias("raw_text"),
        known("_pp_units").alias("units_in_pack"),
        known("_pp_quantity").alias("quantity_per_unit"),
        known("_pp_unit").alias("quantity_unit"),
        known("_pp_total").cast(QUANTITY).alias("total_quantity"),
        F.when(col("_pp_known"), "net").otherwise("unknown").alias("quantity_basis"),
    )
    calculation = F.when(
        col("_pp_calculable"),
        F.concat(euro_text(col("_pp_amount")), F.lit(" € per "), col("_pp_raw"), F.lit(" → "),
                 col("_pp_calculated").cast("string"), F.lit(" €/"), unit_base(col("_pp_unit")),
                 F.lit(" (calcolato dall’app)")),
    )
    sold_by_base = col("_pp_basis").isin("kg", "l")
    own_price = (col("_pp_amount").cast("decimal(16,0)") / 100).cast(UNIT_PRICE)
    price = F.struct(
        F.lit("EUR").alias("currency"),
        col("_pp_amount").cast("bigint").alias("advertised_amount_cents"),
        col("_pp_basis").alias("basis"),
        col("_pp_raw_price").alias("raw_text"),
        F.when(sold_by_base, own_price)
        .otherwise(F.when(col("_pp_stated_base").isNotNull(), col("_pp_stated_amount"))).alias("published_unit_price"),
        col("_pp_calculated").alias("calculated_unit_price"),
        F.when(sold_by_base, col("_pp_basis"))
        .otherwise(F.coalesce("_pp_stated_base", F.when(col("_pp_calculable"), unit_base(col("_pp_unit")))))
        .alias("unit_price_basis"),
        calculation.alias("calculation"),
        _null("bigint").alias("previous_amount_cents"),
    )
    return rows.withColumns({"package": package, "price": price}).drop(
        "_pp_raw", "_pp_amount", "_pp_basis", "_pp_raw_price", "_pp_clean", "_pp_stated", "_pp_units", "_pp_quantity", "_pp_unit",
        "_pp_stated_amount", "_pp_stated_base", "_pp_total", "_pp_known", "_pp_calculable", "_pp_calculated",
    )


def undocumented_weight(package: Column) -> Column:
    """Package whose net or drained basis the source does not state."""
    return package.withField("quantity_basis", F.lit("unknown"))


def without_unit_price(price: Column, when: Column, keep_base: Column | None = None) -> Column:
    """Drop a calculated unit price that rests on an undocumented weight."""
    keep = F.lit(False) if keep_base is None else keep_base
    blank = (
        price.withField("calculated_unit_price", _null("decimal(18,4)"))
        .withField("calculation", _null("string"))
        .withField("unit_price_basis", F.when(keep, price["unit_price_basis"]))
    )
    return F.when(when, blank).otherwise(price)


# Printed sales bases per profile, on normalised text unless noted.
ATTRIBUTE_BASES = {
    "al kg": "kg", "1 kg": "kg", "kg": "kg", "al litro": "l", "al pezzo": "piece", "pezzo": "piece",
    "cadauno": "piece", "cad.": "piece",
}
CARD_BASES = {"al kg": "kg", "al litro": "l"}
PAGED_BASES = {"al pz.": "pack", "al kg": "kg", "al litro": "l"}


def base_from(table: dict[str, str], text: Column) -> Column:
    """Sales base named by a text, null if the profile does not know it."""
    return text_map(table)[text]


def unit_prices_agree(published: Column, calculated: Column, tolerance: Column) -> Column:
    return F.abs(published - calculated) <= tolerance


def applicable_price(loyalty: Column, loyalty_price: Column, normal_price: Column) -> Column:
    """The price of the mechanic that applies, never simply the cheaper one."""
    return F.when(loyalty, loyalty_price).otherwise(normal_price)


def conditions(**fields: Column | str | bool | None) -> Column:
    """Conditions struct; what is not given stays unknown."""
    values = []
    for f in CONDITIONS.fields:
        value = fields.get(f.name, "unknown" if f.name == "status" else None)
        value = value if isinstance(value, Column) else F.lit(value)
        values.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*values)


def evidence(**fields: Column) -> Column:
    """Evidence struct; what a profile does not record stays null."""
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVIDENCE.fields
    ])


def fill_conditions(new: Column, old: Column) -> Column:
    """Keep what an earlier version knew and the new one leaves open, field by field."""
    return F.struct(*[F.coalesce(new[f.name], old[f.name]).alias(f.name) for f in CONDITIONS.fields])


def sentence(*parts: tuple[Column, Column | str]) -> Column:
    """Join the parts whose fact holds, in order, with blanks."""
    texts = [F.when(fact, F.lit(part) if isinstance(part, str) else part) for fact, part in parts]
    return F.concat_ws(" ", *texts)


def validity(start: Column, end: Column, raw: Column, explicit: bool = True) -> Column:
    return F.struct(
        F.lit("Europe/Rome").alias("timezone"), start.alias("start_at"), end.alias("end_at_exclusive"),
        raw.alias("raw_text"), F.lit("explicit_dates" if explicit else "unknown").alias("evidence_level"),
    )
