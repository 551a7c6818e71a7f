"""Prices in integer cents, packages and comparable unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promoforge.functions.text import SPACE, price_text
from promoforge.schemas import QUANTITY, UNIT_PRICE

# The accepted price and package notations.
PRICE_PATTERN = rf"^(?:€{SPACE}*)?((?:[0-9]{{1,3}}(?:\.[0-9]{{3}})+|[0-9]+)(?:,[0-9]{{2}})?)(?:{SPACE}*€)?$"
PACKAGE_PATTERN = (
    rf"(?iu)^(?:([0-9]+){SPACE}*[x×]{SPACE}*)?([0-9]+(?:[.,][0-9]+)?){SPACE}*(kg|g|ml|l)"
    rf"(?:{SPACE}*(?:confezione|sacchetto|vasetto|bottiglia|rete))?$"
)
PUBLISHED_PATTERN = rf"^(?:1{SPACE}*(kg|l){SPACE}*={SPACE}*)?([0-9]+[.,][0-9]+){SPACE}*€(?:/(kg|l))?$"


def money(text: Column) -> Column:
    """Cents of a printed euro amount; null for null and for anything not fully understood."""
    number = F.nullif(F.regexp_extract(price_text(text), PRICE_PATTERN, 1), F.lit(""))
    plain = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (plain.try_cast("decimal(18,2)") * 100).cast("bigint")


def money_rejected(text: Column) -> Column:
    """True where a price text is present but not understood."""
    return text.isNotNull() & money(text).isNull()


def cents(number: Column) -> Column:
    """Exact positive cents of a decimal number or its text; null if not exact or not positive."""
    value = number.try_cast("decimal(30,12)") * 100
    return F.when((value > 0) & (value == F.floor(value)), value.try_cast("bigint"))


def euro_text(amount_cents: Column) -> Column:
    """``349`` as ``3.49``."""
    return (amount_cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def whole_quotient(top: Column, bottom: Column) -> Column:
    """Integer quotient of two non-negative whole decimals."""
    return F.call_function("div", top, bottom)


def package_parts(clean: Column) -> dict[str, Column]:
    """Units, quantity and unit of a package text that is a quantity and nothing else.

    ``clean`` is the text trimmed and with ASCII digits; parts are null where it is not one.
    """
    units = F.nullif(F.regexp_extract(clean, PACKAGE_PATTERN, 1), F.lit(""))
    quantity = F.replace(F.regexp_extract(clean, PACKAGE_PATTERN, 2), F.lit(","), F.lit("."))
    return {
        "units": F.coalesce(units, F.lit("1")).try_cast("bigint"),
        "quantity": F.nullif(quantity, F.lit("")).try_cast(QUANTITY),
        "unit": F.nullif(F.lower(F.regexp_extract(clean, PACKAGE_PATTERN, 3)), F.lit("")),
    }


def unit_price(amount_cents: Column, total: Column, unit: Column) -> Column:
    """Euro per kilogram or litre, four places, half up.

    Done in whole numbers so no intermediate rounding can tip a half: with q the quantity in
    10^-12 base units the result in 10^-4 euro is (2·a·10^14 + q) div 2q.
    """
    q = F.when(unit.isin("g", "ml"), total * F.lit(10**9)).otherwise(total * F.lit(10**12))
    q = q.cast("decimal(36,0)")
    top = amount_cents.cast("decimal(18,0)") * F.lit(2 * 10**14).cast("decimal(16,0)") + q
    return (whole_quotient(top, q * F.lit(2)).cast("decimal(22,0)") / 10000).cast(UNIT_PRICE)


def unit_base(unit: Column) -> Column:
    return F.when(unit.isin("g", "kg"), "kg").when(unit.isin("ml", "l"), "l")


def published_price(clean: Column) -> dict[str, Column]:
    """A printed unit price ``1 kg = 6.98 €`` or ``6,98 €/kg``: amount and base."""
    base = F.nullif(
        F.concat(F.regexp_extract(clean, PUBLISHED_PATTERN, 1), F.regexp_extract(clean, PUBLISHED_PATTERN, 3)),
        F.lit(""),
    )
    amount = F.replace(F.regexp_extract(clean, PUBLISHED_PATTERN, 2), F.lit(","), F.lit("."))
    return {"amount": F.when(base.isNotNull(), F.nullif(amount, F.lit("")).try_cast(UNIT_PRICE)), "base": base}
