import unicodedata
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promoforge.functions import classify, dates, identity, money, offers
from promoforge.functions.text import matches_tokens, normalized, normalized_literal
from promoforge.values import KEYWORD_RULES, TITLE_RULES


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(spark, values, fn, kind="string"):
    return [r.x for r in column(spark, values, kind).select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def python_normalized(value):
    text = unicodedata.normalize("NFKD", value.casefold())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFFF, exclude_categories=("Cs",)), max_size=60), min_size=50, max_size=80))
def test_normalized_equals_definition(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert evaluate(spark, texts, normalized) == [python_normalized(t) for t in texts]
    assert [normalized_literal(t) for t in texts] == [python_normalized(t) for t in texts]


def test_normalized_named_cases(spark):
    texts = ["Würstel  È ß", "½ ﬁne №5 ™", "한국어", "\t a \x1c b c d ", "", "STRASSE ẞ…", "ǅ ℂ"]
    assert evaluate(spark, texts, normalized) == [python_normalized(t) for t in texts]


@pytest.mark.parametrize("text,cents", [
    ("€ 1,99", 199), ("1,99 €", 199), ("1,99 €", 199), ("1.299,00 €", 129900), ("12", 1200), ("１,99 €", 199),
    (None, None), ("-1,99 €", None), ("8,9", None), ("GBP 3,99", None), ("1,99 3,99", None), ("", None)])
def test_money(spark, text, cents):
    assert evaluate(spark, [text], money.money) == [cents]
    assert evaluate(spark, [text], money.money_rejected) == [text is not None and cents is None]


def test_cents(spark):
    assert evaluate(spark, ["3.49", "3.499", "0", "-1", "x", None], money.cents) == [349, None, None, None, None, None]


def priced(spark, raw, amount=349, basis="pack", published=None):
    rows = spark.createDataFrame([(raw, published)], "raw string, published string")
    return offers.with_package_and_price(rows, F.col("raw"), F.lit(amount), F.lit(basis), F.lit("raw"), F.col("published")).first()


@pytest.mark.parametrize("raw,expected", [("500 g", "6.9800"), ("2 × 500 g", "3.4900"), ("2x 500 g confezione", "3.4900")])
def test_unit_price(spark, raw, expected):
    assert priced(spark, raw).price.calculated_unit_price == Decimal(expected)


@pytest.mark.parametrize("raw", ["6 x 400 g/sgocc. 1,44 kg", "serbatoio da 300 ml", "300-500 g", "0 g"])
def test_ambiguous_package(spark, raw):
    row = priced(spark, raw)
    assert row.package.total_quantity is None and row.price.calculated_unit_price is None


def test_price_by_weight_and_printed_price(spark):
    row = priced(spark, "al kg", 799, "kg")
    assert row.price.published_unit_price == Decimal("7.99") and row.price.unit_price_basis == "kg" and row.price.calculated_unit_price is None
    row = priced(spark, "500 g", 349, "pack", "1 l = 6,98 €")
    assert row.price.published_unit_price == Decimal("6.98") and row.price.unit_price_basis == "l"


@pytest.mark.parametrize("day,end", [("2026-03-29", "2026-03-29T22"), ("2026-10-25", "2026-10-25T23"), ("2026-12-31", "2026-12-31T23")])
def test_rome_day_end(spark, day, end):
    seconds = evaluate(spark, [day], lambda c: F.unix_seconds(dates.day_end_exclusive(F.to_date(c))))[0]
    assert datetime.fromtimestamp(seconds, UTC).isoformat().startswith(end)


def test_time_states(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([
        ("2026-01-01", "2026-01-09 23:59:59", "2026-01-10 00:00:00"), ("2026-01-11", None, "2026-01-07 23:00:00"),
        (None, None, "2026-01-08 00:00:00"), ("2026-01-01", None, "2026-01-09 12:00:00"), ("2026-01-01", "2026-01-10 00:00:00", "2026-01-09 11:59:59"),
    ], "s string, e string, v string").select(*[F.col(c).cast("timestamp") for c in "sev"])
    got = rows.select(dates.temporal_status(F.col("s"), F.col("e"), now).alias("t"), dates.freshness(F.col("v"), now).alias("f")).collect()
    assert [tuple(r) for r in got] == [("expired", "fresh"), ("future", "hidden"), ("unknown", "stale"), ("active", "fresh"), ("expired", "stale")]


# Golden pairs of titles and categories.
GOLDEN = [
    ("Petto di pollo", None, "carne"), ("Alimento per gatti con pollo", None, "animali"), ("Uovo di cioccolato", None, "dolci"),
    ("Uova fresche", None, "latticini_uova"), ("Latte detergente", None, "cura_persona"), ("Latte intero", None, "latticini_uova"),
    ("Burger vegetale", None, "piatti_pronti"), ("Gelato al cioccolato", None, "dolci"), ("Biscotti", None, "dolci"),
    ("Patatine in sacchetto", None, "snack_salati"), ("Oggetto ambiguo", None, "altri"), ("Salamini affumicati", None, "salumi"),
    ("Mini toast con prosciutto", None, "piatti_pronti"), ("Aceto di vino bianco", None, "dispensa"),
    ("Focaccia ripiena con mortadella e mozzarella", None, "pane_forno"), ("Pancetta arrotolata", "Carne e pollame", "salumi"),
    ("Stick di salame", "Carne e pollame", "salumi"), ("Latte di cocco BIO", None, "dispensa"), ("Pagnotta ai cereali", None, "pane_forno"),
    ("Pretzel con sale marino", None, "snack_salati"), ("Contorno di patate, carote, zucchine e olive", None, "piatti_pronti"),
    ("W5 Pasta lavamani", None, "cura_persona"), ("Crauti al vino bianco", None, "dispensa"), ("Würstel classico", "Carne e pollame", "salumi"),
    ("Trancino ai 5 cereali", None, "altri"), ("Tortellini al prosciutto crudo", "FRESCO", "pasta_riso_cereali"),
    ("Pure' di patate", "FRESCO", "piatti_pronti"), ("Pampers Baby-Dry Junior", "CURA PERSONA", "infanzia"), ("Ciotola", "PETCARE", "animali"),
    ("Stracchino", "FRESCO", "latticini_uova"), ("I 7 Siciliani Terre Siciliane IGT", "BEVANDE", "bevande"), ("2 Cannoli siciliani", "FRESCO", "dolci"),
    ("Wafer alla vaniglia", "DROGHERIA ALIMENTARE", "dolci"), ("Cordon Bleu di pollo", None, "piatti_pronti"), ("6 Buondì albicocca", None, "dolci"),
    ("Cabernet Franc DOC Collio", None, "bevande"), ("Polpo pulito decongelato", None, "pesce"), ("Detergente per WC", None, "casa_pulizia"),
]


def test_classification_golden(spark):
    rows = spark.createDataFrame(GOLDEN, "title string, original string, want string")
    got = classify.with_classification(rows, F.col("title"), F.col("original")).collect()
    assert [(r.title, r.category_id) for r in got] == [(r.title, r.want) for r in got]


def test_literal_hints_never_hide_a_match(spark):
    """Every text a rule's pattern matches also contains one of its literal starts."""
    import re

    for *_, pattern in [*TITLE_RULES, *KEYWORD_RULES]:
        assert all(classify.literal_starts(pattern))
    texts = [python_normalized(t) for t, *_ in GOLDEN]
    for *_, pattern in [*TITLE_RULES, *KEYWORD_RULES]:
        for text in texts:
            if re.search(pattern, text):
                assert any(start in text for start in classify.literal_starts(pattern))


def test_tags_need_literal_evidence(spark):
    rows = spark.createDataFrame([("Gelato al cioccolato", ""), ("Gelato al cioccolato", "Prodotto surgelato"), ("Riso", "")], "t string, d string")
    assert [r.tags for r in classify.with_classification(rows, F.col("t"), None, F.col("d")).collect()] == [[], ["Surgelato"], []]


def test_identity_and_policy(spark):
    import hashlib

    row = spark.range(1).select(
        identity.identity(F.lit("a"), F.lit(None).cast("string"), identity.flag_text(F.lit(True)), F.lit(7)).alias("id"),
        *[identity.url_allowed(F.lit(u), F.array(F.lit("x.it"))).alias(f"u{i}") for i, u in enumerate(
            ["https://x.it/a", "https://x.it:443/", "http://x.it/", "https://u@x.it/", "https://x.it:8443/", "https://y.it/", "https://x.it.evil/"])]).first()
    assert row.id == hashlib.sha256(b"a|None|True|7").hexdigest()[:32]
    assert list(row)[1:] == [True, True, False, False, False, False, False]


def test_keyword_matching(spark):
    texts = ["latte intero bio", "latteria", "caffe 100 g", ""]
    run = lambda q: evaluate(spark, texts, lambda c: matches_tokens(c, q))
    assert run(["lat"]) == [True, True, False, False]
    assert run(["la"]) == [False] * 4 and run(["g"]) == [False, False, True, False]
    assert run(["bio", "latte"]) == [True, False, False, False] and run([]) == [True] * 4
