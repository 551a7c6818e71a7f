"""Scalar functions over the given tables; texts are rendered from table values first."""

from __future__ import annotations

from pyspark.sql import functions as F

from promoforge.functions import classify, dates, identity, money, offers, periods
from promoforge.functions.text import markup_text, normalized
from promoforge.plans.driver.registry import query
from promoforge.plans.driver.views import LISTINGS_SQL, listings, table, text
from promoforge.values import DIETARY_TAGS, KEYWORD_RULES, SOURCE_CATEGORIES, TITLE_RULES

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEY_SQL = ", ".join(KEYS)
CENTS_SQL = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def cents_of(column):
    return F.round(F.col(column) * 100).cast("bigint")


def italian(cents, thousands=True):
    """Cents as an Italian price text."""
    shown = F.format_number((cents / 100).cast("decimal(20,2)"), 2)
    return F.translate(shown, ",.", ".,") if thousands else F.translate(shown, ".,", ",")


FOLD_SQL = "trim(regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '\\s+', ' ', 'g'))"


@query("normalized_text", f"SELECT doc_id, {FOLD_SQL.format('text')} AS plain FROM documents")
def normalized_text(spark, sf_dir):
    """H1 on whole multilingual texts."""
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("plain"))


@query("terms_digest", f"SELECT doc_id, sha256({FOLD_SQL.format('text')}) AS digest FROM documents")
def terms_digest(spark, sf_dir):
    """Digest of normalised terms."""
    return table(spark, sf_dir, "documents").select("doc_id", identity.terms_digest(F.col("text")).alias("digest"))


@query("money_parse", f"""SELECT {KEY_SQL}, CASE WHEN l_linenumber IN (1, 2, 3) THEN {CENTS_SQL} END AS cents,
  l_linenumber IN (4, 5, 6) AS rejected FROM lineitem""")
def money_parse(spark, sf_dir):
    """H2: three accepted notations, three rejected ones, and no text."""
    li = table(spark, sf_dir, "lineitem")
    c = cents_of("l_extendedprice")
    n = F.col("l_linenumber")
    shown = (
        F.when(n == 1, F.concat(F.lit("€ "), italian(c)))
        .when(n == 2, F.concat(F.lit(" "), italian(c, False), F.lit(" € ")))
        .when(n == 3, F.translate(italian(c), "0123456789", "０１２３４５６７８９"))
        .when(n == 4, F.concat(F.lit("-"), italian(c), F.lit(" €")))
        .when(n == 5, F.concat(F.lit("GBP "), italian(c)))
        .when(n == 6, F.concat(F.substring_index(italian(c), ",", 1), F.lit(",9")))
    )
    return li.withColumn("shown", shown).select(
        *KEYS, money.money(F.col("shown")).alias("cents"), money.money_rejected(F.col("shown")).alias("rejected")
    )


@query("cents_exact", f"""SELECT {KEY_SQL},
  CASE WHEN l_linenumber IN (1, 2, 3) AND {CENTS_SQL} > 0 THEN {CENTS_SQL} END AS cents FROM lineitem""")
def cents_exact(spark, sf_dir):
    """H3: whole positive cents only; tenths of a cent, zero, negatives and words are refused."""
    n, c = F.col("l_linenumber"), cents_of("l_extendedprice")
    plain = (c / 100).cast("decimal(20,2)").cast("string")
    number = (
        F.when(n <= 3, plain).when(n == 4, F.concat(plain, F.lit("5"))).when(n == 5, F.concat(F.lit("-"), plain))
        .when(n == 6, F.lit("0")).otherwise(F.lit("n.d."))
    )
    return table(spark, sf_dir, "lineitem").withColumn("number", number).select(
        *KEYS, money.cents(F.col("number")).alias("cents"))


@query("unit_price", f"""WITH {LISTINGS_SQL}, parts AS (
  SELECT *, CAST(l_quantity AS HUGEINT) * 10 + CASE WHEN l_linenumber = 4 THEN 5 ELSE 0 END AS tenths,
         CASE l_linenumber WHEN 1 THEN 'g' WHEN 2 THEN 'kg' WHEN 3 THEN 'ml' WHEN 4 THEN 'l' END AS unit,
         CASE WHEN l_linenumber = 2 THEN 1 ELSE p_size END AS units FROM listings),
totals AS (SELECT *, CASE WHEN unit IN ('g', 'ml') THEN tenths * units ELSE tenths * units * 1000 END AS q FROM parts)
SELECT {KEY_SQL}, unit, CAST(CASE WHEN unit IS NOT NULL THEN tenths * units END AS BIGINT) AS total_tenths,
  CAST(CASE WHEN unit IS NOT NULL THEN (2 * amount_cents::HUGEINT * 1000000 + q) // (2 * q)
            WHEN l_linenumber = 7 THEN amount_cents * 100 END AS BIGINT) AS unit_price_e4,
  CASE WHEN unit IN ('g', 'kg') OR l_linenumber = 7 THEN 'kg' WHEN unit IN ('ml', 'l') THEN 'l' END AS base
FROM totals""")
def unit_price(spark, sf_dir):
    """H9: packages in four units, an ambiguous one, a range, and a price by weight."""
    n, q, size = F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.col("p_size")
    raw = (
        F.when(n == 1, text(size, " x ", q, " g confezione")).when(n == 2, text(q, "kg"))
        .when(n == 3, text(size, "×", q, " ML")).when(n == 4, text(size, " X ", q, ",5 l"))
        .when(n == 5, text(size, " x ", q, " g/sgocc. 1,44 kg")).when(n == 6, text(size, "-", q, " g"))
        .otherwise(F.lit("al kg"))
    )
    rows = listings(spark, sf_dir).withColumn("raw", raw)
    rows = offers.with_package_and_price(
        rows, F.col("raw"), F.col("amount_cents"), F.when(n == 7, "kg").otherwise("pack"), F.lit("")
    )
    unit_price = F.coalesce("price.calculated_unit_price", "price.published_unit_price")
    return rows.select(
        *KEYS, F.col("package.quantity_unit").alias("unit"),
        (F.col("package.total_quantity") * 10).cast("bigint").alias("total_tenths"),
        (unit_price * 10000).cast("bigint").alias("unit_price_e4"), F.col("price.unit_price_basis").alias("base"),
    )


@query("published_unit_price", f"""WITH {LISTINGS_SQL}
SELECT {KEY_SQL}, CASE WHEN l_linenumber <= 4 THEN amount_cents END AS published_cents,
  CASE WHEN l_linenumber <= 4 THEN CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'l' END END AS base FROM listings""")
def published_unit_price(spark, sf_dir):
    """H9: two printed notations of a unit price, and two that name no base."""
    n = F.col("l_linenumber")
    base = F.when(F.col("p_size") % 2 == 0, "kg").otherwise("l")
    shown = italian(F.col("amount_cents"), False)
    printed = (
        F.when(n <= 2, F.concat(F.lit("1 "), base, F.lit(" = "), F.replace(shown, F.lit(","), F.lit(".")), F.lit(" €")))
        .when(n <= 4, F.concat(shown, F.lit(" €/"), base)).when(n == 5, F.concat(shown, F.lit(" €"))).otherwise(F.lit("6 €/kg"))
    )
    rows = listings(spark, sf_dir).withColumn("printed", printed)
    stated = money.published_price(F.col("printed"))
    return rows.select(*KEYS, (stated["amount"] * 100).cast("bigint").alias("published_cents"), stated["base"].alias("base"))


# Product titles that reach every kind of rule; a part takes one by its key.
TITLES = (
    "Petto di pollo", "Alimento per gatti con pollo", "Uovo di cioccolato", "Uova fresche", "Latte detergente",
    "Latte intero", "Burger vegetale", "Gelato al cioccolato", "Biscotti", "Patatine in sacchetto", "Oggetto ambiguo",
    "Salamini affumicati", "Mini toast con prosciutto", "Aceto di vino bianco", "Latte di cocco BIO", "Würstel classico",
    "Trancino ai 5 cereali", "Tortellini al prosciutto crudo", "Purè di patate", "Pampers Baby-Dry Junior", "Stracchino",
    "Trofie", "PURINA GOURMET Mon Petit", "Cordon Bleu di pollo", "Cornetti di mais al formaggio", "6 Buondì albicocca",
    "Detergente per WC", "Affettati misti di tacchino", "Kebab di seitan vegetale", "Scarpe da ginnastica",
)
SOURCE_SEGMENTS = ("CARNI", "FRESCO/PETCARE", "Frutta/Verdura", "FRESCO", "Dolci/FRESCO", "BEVANDE/CURA CASA/x")


def title_sql() -> str:
    values = ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES)
    segments = ", ".join(f"'{s}'" for s in SOURCE_SEGMENTS)
    return f"""titles AS (SELECT {KEY_SQL}, ([{values}])[l_partkey % {len(TITLES)} + 1] AS title,
  CASE WHEN l_suppkey % 3 > 0 THEN ([{segments}])[l_suppkey % {len(SOURCE_SEGMENTS)} + 1] END AS original,
  CASE WHEN l_linenumber = 1 THEN 'Prodotto surgelato, senza Glutine' WHEN l_linenumber = 2 THEN 'da agricoltura BIOLOGICA e biologico'
       ELSE '' END AS description FROM lineitem),
folded AS (SELECT *, {FOLD_SQL.format('title')} AS t,
  {FOLD_SQL.format("title || ' ' || coalesce(original, '') || ' ' || description")} AS e FROM titles)"""


def classify_sql() -> str:
    def quoted(pattern):
        return pattern.replace("'", "''")

    rules = "\n".join(f"WHEN regexp_matches(t, '{quoted(p)}') THEN '{i}|{c}|specific_rule'" for i, c, p in TITLE_RULES)
    keywords = "\n".join(f"WHEN regexp_matches(t, '{p}') THEN 'keyword-{c}|{c}|generic_rule'" for c, p in KEYWORD_RULES)
    exact = ", ".join(f"'{k}': '{v}'" for k, v in SOURCE_CATEGORIES.items())
    known = f"list_filter(list_transform(string_split(coalesce(original, ''), '/'), lambda s: (MAP {{{exact}}})[s]), lambda c: c IS NOT NULL)"
    tags = " || ".join(f"CASE WHEN contains(e, '{w}') THEN '{t};' ELSE '' END" for w, t in DIETARY_TAGS)
    return f"""WITH {title_sql()}, decided AS (SELECT *, CASE {rules}
WHEN len({known}) > 0 THEN 'source-category|' || ({known})[-1] || '|exact_mapping'
{keywords} ELSE 'fallback|altri|unclassified' END AS d FROM folded)
SELECT {KEY_SQL}, string_split(d, '|')[2] AS category_id, string_split(d, '|')[1] AS rule_id,
       string_split(d, '|')[3] AS level, {tags} AS tags FROM decided"""


def titled(spark, sf_dir):
    segments = F.get(F.array(*map(F.lit, SOURCE_SEGMENTS)), (F.col("l_suppkey") % len(SOURCE_SEGMENTS)).cast("int"))
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        *KEYS, F.get(F.array(*map(F.lit, TITLES)), (F.col("l_partkey") % len(TITLES)).cast("int")).alias("title"),
        F.when(F.col("l_suppkey") % 3 > 0, segments).alias("original"),
        F.when(n == 1, "Prodotto surgelato, senza Glutine").when(n == 2, "da agricoltura BIOLOGICA e biologico")
        .otherwise("").alias("description"),
    )


@query("classify_titles", classify_sql())
def classify_titles(spark, sf_dir):
    """H7, H8: rule, source mapping or keyword, and literal dietary tags."""
    rows = classify.with_classification(
        titled(spark, sf_dir), F.col("title"), F.col("original"), F.col("description"))
    return rows.select(
        *KEYS, "category_id", F.col("category_rule_id").alias("rule_id"), F.col("classification_level").alias("level"),
        F.concat(F.array_join("tags", ";"), F.when(F.size("tags") > 0, ";").otherwise("")).alias("tags"),
    )


@query("identity_hash", f"""WITH {LISTINGS_SQL}
SELECT {KEY_SQL}, sha256(source_id || '|' || campaign_id || '|' || title || '|' || coalesce(CASE WHEN p_size > 25 THEN raw_package END, 'None')
  || '|' || CASE loyalty_required WHEN true THEN 'True' WHEN false THEN 'False' ELSE 'None' END)[1:32] AS id FROM listings""")
def identity_hash(spark, sf_dir):
    """H6: absent parts and booleans keep their written form."""
    return listings(spark, sf_dir).select(*KEYS, identity.identity(
        F.col("source_id"), F.col("campaign_id"), F.col("title"),
        F.when(F.col("p_size") > 25, F.col("raw_package")), identity.flag_text(F.col("loyalty_required")),
    ).alias("id"))


@query("rome_day_end", """SELECT o_orderkey,
  CAST(epoch(timezone('Europe/Rome', CAST(o_orderdate AS TIMESTAMP))) AS BIGINT) AS start_s,
  CAST(epoch(timezone('Europe/Rome', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY)) AS BIGINT) AS end_s,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def rome_day_end(spark, sf_dir):
    """H4, H5, and back from the instant to the day."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_seconds(dates.day_start(day)).alias("start_s"),
        F.unix_seconds(dates.day_end_exclusive(day)).alias("end_s"),
        dates.rome_day(dates.day_start(day)).cast("string").alias("day"),
    )


@query("period_parse", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_day,
  CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)), '%Y-%m-%d') END AS end_day
FROM orders""")
def period_parse(spark, sf_dir):
    """Month names, inferred start years, unknown months."""
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 60).cast("int"))
    key = F.col("o_orderkey")
    same_or_next = F.when((key % 2 == 0), text(F.year(start), " ")).otherwise("")
    start_month = F.when(key % 13 > 0, periods.month_name(F.month(start))).otherwise("brumaio")
    end_month = F.when(key % 7 > 0, F.initcap(periods.month_name(F.month(end)))).otherwise("nevoso")
    heading = text("Offerte valide Dal ", F.dayofmonth(start), " ", start_month, " ", same_or_next, "al ",
                   F.dayofmonth(end), "  ", end_month, " ", F.year(end))
    rows = table(spark, sf_dir, "orders").withColumn("heading", heading)
    rows = periods.with_heading_period(rows, "heading", "start", "end")
    # Without a known end month the start year cannot be inferred, only read.
    read = F.when((key % 7 > 0) | (key % 2 == 0), F.col("start")).otherwise(F.to_date("o_orderdate"))
    return rows.select(
        "o_orderkey", F.when(key % 13 > 0, read).cast("string").alias("start_day"),
        F.col("end").cast("string").alias("end_day"))


@query("full_date_period", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_day,
  CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 9 > 0 THEN strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') END AS end_day FROM orders""")
def full_date_period(spark, sf_dir):
    """Fully printed dates; a trailing remark or a thirteenth month is not a date."""
    start, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.date_format(F.date_add(start, 14), "dd.MM.yyyy")
    printed = text("Offerte valide dal ", F.date_format(start, "dd.MM.yyyy"), " al ",
                   F.when(key % 9 > 0, end).otherwise(F.concat(F.lit("01.13."), F.substring(end, 7, 4))),
                   F.when(key % 5 > 0, "").otherwise(" circa"))
    rows = table(spark, sf_dir, "orders").withColumn("printed", printed)
    period = periods.full_date_period(F.col("printed"))
    return rows.select("o_orderkey", period["start"].cast("string").alias("start_day"),
                       period["end"].cast("string").alias("end_day"))


@query("printed_period", f"""SELECT o_orderkey, o_orderkey % 4 = 0 OR (o_orderkey % 4 = 3 AND month(o_orderdate) = month(o_orderdate + INTERVAL 13 DAY)) AS confirmed FROM orders""")
def printed_period(spark, sf_dir):
    """A footer must state the campaign and no printed range may disagree."""
    start, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.date_add(start, 13)

    def month(day):
        return F.upper(periods.month_name(F.month(day)))

    footer = text("OFFERTA VALIDA DA GIOVEDÌ ", F.dayofmonth(start), " ", month(start), " A MERCOLEDÌ ",
                  F.dayofmonth(end), " ", month(end), " ", F.year(end))
    short = text("Offerta valida da giovedì ", F.dayofmonth(start), " a mercoledì ", F.dayofmonth(end), " ", month(end),
                 " ", F.year(end))
    good = text(" dal ", F.dayofmonth(start), " ", month(start), " al ", F.dayofmonth(end), " ", month(end))
    other = text(" solo dal ", F.dayofmonth(start), " ", month(start), " al ",
                 F.dayofmonth(F.date_add(end, -2)), " ", month(F.date_add(end, -2)))
    page = (
        F.when(key % 4 == 0, F.concat(footer, good)).when(key % 4 == 1, F.concat(footer, other))
        .when(key % 4 == 2, good).otherwise(short)
    )
    rows = table(spark, sf_dir, "orders").withColumn("page", normalized(page))
    return rows.select("o_orderkey", F.coalesce(periods.page_states_campaign(F.col("page"), start, end), F.lit(False)).alias("confirmed"))


@query("epoch_parse", """SELECT event_id, epoch_us(ts) // 1000000 AS second_s, epoch_us(ts) // 1000 AS milli_ms,
  strftime(ts, '%Y-%m-%d') AS compact_day, (epoch_us(ts) // 60000000) * 60 AS minute_s FROM events""")
def epoch_parse(spark, sf_dir):
    """Seconds, milliseconds, compact and ISO notations of one instant."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(ts).alias("s"), F.unix_millis(ts).alias("ms"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("compact"),
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
        .otherwise(F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00"))).alias("iso"),
    )
    return rows.select(
        "event_id", F.unix_seconds(dates.epoch_seconds(F.col("s"))).alias("second_s"),
        F.unix_millis(dates.epoch_millis(F.col("ms"))).alias("milli_ms"),
        dates.compact_date(F.col("compact")).cast("string").alias("compact_day"),
        F.unix_seconds(dates.iso_instant(F.col("iso"))).alias("minute_s"),
    )


BASE_TEXTS = ("Al  Kg", "1 KG", "al litro", "Cadauno", "cad.", "AL PZ.", "500 g", "al metro")


@query("base_detection", f"""SELECT {KEY_SQL},
  (['kg', 'kg', 'l', 'piece', 'piece'])[l_partkey % 8 + 1] AS attribute_base,
  (['kg', NULL, 'l'])[l_partkey % 8 + 1] AS card_base,
  (['kg', NULL, 'l', NULL, NULL, 'pack'])[l_partkey % 8 + 1] AS paged_base FROM lineitem""")
def base_detection(spark, sf_dir):
    """The same texts read by three profiles."""
    raw = F.get(F.array(*map(F.lit, BASE_TEXTS)), (F.col("l_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumn("plain", normalized(raw))
    plain = F.col("plain")
    return rows.select(
        *KEYS, offers.base_from(offers.ATTRIBUTE_BASES, plain).alias("attribute_base"),
        offers.base_from(offers.CARD_BASES, plain).alias("card_base"),
        offers.base_from(offers.PAGED_BASES, plain).alias("paged_base"))


@query("price_consistency", f"""WITH {LISTINGS_SQL}
SELECT {KEY_SQL}, CAST(round(l_discount * 100) AS INTEGER) <= CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 1 END AS agrees,
  CASE WHEN loyalty_required THEN amount_cents - 100 ELSE amount_cents END AS applied_cents FROM listings""")
def price_consistency(spark, sf_dir):
    """Tolerance by printed basis, and the price of the mechanic that applies."""
    rows = listings(spark, sf_dir)
    calculated = (F.col("amount_cents") / 100).cast("decimal(18,4)")
    published = (calculated + F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    tolerance = F.when(F.col("l_linenumber") % 2 == 0, F.lit("0.10")).otherwise(F.lit("0.01")).cast("decimal(4,2)")
    return rows.select(
        *KEYS, offers.unit_prices_agree(published, calculated, tolerance).alias("agrees"),
        offers.applicable_price(F.col("loyalty_required"), F.col("amount_cents") - 100, F.col("amount_cents")).alias("applied_cents"))


@query("unit_price_suppression", f"""WITH {LISTINGS_SQL}
SELECT {KEY_SQL}, basis = 'pack' AND l_linenumber % 2 = 1 AS calculated,
  CASE WHEN basis IN ('kg', 'l') AND l_linenumber % 2 = 1 THEN basis WHEN basis = 'pack' AND l_linenumber % 2 = 1 THEN 'kg' END AS base,
  'unknown' AS quantity_basis FROM listings""")
def unit_price_suppression(spark, sf_dir):
    """No unit price where the weight is not documented."""
    rows = listings(spark, sf_dir)
    rows = offers.with_package_and_price(
        rows, F.col("raw_package"), F.col("amount_cents"), F.col("basis"), F.lit(""))
    rows = rows.withColumns({
        "package": offers.undocumented_weight(F.col("package")),
        "price": offers.without_unit_price(F.col("price"), F.col("l_linenumber") % 2 == 0)})
    return rows.select(*KEYS, F.col("price.calculated_unit_price").isNotNull().alias("calculated"),
                       F.col("price.unit_price_basis").alias("base"), "package.quantity_basis")


@query("conditions_fill", f"""WITH {LISTINGS_SQL}
SELECT {KEY_SQL}, 'partial' AS status, coalesce(loyalty_required, l_linenumber > 3) AS loyalty_required,
  coalesce(minimum_pack_count, p_size) AS minimum_pack_count,
  concat_ws(' ', CASE WHEN loyalty_required THEN 'Solo con carta.' END,
    CASE WHEN l_discount > 0.04 THEN 'Spesa minima ' || CAST(p_size AS VARCHAR) || '.00 €.' END,
    'Altre condizioni non integralmente verificate.') AS raw_text FROM listings""")
def conditions_fill(spark, sf_dir):
    """Facts an earlier version knew survive; absent facts leave no sentence."""
    raw = offers.sentence(
        (F.col("loyalty_required"), "Solo con carta."),
        (F.col("l_discount") > 0.04, text("Spesa minima ", money.euro_text(F.col("p_size") * 100), " €.")),
        (F.lit(True), "Altre condizioni non integralmente verificate."),
    )
    new = offers.conditions(status="partial", loyalty_required=F.col("loyalty_required"),
                            minimum_pack_count=F.col("minimum_pack_count"), raw_text=raw)
    old = offers.conditions(status="unknown", loyalty_required=F.col("l_linenumber") > 3,
                            minimum_pack_count=F.col("p_size"), raw_text="vecchio testo")
    rows = listings(spark, sf_dir).withColumns({"new": new, "old": old})
    rows = rows.withColumn("merged", offers.fill_conditions(F.col("new"), F.col("old")))
    return rows.select(*KEYS, "merged.status", "merged.loyalty_required", "merged.minimum_pack_count", "merged.raw_text")


@query("url_policy", """WITH urls AS (SELECT page_id, url,
  regexp_extract(url, '^([a-z]+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 2) AS host,
  contains(url, '#') AS has_fragment FROM pages)
SELECT page_id, scheme = 'https' AND ends_with(host, '.org') AND page_id % 5 IN (0, 1, 2) AS allowed,
  scheme = 'https' AND ends_with(host, '.org') AND page_id % 5 IN (0, 1, 2) AND NOT has_fragment AS allowed_strict FROM urls""")
def url_policy(spark, sf_dir):
    """Ports and user info are added to some page addresses first."""
    bare = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    kind = F.col("page_id") % 5
    authority = (
        F.when(kind == 1, F.concat(bare, F.lit(":443"))).when(kind == 3, F.concat(bare, F.lit(":8443")))
        .when(kind == 4, F.concat(F.lit("user:pw@"), bare)).otherwise(bare)
    )
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(F.col("url"), "^([a-z]+://)[^/?#]+", "$1\u0001").alias("shell"),
        authority.alias("authority"), F.when(F.endswith(bare, F.lit(".org")), F.array(bare)).otherwise(F.array(F.lit("other.example"))).alias("hosts"))
    url = F.replace(F.col("shell"), F.lit("\u0001"), F.col("authority"))
    return rows.select("page_id", identity.url_allowed(url, F.col("hosts")).alias("allowed"),
                       identity.url_allowed(url, F.col("hosts"), allow_fragment=False).alias("allowed_strict"))


@query("page_title", """SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
  CAST(epoch(make_timestamp(2024, 1, 1, 0, 0, 0)) AS BIGINT) + page_id AS fetched_s FROM pages""")
def page_title(spark, sf_dir):
    """Text of a page's heading."""
    return table(spark, sf_dir, "pages").select(
        "page_id", markup_text(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("title"),
        (F.lit(1704067200) + F.col("page_id")).alias("fetched_s"))


@query("json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    """Typed access to nested product documents."""
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))
