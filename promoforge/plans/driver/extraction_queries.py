"""Extraction profiles on pages that Spark renders from the orders table, and on the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from promoforge.functions.dates import day_start
from promoforge.functions.quality import first_reason
from promoforge.plans.driver.registry import query
from promoforge.plans.driver.views import now, table, text
from promoforge.sources.embedded import (
    array_products,
    attribute_products,
    campaigns_from_attribute,
    campaigns_from_state,
)
from promoforge.sources.links import extract_links
from promoforge.sources.profile import page_parts
from promoforge.values import ARRAY_MECHANICS

SITE = "https://www.shop.example"


@query("page_links", """WITH hrefs AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, unnest(h) AS href, generate_subscripts(h, 1) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<a href="([^"]*)"', 1) AS h FROM pages)),
links AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS link, min(pos) AS first FROM hrefs GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, link FROM links""")
def page_links(spark, sf_dir):
    """Distinct links of every given page, in order."""
    pages = table(spark, sf_dir, "pages")
    return extract_links(pages, "html").select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


def escaped(column):
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(char), F.lit(entity))
    return column


def capture(orders, body, **facts):
    """Rendered pages in the shape of captures joined with their manifests."""
    manifest = {
        "retailer_id": F.lit("ret-1"), "scope_type": F.lit("store"), "scope_label": F.lit("Negozio di prova"),
        "parser_version": F.lit("1"), "store_id": F.lit("77"), "entry_url": F.lit(f"{SITE}/"),
        "campaign_title_suffix": F.lit("Superstore"), "max_documents": F.lit(2).cast("bigint"), **facts}
    manifest.setdefault("url", text(SITE, "/c/", F.col("o_orderkey")))
    return orders.select(
        "o_orderkey", "o_orderdate",
        F.col("o_orderkey").cast("string").alias("capture_id"), F.lit("src-1").alias("source_id"),
        now().alias("fetched_at"), body.alias("body"), *[c.alias(n) for n, c in manifest.items()])


def day():
    return F.to_date("o_orderdate")


def dotted(date, form="d/M"):
    return F.date_format(date, form)


# Variant v of a rendered product; the reason expected for it stands next to it in the SQL.
def attribute_pages(spark, sf_dir):
    key = F.col("o_orderkey")
    start, end = day_start(F.date_sub(day(), 3)), day_start(F.date_add(day(), 7))

    def node(i):
        v = (key + i) % 16
        price = F.when(v == 8, F.lit("3.495")).otherwise(((key % 900 + i + 100) / 100).cast("decimal(10,2)").cast("string"))
        packaging = F.struct(F.when(v == 13, "al kg").when(v == 9, "").otherwise("2 x 500 g").alias("text"))
        money = F.struct(
            price.cast("decimal(12,3)").alias("price"), F.when(v == 7, "USD").otherwise("EUR").alias("currencyCode"),
            F.when(v == 6, F.lit(True)).alias("variantsHaveDifferentPrices"), packaging.alias("packaging"))
        plain = v != 2
        regional = F.struct(
            F.when(v == 5, F.lit("0.50").cast("decimal(12,3)")).otherwise(price.cast("decimal(12,3)")).alias("price"),
            F.date_format(F.to_utc_timestamp(end, F.current_timezone()), "yyyy-MM-dd'T'HH:mm'Z'").alias("endDateExclusive"))
        region = F.struct(
            F.when(plain & (v != 3), regional).alias("currentPrice"),
            F.when(~plain | (v == 3), F.struct(regional.alias("price"))).alias("currentLidlPlusPrice"))
        plus = F.struct(money.alias("price"), F.lit("Con carta").alias("lidlPlusText"))
        doc = F.struct(
            F.when(v == 10, "Àcme").otherwise(F.concat(F.lit("Petto di pollo "), i.cast("string"))).alias("fullTitle"),
            F.when(v == 10, F.lit("Cavolo rosso")).alias("title"), (key * 10 + i).alias("productId"),
            text("/p/prodotto/p", key).alias("canonicalUrl"), (v == 0).alias("online"),
            F.when(v != 12, F.unix_seconds(start)).alias("storeStartDate"), (F.unix_seconds(end) - 1).alias("storeEndDate"),
            F.when(plain & (v != 3), money).alias("price"),
            F.when(v == 4, F.create_map(F.lit("1"), region, F.lit("2"), region)).otherwise(F.create_map(F.lit("1"), region)).alias("regionsPrices"),
            F.when(v == 2, F.array(plus)).when(v == 3, F.array(plus, plus)).alias("lidlPlus"),
            F.struct(F.lit("Carne e pollame").alias("wonCategoryPrimary"),
                     F.when(v == 11, "<p>Promo <b>3x2</b></p>").otherwise("<p>Prodotto surgelato</p>").alias("description")).alias("keyfacts"),
            F.struct(F.lit("ACME").alias("name"), F.lit(True).alias("showBrand")).alias("brand"),
            F.struct(F.struct(F.array(F.struct(F.when(v == 1, "ONLINE").otherwise("IN_STORE_RANGE").alias("type"))).alias("badges"))
                     .alias("badgeInfo")).alias("stockAvailability"))
        return F.concat(F.lit("<div class='x' data-grid-data=\""), escaped(F.to_json(doc)), F.lit("\"></div>\n"))

    nodes = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), key % 4), node), "")
    link = text('<a class="n" href="', F.when(key % 9 == 0, "/c/altro").otherwise(text("/c/", key)), '?x=1">dal <b>', dotted(day()), "</b> in poi</a>")
    body = F.concat(F.lit("<html><!-- <a href='/c/1'>1/1</a> -->"), link, F.when(key % 10 == 3, "").otherwise(nodes), F.lit("</html>"))
    return capture(table(spark, sf_dir, "orders"), body)


ATTRIBUTE_SQL = """nodes AS (
  SELECT o_orderkey, i AS idx, (o_orderkey + i) % 16 AS v, o_orderkey % 900 + i + 100 AS cents, o_orderdate
  FROM orders, generate_series(0, o_orderkey % 4) t(i) WHERE o_orderkey % 10 <> 3),
judged AS (SELECT *, CASE WHEN v IN (0, 1) THEN 'channel' WHEN v = 3 THEN 'several_mechanics' WHEN v = 4 THEN 'regions' WHEN v = 5 THEN 'regional_price'
  WHEN v = 6 THEN 'variable_price' WHEN v = 7 THEN 'currency' WHEN v = 8 THEN 'price' WHEN v = 9 THEN 'basis' WHEN v = 11 THEN 'mechanics'
  WHEN v = 12 THEN 'start' WHEN o_orderkey % 9 = 0 THEN 'campaign_unknown' END AS reason FROM nodes)"""


@query("attribute_products", f"""WITH {ATTRIBUTE_SQL}
SELECT o_orderkey, idx, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN v = 10 THEN 'Cavolo rosso' ELSE 'Petto di pollo ' || idx END END AS title,
  CASE WHEN reason IS NULL THEN cents END AS cents,
  CASE WHEN reason IS NULL THEN CASE WHEN v = 13 THEN 'kg' ELSE 'pack' END END AS basis,
  CASE WHEN reason IS NULL THEN cents * 100 END AS unit_price_e4,
  CASE WHEN reason IS NULL AND v = 2 THEN true END AS loyalty,
  CASE WHEN reason IS NULL THEN CAST(epoch(timezone('Europe/Rome', CAST(o_orderdate AS TIMESTAMP))) AS BIGINT) END AS start_s,
  CASE WHEN reason IS NULL THEN CAST(epoch(timezone('Europe/Rome', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 DAY)) AS BIGINT) END AS end_s,
  CASE WHEN reason IS NULL THEN CASE WHEN v = 10 THEN 'carne|source-category|Surgelato' ELSE 'carne|source-category|Surgelato' END END AS class
FROM judged UNION ALL SELECT o_orderkey, NULL, 'page_without_products', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 = 3""")
def attribute_products_query(spark, sf_dir):
    """One document per product, sixteen kinds of them, and pages without any."""
    return judged(attribute_products(attribute_pages(spark, sf_dir)))


def judged(extracted, *more):
    """Items with their deciding reason; values of accepted ones only."""
    good = F.size("reasons") == 0

    def value(column):
        return F.when(good, column)

    unit = F.coalesce("price.calculated_unit_price", "price.published_unit_price")
    return extracted.select(
        F.col("capture_id").cast("bigint").alias("o_orderkey"), F.col("idx").cast("bigint").alias("idx"), first_reason().alias("reason"),
        value(F.col("title")).alias("title"), value(F.col("price.advertised_amount_cents")).alias("cents"),
        value(F.col("price.basis")).alias("basis"), value((unit * 10000).cast("bigint")).alias("unit_price_e4"),
        value(F.col("conditions.loyalty_required")).alias("loyalty"), value(F.unix_seconds("validity.start_at")).alias("start_s"),
        value(F.unix_seconds("validity.end_at_exclusive")).alias("end_s"),
        value(F.concat_ws("|", "category_id", "category_rule_id", F.array_join("tags", ";"))).alias("class"), *more)


@query("page_outcomes", f"""WITH {ATTRIBUTE_SQL}
SELECT o_orderkey, count(v) AS extracted, count(reason) AS quarantined, count(v) - count(reason) AS accepted, count(v) = count(reason) AS failed,
  CASE WHEN count(reason) = 0 THEN 'complete' ELSE 'partial' END AS completeness
FROM orders LEFT JOIN judged USING (o_orderkey) GROUP BY o_orderkey""")
def page_outcomes(spark, sf_dir):
    """What each page gave, and which pages failed as a whole."""
    parts = page_parts(attribute_products(attribute_pages(spark, sf_dir)), may_be_complete=True)
    return parts.select(F.col("capture_id").cast("bigint").alias("o_orderkey"), "extracted", "quarantined", "accepted", "failed", "completeness")


def array_pages(spark, sf_dir):
    key = F.col("o_orderkey")

    def row(i):
        v = (key + i) % 14
        cents = key % 900 + i + 200
        price = (cents / 100).cast("decimal(10,2)")
        flags = [F.when((v == 1) & F.lit(f == "secondo50"), F.lit(True)).otherwise(False).alias(f) for f in ARRAY_MECHANICS]
        return F.struct(
            (key * 10 + i).alias("idProduct"), (key % 50).alias("idVolantino"), F.lit(1).alias("pageNumber"), text("c", key, "-", i).alias("code"),
            F.when(v == 2, "").otherwise(text("Latte &amp; <b>fieno</b> ", i)).alias("name"), F.lit("").alias("brand"),
            F.when(v == 3, "MDWS").otherwise("CARNI").alias("category"),
            F.when(v == 4, "BUONA SPESA CARD").otherwise("PROMO").alias("section"),
            F.when(v == 5, "Peso sgocciolato 300 g").otherwise("x").alias("description"),
            F.when(v == 6, "").when(v == 7, "KG").otherwise("PZ").alias("um"), F.lit(500).alias("weight"), F.lit("G").alias("weight_um"),
            F.when(v == 8, F.lit(0).cast("decimal(10,2)")).otherwise(price).alias("priceOff"),
            F.when(v == 10, (price + 1).cast("decimal(10,2)")).otherwise((price - 1).cast("decimal(10,2)")).alias("prezzoPartenzaSIF"),
            F.when(v == 11, F.lit(None)).otherwise(v.isin(9, 10)).alias("cardMD"), (v == 12).alias("priceStart"),
            F.when(v == 13, 25).otherwise(0).alias("contribute"), F.lit(True).alias("glutenFree"), *flags)

    rows = F.to_json(F.transform(F.sequence(F.lit(0).cast("bigint"), key % 4), row))
    body = F.concat(F.lit("<script>var x = 1; var data = "), F.when(key % 10 == 3, "[]").when(key % 10 == 4, "[{broken").otherwise(rows), F.lit("; var other = [1];</script>"))
    return capture(table(spark, sf_dir, "orders"), body)


@query("array_products", """WITH nodes AS (
  SELECT o_orderkey, i AS idx, (o_orderkey + i) % 14 AS v, o_orderkey % 900 + i + 200 AS cents
  FROM orders, generate_series(0, o_orderkey % 4) t(i) WHERE o_orderkey % 10 NOT IN (3, 4)),
judged AS (SELECT *, CASE v WHEN 1 THEN 'mechanics' WHEN 2 THEN 'title' WHEN 3 THEN 'web_channel' WHEN 4 THEN 'card_section' WHEN 6 THEN 'unit'
  WHEN 8 THEN 'price' WHEN 10 THEN 'card_price' WHEN 11 THEN 'card_unknown' END AS reason,
  CASE WHEN v = 9 THEN cents - 100 ELSE cents END AS applied FROM nodes)
SELECT o_orderkey, idx, reason, CASE WHEN reason IS NULL THEN 'Latte & fieno ' || idx END AS title, CASE WHEN reason IS NULL THEN applied END AS cents,
  CASE WHEN reason IS NULL THEN CASE v WHEN 12 THEN 'from' WHEN 7 THEN 'kg' ELSE 'pack' END END AS basis,
  CASE WHEN reason IS NULL AND v NOT IN (5, 12) THEN CASE WHEN v = 7 THEN applied * 100 ELSE applied * 200 END END AS unit_price_e4,
  CASE WHEN reason IS NULL THEN v = 9 END AS loyalty, NULL::BIGINT AS start_s, NULL::BIGINT AS end_s,
  CASE WHEN reason IS NULL THEN 'carne|source-category|Senza glutine' END AS class,
  CASE WHEN reason IS NULL AND v = 13 THEN 2500 END AS spend
FROM judged UNION ALL SELECT o_orderkey, NULL, 'page_without_products', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 IN (3, 4)""")
def array_products_query(spark, sf_dir):
    """Products of a script array, empty arrays, broken ones."""
    extracted = array_products(array_pages(spark, sf_dir))
    spend = F.when(F.size("reasons") == 0, F.col("conditions.minimum_spend_cents")).alias("spend")
    return judged(extracted, spend)


@query("campaigns_from_attribute", """WITH flyers AS (
  SELECT o_orderkey, i, (o_orderkey + i) % 7 AS v, o_orderdate - to_days(CAST(i AS INTEGER) * 3) AS s FROM orders, generate_series(0, 4) t(i) WHERE o_orderkey % 8 <> 5),
ours AS (SELECT *, CASE WHEN v = 3 THEN s + INTERVAL 40 DAY ELSE s + INTERVAL 13 DAY END AS e FROM flyers WHERE v NOT IN (1, 2)),
fine AS (SELECT * FROM ours WHERE v <> 3 AND timezone('Europe/Rome', CAST(e AS TIMESTAMP) + INTERVAL 1 DAY) > TIMESTAMPTZ '1998-06-15 12:00:00+00'
  AND o_orderkey NOT IN (SELECT o_orderkey FROM ours WHERE v = 4 AND o_orderkey % 2 = 0))
SELECT o_orderkey, 'slug-' || i AS campaign_id, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day FROM fine
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s, i) <= 2""")
def campaigns_from_attribute_query(spark, sf_dir):
    """Leaflets in a page attribute, two per store by start day."""
    key = F.col("o_orderkey")

    def flyer(i):
        v = (key + i) % 7
        start = F.date_sub(day(), (i * 3).cast("int"))
        end = F.date_add(start, F.when(v == 3, 40).otherwise(13))
        name = F.when(v == 2, "LISTINO.pdf").otherwise(text("2026010", i, "PCONADEMILIA.pdf"))
        host = F.when((v == 4) & (key % 2 == 0), "https://altrove.example").otherwise("https://www.leaflet.example")
        return F.struct(
            F.when(v == 1, "Offerte City").otherwise("Offerte Superstore").alias("title"), name.alias("name"), text("slug-", i).alias("slug"),
            F.concat(host, F.lit("/assets/common/volantini/cno/v12/"), name).alias("pdfUrl"),
            (F.unix_seconds(day_start(start)) * 1000).alias("validFrom"), (F.unix_seconds(day_start(F.date_add(end, 1))) * 1000 - 1).alias("validTo"))

    flyers = escaped(F.to_json(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), flyer)))
    body = F.concat(F.lit('<div data-store-id="'), F.when(key % 8 == 5, "78").otherwise("77"), F.lit('" data-flyers="'), flyers, F.lit('"></div>'))
    pages = capture(table(spark, sf_dir, "orders"), body)
    found = campaigns_from_attribute(pages, now(), F.array(F.lit("www.leaflet.example")))
    return found.select(F.col("capture_id").cast("bigint").alias("o_orderkey"), "campaign_id",
                        F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"))


@query("campaigns_from_state", """SELECT o_orderkey, '0123456789abcdef0123456789abcdef' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS campaign_id,
  strftime(o_orderdate, '%Y-%m-%d') AS start_day, strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') AS end_day
FROM orders WHERE o_orderkey % 6 IN (0, 1)""")
def campaigns_from_state_query(spark, sf_dir):
    """Exactly one monthly leaflet in the page state of the right store."""
    key = F.col("o_orderkey")
    v = key % 6
    monthly = F.struct(
        F.lit("FAMILA SELEX GIUGNO").alias("title"),
        F.concat(F.when(v == 3, "https://altrove.example/").otherwise("https://promo.smt.cloud/digitalflyer/files/"),
                 F.lit("0123456789abcdef0123456789abcdef"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("/FA-00.pdf")).alias("linkDigitalFlyer"),
        F.date_format(day(), "yyyyMMdd'000000'").alias("startDate"),
        F.date_format(F.date_add(day(), F.when(v == 4, 60).otherwise(20)), "yyyyMMdd'235959'").alias("endDate"))
    other = monthly.withField("title", F.lit("Sottocosto"))
    flyers = F.when(v == 2, F.array(monthly, other, monthly)).otherwise(F.array(other, monthly))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(flyers.alias("flyers")).alias("store")).alias("pageProps")).alias("props")))
    body = F.concat(
        F.lit('<link rel="canonical" href="'), F.when(v == 5, f"{SITE}/altra").otherwise(F.when(v == 1, SITE).otherwise(f"{SITE}/")),
        F.lit('"><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))
    found = campaigns_from_state(capture(table(spark, sf_dir, "orders"), body))
    return found.select(F.col("capture_id").cast("bigint").alias("o_orderkey"), "campaign_id",
                        F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"))
