"""The offer catalog seen in the given tables, once as a DataFrame and once as SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoforge.functions.text import normalized
from promoforge.functions.offers import evidence
from promoforge.schemas import BENEFIT, QUANTITY
from promoforge.values import CATEGORIES

NOW = datetime(1998, 6, 15, 12)
NOW_SQL = "TIMESTAMP '1998-06-15 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The small ones are one file of one row group, which Spark cannot split (it may cut the file, but then one part has all rows):
    where there are fewer parts than cores, rows are dealt out, so that the rendering of pages and listings uses all cores. Tables of many parts are read as they are."""
    scan, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def now():
    return F.lit("1998-06-15 12:00:00").cast("timestamp")


def ints(column) -> F.Column:
    return column.cast("bigint")


def text(*parts):
    """Concatenation of columns and literals as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per line item: what a source advertised."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
    )
    categories = F.array(*[F.lit(c) for c, _ in CATEGORIES])
    quantity = F.col("l_quantity").cast("bigint")
    return joined.select(
        text(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("offer_id"),
        text(F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-",
             F.col("l_suppkey")).alias("listing_id"),
        text("src-", F.col("l_suppkey")).alias("source_id"),
        text("ret-", F.col("s_nationkey")).alias("retailer_id"),
        text("cmp-", F.year("o_orderdate")).alias("campaign_id"),
        text(F.col("p_name"), " ", F.lower("p_type")).alias("title"),
        F.col("p_brand").alias("brand"),
        F.get(categories, (F.col("l_partkey") % 17).cast("int")).alias("category_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
        F.get(F.array(*map(F.lit, ("pack", "kg", "l", "piece"))), F.col("p_size") % 4).alias("basis"),
        text(F.col("p_size"), " x ", quantity, " g").alias("raw_package"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
        .alias("loyalty_required"),
        F.when(F.col("l_quantity") >= 30, quantity).when(F.col("l_quantity") >= 15, F.lit(1))
        .alias("minimum_pack_count"),
        F.col("o_orderdate").cast("timestamp").alias("start_at"),
        F.col("l_shipdate").cast("timestamp").alias("end_at_exclusive"),
        (F.unix_seconds(now()) - (F.col("l_partkey") % 73) * 3600).alias("verified_s"),
        ((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.08)).alias("withdrawn"),
        F.when(F.col("l_tax") >= 0.08, "quarantined").otherwise("limited").alias("quality"),
        (F.col("l_linenumber") == 7).alias("is_voucher"),
        *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                             "l_shipdate", "o_orderdate", "p_size")],
    )


LISTINGS_SQL = f"""listings AS (
  SELECT l_orderkey || '-' || l_linenumber AS offer_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS listing_id,
         'src-' || l_suppkey AS source_id, 'ret-' || s_nationkey AS retailer_id,
         'cmp-' || year(o_orderdate) AS campaign_id,
         p_name || ' ' || lower(p_type) AS title, p_brand AS brand,
         ([{", ".join(f"'{c}'" for c, _ in CATEGORIES)}])[(l_partkey % 17)::INT + 1] AS category_id,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
         (['pack', 'kg', 'l', 'piece'])[p_size % 4 + 1] AS basis,
         p_size || ' x ' || CAST(l_quantity AS BIGINT) || ' g' AS raw_package,
         CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS loyalty_required,
         CASE WHEN l_quantity >= 30 THEN CAST(l_quantity AS BIGINT) WHEN l_quantity >= 15 THEN 1 END
           AS minimum_pack_count,
         o_orderdate AS start_at, l_shipdate AS end_at_exclusive,
         CAST(epoch({NOW_SQL}) AS BIGINT) - (l_partkey % 73) * 3600 AS verified_s,
         l_linestatus = 'F' AND l_discount >= 0.08 AS withdrawn,
         CASE WHEN l_tax >= 0.08 THEN 'quarantined' ELSE 'limited' END AS quality,
         l_linenumber = 7 AS is_voucher,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate, o_orderdate, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey)"""

# Time states on top of the listings, as stated in words: ended, not begun, begun, no dates.
STATES_SQL = f"""{LISTINGS_SQL}, states AS (
  SELECT *, CASE WHEN end_at_exclusive <= {NOW_SQL} THEN 'expired' WHEN start_at > {NOW_SQL} THEN 'future'
                 WHEN start_at IS NOT NULL THEN 'active' ELSE 'unknown' END AS temporal_status,
         CASE WHEN epoch({NOW_SQL}) - verified_s > 172800 THEN 'hidden'
              WHEN epoch({NOW_SQL}) - verified_s > 43200 THEN 'stale' ELSE 'fresh' END AS freshness
  FROM listings), visible AS (
  SELECT *, CASE WHEN temporal_status = 'future' THEN 'future' ELSE 'current' END AS period
  FROM states WHERE NOT withdrawn AND quality <> 'quarantined' AND freshness <> 'hidden'
    AND temporal_status <> 'expired')"""


def as_catalog(flat: DataFrame, id_column: str = "listing_id", extra=()) -> DataFrame:
    """Flat listings in the shape of the catalog, followed by ``extra`` columns."""
    stamp = F.timestamp_seconds("verified_s")
    product = ~F.col("is_voucher")
    validity = F.struct(
        F.lit("Europe/Rome").alias("timezone"), F.col("start_at"), F.col("end_at_exclusive"),
        F.lit(None).cast("string").alias("raw_text"), F.lit("explicit_dates").alias("evidence_level"),
    )
    price = F.struct(
        F.lit("EUR").alias("currency"), F.col("amount_cents").alias("advertised_amount_cents"),
        F.col("basis"), F.concat(F.col("amount_cents").cast("string"), F.lit(" c")).alias("raw_text"),
        F.lit(None).cast("decimal(18,4)").alias("published_unit_price"),
        F.lit(None).cast("decimal(18,4)").alias("calculated_unit_price"),
        F.lit(None).cast("string").alias("unit_price_basis"), F.lit(None).cast("string").alias("calculation"),
        F.lit(None).cast("bigint").alias("previous_amount_cents"),
    )
    # A voucher may be earned for the first half of its validity.
    half = F.timestamp_seconds(
        F.floor((F.unix_seconds("start_at") + F.unix_seconds("end_at_exclusive")) / 2)
    )
    benefit = F.struct(
        F.lit("EUR").alias("currency"), F.col("amount_cents"),
        (F.col("amount_cents") * 3).alias("earning_minimum_spend_cents"),
        (F.col("amount_cents") * 2).alias("redemption_minimum_spend_cents"),
        F.lit("altri").alias("earning_category"),
        validity.withField("end_at_exclusive", half).alias("earning_validity"),
        validity.alias("redemption_validity"), F.lit(3).cast("bigint").alias("maximum_vouchers_per_receipt"),
        (F.col("amount_cents") * 3).alias("maximum_discount_cents"), F.lit("").alias("exclusions"),
        F.lit("").alias("redemption_instructions"), F.lit("").alias("raw_text"),
    ).cast(BENEFIT)
    conditions = F.struct(
        F.lit("partial").alias("status"), F.col("loyalty_required"),
        F.lit(None).cast("boolean").alias("app_activation_required"),
        F.col("minimum_pack_count").cast("bigint").alias("minimum_pack_count"),
        F.lit(None).cast("bigint").alias("minimum_spend_cents"),
        F.lit(None).cast("bigint").alias("minimum_cost_cents"), F.lit(None).cast("string").alias("raw_text"),
    )
    return flat.select(
        F.col(id_column).alias("id"), F.lit("official_live").alias("data_origin"),
        F.when(product, "product_offer").otherwise("future_voucher").alias("offer_type"),
        "retailer_id", "source_id", "campaign_id",
        F.col("l_partkey").cast("string").alias("source_offer_id"), F.array("source_id").alias("target_ids"),
        "title", normalized(F.col("title")).alias("title_normalized"), "brand",
        F.lit(None).cast("string").alias("original_category"), "category_id",
        F.lit("source-category").alias("category_rule_id"), F.lit("exact_mapping").alias("classification_level"),
        F.lit("6").alias("classification_version"), F.array().cast("array<string>").alias("tags"),
        F.struct(
            F.col("raw_package").alias("raw_text"), F.lit(None).cast("bigint").alias("units_in_pack"),
            F.lit(None).cast(QUANTITY).alias("quantity_per_unit"), F.lit(None).cast("string").alias("quantity_unit"),
            F.lit(None).cast(QUANTITY).alias("total_quantity"), F.lit("unknown").alias("quantity_basis"),
        ).alias("package"),
        F.when(product, price).alias("price"), F.when(~product, benefit).alias("benefit"),
        conditions.alias("conditions"), validity.alias("validity"),
        F.struct(F.lit("store").alias("type"), F.col("source_id").alias("label"),
                 F.lit("verified_store_link").alias("applicability")).alias("scope"),
        "quality", F.array().cast("array<string>").alias("limitations"),
        evidence(
            capture_id=F.col("l_orderkey").cast("string"),
            url=text("https://www.", F.col("retailer_id"), ".example/"),
            selector=text("row ", F.col("l_linenumber")), raw_price=F.col("amount_cents").cast("string"),
        ).alias("evidence"),
        F.lit("1").alias("parser_version"),
        text("https://www.", F.col("retailer_id"), ".example/p/", F.col("l_partkey")).alias("source_url"),
        F.col("start_at").alias("first_seen_at"), stamp.alias("last_seen_at"), stamp.alias("last_verified_at"),
        F.lit(None).cast("timestamp").alias("published_at"),
        "withdrawn", F.lit(0).cast("bigint").alias("missing_count"),
        F.lit(None).cast("timestamp").alias("last_missing_at"),
        *extra,
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog under test: one offer per advertised line."""
    return as_catalog(listings(spark, sf_dir))
