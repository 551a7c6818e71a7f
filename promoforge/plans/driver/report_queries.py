"""Reports over suppliers as sources, orders as captures, and listings as offers."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from promoforge.operators import reports
from promoforge.plans.driver.registry import query
from promoforge.plans.driver.search_queries import MANIFESTS_SQL, manifests
from promoforge.plans.driver.views import LISTINGS_SQL, NOW_SQL, STATES_SQL, catalog, listings, now, table, text
from promoforge.schemas import SOURCE
from promoforge.sources import captures as C


@query("availability", f"""WITH {STATES_SQL}
SELECT 'src-' || s_suppkey AS source_id,
  (SELECT count(*) FILTER (NOT is_voucher AND period = 'current') FROM visible v WHERE v.l_suppkey = s_suppkey) AS current,
  (SELECT count(*) FILTER (NOT is_voucher AND period = 'future') FROM visible v WHERE v.l_suppkey = s_suppkey) AS future,
  (SELECT count(*) FILTER (is_voucher) FROM visible v WHERE v.l_suppkey = s_suppkey) AS coupons FROM supplier""")
def availability(spark, sf_dir):
    """A4: counts per source, zeros included."""
    return reports.availability(catalog(spark, sf_dir), manifests(spark, sf_dir), now())


@query("voucher_coverage", f"""WITH {MANIFESTS_SQL} SELECT retailer_id,
  CASE WHEN bool_or(has_coupons) THEN 'partial' ELSE 'unsupported' END AS coverage FROM manifests GROUP BY retailer_id""")
def voucher_coverage(spark, sf_dir):
    """A4: whether a retailer's sources have vouchers at all."""
    return manifests(spark, sf_dir).groupBy("retailer_id").agg(reports.coverage())


RETAILERS_SQL = """rolled AS (SELECT retailer_id, arg_min(name, file_order) AS name, arg_min(scope_label, file_order) AS message,
  coalesce(arg_max(audit_status, file_order) FILTER (enabled), 'disabled') AS support_status FROM manifests GROUP BY retailer_id)"""


@query("retailer_rollup", f"WITH {MANIFESTS_SQL}, {RETAILERS_SQL} SELECT * FROM rolled")
def retailer_rollup(spark, sf_dir):
    """A5: first source's facts, last enabled source's status."""
    rows = reports.retailers(manifests(spark, sf_dir), F.col("file_order"))
    return rows.select("retailer_id", "name", "message", "support_status")


@query("unsupported_retailers", f"""WITH {MANIFESTS_SQL}, {RETAILERS_SQL}
SELECT retailer_id, name, support_status FROM rolled
UNION ALL SELECT 'ret-' || n_nationkey, n_name, 'candidate' FROM nation WHERE 'ret-' || n_nationkey NOT IN (SELECT retailer_id FROM rolled)
UNION ALL SELECT 'seg-' || lower(s), s, 'permission_required' FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def unsupported_retailers(spark, sf_dir):
    """Supported retailers, then the others that are not among them."""
    supported = reports.retailers(manifests(spark, sf_dir), F.col("file_order"))
    nations = table(spark, sf_dir, "nation").select(
        text("ret-", F.col("n_nationkey")).alias("retailer_id"), F.col("n_name").alias("name"), F.lit("candidate").alias("support_status"))
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select(
        F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("retailer_id"), F.col("c_mktsegment").alias("name"),
        F.lit("permission_required").alias("support_status"))
    rows = reports.with_unsupported(supported, nations.unionByName(segments))
    return rows.select("retailer_id", "name", "support_status")


@query("source_health", f"""WITH {MANIFESTS_SQL}, runs AS (
  SELECT l_suppkey AS k, max(l_shipdate) AS last, count(*) AS n FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY l_suppkey)
SELECT source_id, name, CASE WHEN n IS NULL THEN 'idle' ELSE 'succeeded' END AS state,
  CASE WHEN enabled THEN audit_status ELSE 'disabled' END AS support_status, CAST(epoch(last) AS BIGINT) AS last_s,
  CASE WHEN n IS NULL THEN 'unknown' ELSE 'complete' END AS completeness, n AS count
FROM manifests LEFT JOIN runs ON file_order = k""")
def source_health(spark, sf_dir):
    """Every configured source, with its last run if it has one."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.max("l_shipdate").cast("timestamp").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("l_suppkey") % 4 > 0)
    values = {
        "source_id": text("src-", F.col("l_suppkey")), "last_attempt": F.col("last"), "last_success": F.col("last"),
        "state": F.lit("succeeded"), "completeness": F.lit("complete"),
        "metrics": F.create_map(F.lit("published"), F.col("n").cast("double"))}
    sources = runs.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE.fields])
    return reports.source_health(manifests(spark, sf_dir), sources).select(
        "source_id", "name", "state", "support_status", F.unix_seconds("last_success_at").alias("last_s"), "completeness", "count")


@query("retention", """WITH sized AS (
  SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders),
placed AS (SELECT *, sum(bytes) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total FROM sized)
SELECT o_orderkey, running_total, running_total > 524288000 OR o_orderdate < TIMESTAMP '2001-07-25 00:00:00' AS dropped FROM placed""")
def retention(spark, sf_dir):
    """Newest first, 500 MiB and seven days; the running total spans all captures."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"))
    end = F.lit("2001-08-01 00:00:00").cast("timestamp")
    order = [F.desc("fetched_at"), F.desc("o_orderkey")]
    return reports.retention_totals(rows, end, F.col("bytes"), order).select("o_orderkey", "running_total", "dropped")


@query("retention_bodies", """WITH held AS (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 13 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END AS bytes FROM orders WHERE o_orderstatus <> 'P'),
placed AS (SELECT *, sum(bytes) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM held)
SELECT o_orderkey, total > 524288000 OR o_orderdate < TIMESTAMP '2001-07-25 00:00:00' AS dropped FROM placed""")
def retention_bodies(spark, sf_dir):
    """Captures whose body is gone take no part; some files are missing and weigh nothing."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.when(F.col("o_orderstatus") != "P", F.lit("body")).alias("body"),
        F.when(F.col("o_orderkey") % 13 > 0, F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("bytes"))
    end = datetime.datetime(2001, 8, 1, tzinfo=datetime.UTC)
    return reports.retention(rows, end, F.col("bytes"), F.col("body"), [F.desc("fetched_at"), F.desc("o_orderkey")]).select("o_orderkey", "dropped")


@query("spread_sample", f"""WITH {LISTINGS_SQL}, placed AS (
  SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source_id) AS n FROM listings
  WINDOW w AS (PARTITION BY source_id ORDER BY category_id, coalesce(CAST(loyalty_required AS VARCHAR), 'None'), title, listing_id)),
picks AS (SELECT source_id, n, round_even(i * (n - 1) / 49.0, 0)::BIGINT AS place FROM (SELECT DISTINCT source_id, n FROM placed), range(50) t(i) WHERE i < n)
SELECT source_id, listing_id, placed.place + 1 AS position, count(*) AS times FROM placed JOIN picks USING (source_id, place) GROUP BY ALL""")
def spread_sample(spark, sf_dir):
    """Fifty offers of each source, spread over categories and titles."""
    rows = listings(spark, sf_dir).select(
        "source_id", "category_id", F.coalesce(F.initcap(F.col("loyalty_required").cast("string")), F.lit("None")).alias("loyalty"), "title", "listing_id")
    # DuckDB writes booleans in lower case; the order of False, None, True against false, None, true differs.
    rows = rows.withColumn("loyalty", F.when(F.col("loyalty") == "None", "None").otherwise(F.lower("loyalty")))
    sampled = reports.spread_sample(rows, ["source_id"], [F.asc("category_id"), F.asc("loyalty"), F.asc("title"), F.asc("listing_id")])
    return sampled.select("source_id", "listing_id", F.col("position").cast("bigint").alias("position"), F.col("times").cast("bigint").alias("times"))


@query("page_continuity", """WITH items AS (
  SELECT o_custkey AS scan, l_orderkey AS page, l_partkey % 400 AS item, 'cmp-' || year(o_orderdate) // 3 AS campaign
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
opening AS (SELECT scan, arg_min(campaign, page) AS campaign FROM items GROUP BY scan),
flags AS (SELECT i.scan, i.page, bool_or(i.campaign <> o.campaign
    OR EXISTS (SELECT 1 FROM items e WHERE e.scan = i.scan AND e.item = i.item AND e.page < i.page)) AS broken
  FROM items i JOIN opening o USING (scan) GROUP BY i.scan, i.page)
SELECT scan, page FROM flags QUALIFY NOT coalesce(bool_or(broken) OVER (PARTITION BY scan ORDER BY page ROWS UNBOUNDED PRECEDING), false)""")
def page_continuity(spark, sf_dir):
    """Pages before a change of campaign or a repeated article."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    items = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("scan"), F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 400).alias("item"),
        text("cmp-", F.floor(F.year("o_orderdate") / 3)).alias("campaign"))
    pages = reports.page_breaks(items, ["scan"], "page", "campaign", "item")
    return reports.continuous_pages(pages, ["scan"], "page", F.col("broken")).select("scan", "page")


@query("latest_capture", """SELECT 'src-' || o_custkey % 10 AS source_id, 'https://' || o_custkey AS url, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS capture_id,
  CAST(epoch(max(o_orderdate)) AS BIGINT) AS fetched_s FROM orders GROUP BY o_custkey""")
def latest_capture(spark, sf_dir):
    """An order is a capture of its customer's page."""
    rows = table(spark, sf_dir, "orders").select(
        text("src-", F.col("o_custkey") % 10).alias("source_id"), text("https://", F.col("o_custkey")).alias("url"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").alias("capture_id"))
    return C.latest_captures(rows, stored=True).select("source_id", "url", "capture_id", F.unix_seconds("fetched_at").alias("fetched_s"))


@query("unchanged_captures", """WITH known AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE lang <> 'en')
SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT digest FROM known)""")
def unchanged_captures(spark, sf_dir):
    """Content reuse: only bodies that were not processed before are extracted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    known = rows.where(F.col("lang") != "en").select("sha256")
    return C.changed_captures(rows, known, ["sha256"]).select("doc_id")
