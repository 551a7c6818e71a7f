"""Reconciliation, stored revisions, streams: orders' lines as what customers' sources listed."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from promoforge.operators import absence, batches
from promoforge.operators import reconcile as R
from promoforge.operators.reports import availability
from promoforge.plans.driver.registry import query
from promoforge.plans.driver.views import LISTINGS_SQL, NOW_SQL, as_catalog, listings, now, table, text
from promoforge.plans.publish import publish, publish_scans
from promoforge.schemas import OFFER, SCAN, SOURCE
from promoforge.session import work_path, written_in_buckets, written_once
from promoforge.sources.catalog import CatalogStore
from promoforge.streaming import availability as A
from promoforge.streaming.absence import absence_updates
from promoforge.streaming.scans import ingest

LINES_SQL = f"""lines AS (
  SELECT 'src-' || o_custkey AS source_id, o_custkey, l_orderkey || '-' || l_linenumber AS id,
         'cmp-' || month(o_orderdate) AS campaign_id, p_name AS title, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         CASE WHEN l_orderkey % 50 = 1 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE l_orderkey * 10 + l_linenumber END AS cents,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN true ELSE false END AS loyalty,
         CASE WHEN l_linenumber > 3 THEN l_linenumber END AS packs,
         CAST(epoch(o_orderdate) AS BIGINT) AS first_s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
scans AS (SELECT DISTINCT 'src-' || o_custkey AS source_id, o_custkey % 4 <> 0 AS complete FROM orders)"""


def flat_lines(spark, sf_dir):
    """Line items as sightings of offers, narrow: the same id can occur several times in a source."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    cents = F.when(key % 50 == 1, F.round(F.col("l_extendedprice") * 100).cast("bigint")).otherwise(key * 10 + n)
    return rows.select(
        text(key, "-", n).alias("offer_id"), text("src-", F.col("o_custkey")).alias("source_id"),
        F.lit("ret-0").alias("retailer_id"), text("cmp-", F.month("o_orderdate")).alias("campaign_id"),
        F.col("p_name").alias("title"), F.lit(None).cast("string").alias("brand"), F.lit("altri").alias("category_id"),
        cents.alias("amount_cents"), F.lit("pack").alias("basis"), F.lit("1 x 1 g").alias("raw_package"),
        F.when(key % 3 == 1, True).when(key % 3 == 2, False).alias("loyalty_required"),
        F.when(n > 3, n).alias("minimum_pack_count"),
        F.col("o_orderdate").cast("timestamp").alias("start_at"),
        F.col("l_shipdate").cast("timestamp").alias("end_at_exclusive"),
        F.unix_seconds(now()).alias("verified_s"), F.lit(False).alias("withdrawn"), F.lit("limited").alias("quality"),
        F.lit(False).alias("is_voucher"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
    )


def lines(spark, sf_dir):
    """Sightings in the shape of the catalog."""
    return as_catalog(flat_lines(spark, sf_dir), "offer_id", line_facts())


def line_facts():
    return [F.col("l_partkey").alias("_p1"), F.col("l_suppkey").alias("_p2"), F.col("l_returnflag").alias("_flag"), F.col("l_linestatus").alias("_status")]


def scans(spark, sf_dir, scan_id="scan-1", at=None):
    """One scan per customer; every fourth customer's is partial. Campaigns of October to December are not covered."""
    covered = F.array(*[F.lit(f"cmp-{m}") for m in range(1, 10)])
    sources = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return sources.select(
        text("src-", F.col("o_custkey")).alias("source_id"), F.lit(scan_id).alias("scan_id"),
        (now() if at is None else at).alias("scan_at"),
        F.when(F.col("o_custkey") % 4 != 0, "complete").otherwise("partial").alias("completeness"),
        F.col("o_custkey").cast("bigint").alias("extracted"), F.lit(2).cast("bigint").alias("quarantined"),
        F.lit(1).cast("bigint").alias("resources"), F.lit(0).cast("bigint").alias("failed_resources"),
        covered.alias("campaign_ids"),
    )


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def last_first(*columns):
    return [F.col(c) for c in columns]


@query("conflict_dedup", f"""WITH {LINES_SQL}
SELECT source_id, id, count(*) AS copies, count(DISTINCT cents) > 1 AS conflicted,
       CASE WHEN count(DISTINCT cents) = 1 THEN arg_max(title, (l_partkey, l_suppkey)) END AS title
FROM lines GROUP BY source_id, id""")
def conflict_dedup(spark, sf_dir):
    """Copies that disagree drop the id, equal copies collapse to the last."""
    copies = R.collapse_copies(lines(spark, sf_dir), last_first("_p1", "_p2"))
    return copies.select("source_id", "id", "copies", "conflicted", F.when(~F.col("conflicted"), F.col("row.title")).alias("title"))


OLD_SQL = f"""old AS (
  SELECT *, l_partkey % 3 AS missing, l_partkey % 3 >= 2 AS withdrawn,
    CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(epoch({NOW_SQL}) AS BIGINT) - 600 ELSE CAST(epoch({NOW_SQL}) AS BIGINT) - 1800 END AS missing_s
  FROM lines WHERE l_returnflag <> 'N'
  QUALIFY row_number() OVER (PARTITION BY source_id, id ORDER BY l_partkey DESC, l_suppkey DESC) = 1)"""


def round_sql(old: str, batch: str, out: str, at: int) -> str:
    """CTEs that apply one scan of ``batch`` rows to ``old`` and name the outcome ``out``."""
    return f"""{out}_copies AS (
  SELECT source_id, id, count(*) AS copies, count(DISTINCT cents) > 1 AS conflicted,
         unnest(arg_max({{'c': campaign_id, 't': title, 'e': cents, 'l': loyalty, 'p': packs, 'f': first_s}}, (l_partkey, l_suppkey)))
  FROM lines WHERE {batch} GROUP BY source_id, id),
{out}_verdict AS (
  SELECT s.source_id, coalesce(b.offers, 0) AS offers, coalesce(b.published, 0) AS published, coalesce(b.conflicts, 0) AS conflicts,
         coalesce(p.previous, 0) AS previous,
         s.complete AND coalesce(b.conflicts, 0) = 0
           AND NOT (coalesce(p.previous, 0) > 20 AND coalesce(b.published, 0) < coalesce(p.previous, 0) * 0.25) AS complete
  FROM scans s
  LEFT JOIN (SELECT source_id, sum(copies) AS offers, count(*) FILTER (NOT conflicted) AS published,
                    count(*) FILTER (conflicted) AS conflicts FROM {out}_copies GROUP BY ALL) b USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS previous FROM {old} WHERE NOT withdrawn AND campaign_id NOT IN ('cmp-10', 'cmp-11', 'cmp-12')
             GROUP BY ALL) p USING (source_id)),
{out}_joined AS (
  SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.id, n.id) AS id, n.id IS NOT NULL AS is_new, o.id IS NOT NULL AS known,
         o.* EXCLUDE (source_id, id), n.c, n.t, n.e, n.l, n.p, n.f
  FROM {old} o FULL JOIN (SELECT * FROM {out}_copies WHERE NOT conflicted) n ON o.source_id = n.source_id AND o.id = n.id),
{out}_marked AS (
  SELECT j.*, NOT is_new AND v.complete AND campaign_id NOT IN ('cmp-10', 'cmp-11', 'cmp-12')
              AND (missing_s IS NULL OR {at} - missing_s >= 1800) AS absent
  FROM {out}_joined j JOIN {out}_verdict v USING (source_id)),
{out} AS MATERIALIZED (
  SELECT source_id, id, CASE WHEN is_new THEN c ELSE campaign_id END AS campaign_id, CASE WHEN is_new THEN t ELSE title END AS title,
         CASE WHEN is_new THEN e ELSE cents END AS cents,
         CASE WHEN is_new THEN coalesce(l, loyalty) ELSE loyalty END AS loyalty,
         CASE WHEN is_new THEN coalesce(p, packs) ELSE packs END AS packs,
         CASE WHEN known THEN first_s ELSE f END AS first_s,
         CASE WHEN is_new THEN false ELSE withdrawn OR (absent AND missing + 1 >= 2) END AS withdrawn,
         CASE WHEN is_new THEN 0 WHEN absent THEN missing + 1 ELSE missing END AS missing,
         CASE WHEN is_new THEN NULL WHEN absent THEN {at} ELSE missing_s END AS missing_s
  FROM {out}_marked)"""


NOW_S = 897912000
REVISION_COLUMNS_SQL = "source_id, id, campaign_id, title, cents, loyalty, packs::BIGINT AS packs, first_s, withdrawn, missing::BIGINT AS missing, missing_s::BIGINT AS missing_s"


def revision_columns(offers):
    return offers.select(
        "source_id", "id", "campaign_id", "title", F.col("price.advertised_amount_cents").alias("cents"),
        F.col("conditions.loyalty_required").alias("loyalty"), F.col("conditions.minimum_pack_count").alias("packs"),
        F.unix_seconds("first_seen_at").alias("first_s"), "withdrawn", F.col("missing_count").alias("missing"),
        F.unix_seconds("last_missing_at").alias("missing_s"),
    )


def stored_before(spark, sf_dir):
    """A stored catalog in every state: lines returned or accepted, last copy, absence state from the part key."""
    rows = flat_lines(spark, sf_dir).where(F.col("l_returnflag") != "N")
    # Which copy is the last is decided before it is given the wide shape.
    keys = ["source_id", "offer_id"]
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("l_partkey", "l_suppkey")).alias("r")).select(*keys, "r.*")
    last, p = as_catalog(last, "offer_id", line_facts()), F.col("_p1")
    ago = F.when(p % 5 == 1, 600).when(p % 5 > 1, 1800)
    return last.select(
        *OFFER.fieldNames(), (p % 3 >= 2).alias("withdrawn"), (p % 3).alias("missing_count"),
        F.timestamp_seconds(F.unix_seconds(now()) - ago).alias("last_missing_at"))


def one_round(spark, sf_dir):
    incoming = lines(spark, sf_dir).where(F.col("_status") == "O")
    # The stored catalog is a table that both the verdicts and the join read.
    return R.reconcile(written_in_buckets(stored_before(spark, sf_dir), "stored", R.KEY), incoming, scans(spark, sf_dir), empty(spark, SOURCE), last_first("_p1", "_p2"))


@query("reconcile_revision", f"""WITH {LINES_SQL}, {OLD_SQL}, {round_sql('old', "l_linestatus = 'O'", 'nxt', NOW_S)}
SELECT {REVISION_COLUMNS_SQL} FROM nxt""")
def reconcile_revision(spark, sf_dir):
    """Insert, update with history, spaced absences, withdrawal."""
    return revision_columns(one_round(spark, sf_dir)[0])


@query("reconcile_sources", f"""WITH {LINES_SQL}, {OLD_SQL}, {round_sql('old', "l_linestatus = 'O'", 'nxt', NOW_S)}
SELECT source_id, 1 AS revision, CASE WHEN complete THEN 'succeeded' ELSE 'partial' END AS state,
       CASE WHEN complete THEN 'complete' ELSE 'partial' END AS completeness, published::BIGINT AS published,
       (offers - published)::BIGINT AS duplicate_count, (2 + conflicts)::BIGINT AS quarantined, previous::BIGINT AS previous
FROM nxt_verdict""")
def reconcile_sources(spark, sf_dir):
    """Collapse guard, metrics and the source rows."""
    _, sources, scanned = one_round(spark, sf_dir)
    counts = scanned.select("source_id", "previous")

    def metric(name):
        return F.col("metrics")[name].cast("bigint").alias(name)

    return sources.join(counts, "source_id").select(
        "source_id", F.col("revision"), "state", "completeness", metric("published"), metric("duplicate_count"),
        metric("quarantined"), "previous")


@query("superseded_scans", """SELECT 'src-' || o_custkey AS source_id, count(*) AS n FROM orders
WHERE o_orderdate > TIMESTAMP '1998-06-15 12:00:00' GROUP BY o_custkey""")
def superseded_scans(spark, sf_dir):
    """A scan not newer than the last success, or one already applied, publishes nothing."""
    orders = table(spark, sf_dir, "orders")
    source = text("src-", F.col("o_custkey"))
    offered = orders.select(source.alias("source_id"), text("scan-", F.col("o_orderkey")).alias("scan_id"),
                            F.col("o_orderdate").cast("timestamp").alias("scan_at"))
    known = orders.select(source.alias("source_id")).distinct().select(
        "source_id", now().alias("last_success"), F.lit("scan-before").alias("last_scan_id"))
    return R.fresh_scans(offered, known).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


TWO_ROUNDS_SQL = f"""WITH {LINES_SQL}, nothing AS (
  SELECT source_id, id, campaign_id, title, cents, loyalty, packs, first_s, false AS withdrawn, 0 AS missing, NULL::BIGINT AS missing_s
  FROM lines WHERE false),
{round_sql('nothing', "l_returnflag <> 'N'", 'one', NOW_S - 43200)}, {round_sql('one', "l_linestatus = 'O'", 'two', NOW_S)}
SELECT {REVISION_COLUMNS_SQL} FROM two"""


def two_flat_scans(spark, sf_dir):
    earlier = now() - F.expr("INTERVAL 12 HOURS")
    rows = flat_lines(spark, sf_dir)
    return [
        (rows.where(F.col("l_returnflag") != "N"), scans(spark, sf_dir, "scan-1", earlier)),
        (rows.where(F.col("l_linestatus") == "O"), scans(spark, sf_dir, "scan-2", now())),
    ]


def two_scans(spark, sf_dir):
    return [(as_catalog(rows, "offer_id", line_facts()), scan) for rows, scan in two_flat_scans(spark, sf_dir)]


@query("catalog_revisions", TWO_ROUNDS_SQL)
def catalog_revisions(spark, sf_dir):
    """Two scans published into a stored catalog, the second one twice."""
    store = CatalogStore(spark, work_path(spark, "catalog"), shards=4, buckets=4)
    for incoming, scan in two_scans(spark, sf_dir):
        publish(store, incoming, scan, last_first("_p1", "_p2"))
    publish(store, incoming, scan, last_first("_p1", "_p2"))
    return revision_columns(store.read())


# Offers of the scans of one batch, and when they were made: two of them are closer than absences count.
MANY = [("true", 14400), ("l_partkey % 4 <> 0", 10800), ("l_partkey % 3 = 0", 10200), ("l_suppkey % 50 = 0", 5400), ("l_returnflag = 'R'", 3600), ("l_linestatus = 'O'", 0)]


@query("many_scans", f"""WITH {LINES_SQL}, nothing AS (
  SELECT source_id, id, campaign_id, title, cents, loyalty, packs, first_s, false AS withdrawn, 0 AS missing, NULL::BIGINT AS missing_s
  FROM lines WHERE false),
{", ".join(round_sql(f"r{i - 1}" if i else "nothing", rows, f"r{i}", NOW_S - ago) for i, (rows, ago) in enumerate(MANY))}
SELECT {REVISION_COLUMNS_SQL} FROM r{len(MANY) - 1}""")
def many_scans(spark, sf_dir):
    """Six scans of every source in one batch and one commit, as if they had come one after the other."""
    rows = lines(spark, sf_dir).withColumnsRenamed({"_p1": "l_partkey", "_p2": "l_suppkey", "_flag": "l_returnflag", "_status": "l_linestatus"})
    made = [F.struct(F.lit(f"scan-{i}").alias("scan_id"), (now() - F.expr(f"INTERVAL {ago} SECONDS")).alias("scan_at")) for i, (_, ago) in enumerate(MANY)]
    named = F.filter(F.array(*[F.when(F.expr(wanted), s["scan_id"]) for (wanted, _), s in zip(MANY, made, strict=True)]), lambda s: s.isNotNull())
    headers = scans(spark, sf_dir).drop("scan_id", "scan_at").withColumn("made", F.explode(F.array(*made))).select("*", "made.*").drop("made")
    store = CatalogStore(spark, work_path(spark, "catalog"), shards=4, buckets=4)
    publish_scans(store, rows.withColumn("scan_id", F.explode(named)), headers, last_first("l_partkey", "l_suppkey"))
    if store.revision() != 1:
        raise AssertionError("one batch is one commit")
    return revision_columns(store.read())


def write_batches(spark, sf_dir, inbox):
    """The same scans as files a stream picks up."""
    fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OFFER.fields])
    order = F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey")
    for rows, scan in two_flat_scans(spark, sf_dir):
        header = scan.select("source_id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCAN.fields]).alias("scan"))
        # Headers are joined with narrow rows; offers get their wide shape where they are written.
        joined = header.join(rows.withColumn("pos", order), "source_id", "left")
        as_catalog(joined, "offer_id", ["scan", "pos"]).select(
            "scan", "pos", F.when(F.col("pos").isNotNull(), fields).alias("offer")
        ).write.mode("append").parquet(inbox)


@query("stream_reconcile", TWO_ROUNDS_SQL)
def stream_reconcile(spark, sf_dir):
    """Both scans arrive as files in one micro-batch and are applied in scan order."""
    folder = work_path(spark, "stream")
    store = CatalogStore(spark, f"{folder}/catalog", shards=4, buckets=4)
    write_batches(spark, sf_dir, f"{folder}/inbox")
    ingest(spark, f"{folder}/inbox", store, f"{folder}/checkpoint").awaitTermination()
    return revision_columns(store.read())


@query("stream_availability", TWO_ROUNDS_SQL.replace(f"SELECT {REVISION_COLUMNS_SQL} FROM two", f"""
SELECT source_id, count(id) FILTER (NOT withdrawn AND first_s <= {NOW_S}) AS seen FROM scans LEFT JOIN two USING (source_id) GROUP BY source_id"""))
def stream_availability(spark, sf_dir):
    """T5: counts per source recomputed from the revision a stream left behind."""
    folder = work_path(spark, "stream")
    store = CatalogStore(spark, f"{folder}/catalog", shards=4, buckets=4)
    write_batches(spark, sf_dir, f"{folder}/inbox")
    ingest(spark, f"{folder}/inbox", store, f"{folder}/checkpoint").awaitTermination()
    # Ends are taken off: the point is which offers are listed, not when they end.
    open_ended = store.read().withColumn("validity", F.col("validity").withField("end_at_exclusive", F.lit(None).cast("timestamp")))
    return availability(open_ended, store.read_sources(), now()).select("source_id", F.col("current").alias("seen"))


ABSENCE_SQL = """WITH sightings AS (
  SELECT {key} AS key, epoch_us(ts) AS us, event_type <> 'error' AS seen FROM events),
lists AS (SELECT key, list_sort(list({{'us': us, 'seen': seen}})) AS l FROM sightings GROUP BY key),
folded AS (SELECT key, list_reduce(
    list_transform(l, lambda s: {{'us': s.us, 'seen': s.seen, 'n': 0::BIGINT, 'last': NULL::BIGINT}}),
    lambda a, s: {{'us': s.us, 'seen': s.seen,
      'n': CASE WHEN s.seen THEN 0 WHEN a.last IS NULL OR s.us - a.last >= 1800000000 THEN a.n + 1 ELSE a.n END,
      'last': CASE WHEN s.seen THEN NULL WHEN a.last IS NULL OR s.us - a.last >= 1800000000 THEN s.us ELSE a.last END}},
    {{'us': 0::BIGINT, 'seen': true, 'n': 0::BIGINT, 'last': NULL::BIGINT}}) AS r FROM lists)
SELECT key, r.n AS missing_count, r.last AS last_missing_us, r.n >= 2 AS withdrawn FROM folded"""
USER_KEY = "CAST(user_id AS VARCHAR)"


def sightings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("seen"))


def as_bigints(states):
    return states.select("key", "missing_count", "last_missing_us", "withdrawn")


@query("absence_counter", ABSENCE_SQL.format(key=USER_KEY))
def absence_counter(spark, sf_dir):
    """Every user as an offer, error events as scans that miss it."""
    return as_bigints(absence.absence_state(sightings(spark, sf_dir), ["key"], F.col("ts"), F.col("seen")))


@query("absence_counter_dense", ABSENCE_SQL.format(key="event_type"))
def absence_counter_dense(spark, sf_dir):
    """W6 on very few keys with long runs of absences."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("seen"))
    return as_bigints(absence.absence_state(rows, ["key"], F.col("ts"), F.col("seen")))


@query("stream_absence", ABSENCE_SQL.format(key=USER_KEY))
def stream_absence(spark, sf_dir):
    """The same counter as stream state over three thirds of the time in order; the last update per key."""
    folder = work_path(spark, "sightings")
    rows = sightings(spark, sf_dir)
    bounds = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (bounds.b - bounds.a) / 3

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/updates")

    for i in range(3):
        low = (bounds.a + i * step).replace(tzinfo=datetime.UTC)
        part = rows.where(F.col("ts") >= F.lit(low)) if i else rows
        if i < 2:
            part = part.where(F.col("ts") < F.lit((bounds.a + (i + 1) * step).replace(tzinfo=datetime.UTC)))
        # A third is as many files as tasks wrote it; the stream goes on from its checkpoint and takes all that came as one batch.
        part.write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/inbox")
        absence_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    state = F.struct("missing_count", "last_missing_us", "withdrawn")
    return updates.groupBy("key").agg(F.max_by(state, F.col("batch")).alias("s")).select("key", "s.*")


@query("batch_rollup", """SELECT 'src-' || o_custkey AS source_id, sum(o_orderkey % 30)::BIGINT AS extracted, sum(o_orderkey % 5)::BIGINT AS quarantined,
  count(*) FILTER (o_orderstatus <> 'P') AS resources, count(*) FILTER (o_orderstatus = 'P') AS failed_resources,
  CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' ELSE 'partial' END AS completeness FROM orders GROUP BY o_custkey""")
def batch_rollup(spark, sf_dir):
    """An order is a page of a customer's scan."""
    parts = table(spark, sf_dir, "orders").select(
        text("src-", F.col("o_custkey")).alias("source_id"), (F.col("o_orderkey") % 30).alias("extracted"),
        (F.col("o_orderkey") % 5).alias("quarantined"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("completeness"),
        (F.col("o_orderstatus") == "P").alias("failed"))
    return batches.roll_up(parts)


@query("batch_campaigns", f"WITH {LINES_SQL} SELECT DISTINCT source_id, campaign_id FROM lines")
def batch_campaigns(spark, sf_dir):
    """Distinct campaigns of a batch."""
    return batches.campaigns(lines(spark, sf_dir))


@query("batch_details", """WITH parts AS (SELECT 'src-' || o_custkey AS source_id, o_orderkey AS pos, 'https://p/' || o_orderkey % 50 AS url, o_orderstatus = 'P' AS failed,
    CASE WHEN o_orderkey % 7 = 0 THEN ['w' || o_orderkey % 3, 'late'] END AS warnings, ['cmp-' || month(o_orderdate), 'cmp-' || month(o_orderdate), NULL] AS campaigns FROM orders),
said AS (SELECT source_id, pos, CASE WHEN failed THEN 'failed' ELSE 'visited' END AS kind, url AS value FROM parts
  UNION ALL SELECT source_id, pos, 'warning', unnest(warnings) FROM parts UNION ALL SELECT DISTINCT source_id, pos, 'campaign', unnest(campaigns) FROM parts WHERE NOT failed)
SELECT source_id, kind, value, count(*) AS parts, min(pos) AS first_pos FROM said WHERE value IS NOT NULL GROUP BY ALL""")
def batch_details(spark, sf_dir):
    """What the pages of a scan visited, missed, warned of and belonged to."""
    key, month = F.col("o_orderkey"), text("cmp-", F.month("o_orderdate"))
    parts = table(spark, sf_dir, "orders").select(
        text("src-", F.col("o_custkey")).alias("source_id"), key.alias("pos"), text("https://p/", key % 50).alias("url"), (F.col("o_orderstatus") == "P").alias("failed"),
        F.when(key % 7 == 0, F.array(text("w", key % 3), F.lit("late"))).alias("warnings"), F.array(month, month, F.lit(None).cast("string")).alias("campaign_ids"))
    return batches.scan_details(parts)


@query("scan_sink", f"""WITH {LINES_SQL}, nothing AS (
  SELECT source_id, id, campaign_id, title, cents, loyalty, packs, first_s, false AS withdrawn, 0 AS missing, NULL::BIGINT AS missing_s FROM lines WHERE false),
{round_sql('nothing', "l_returnflag <> 'N'", 'one', NOW_S - 43200)}, {round_sql('one', "l_linestatus = 'O'", 'two', NOW_S)}
SELECT source_id, 'scan-1' AS scan_id, published::BIGINT AS published, (offers - published)::BIGINT AS duplicate_count, (2 + conflicts)::BIGINT AS quarantined,
  length(source_id)::BIGINT AS seconds, CASE WHEN complete THEN 'complete' ELSE 'partial' END AS completeness, NULL::BIGINT AS resources FROM one_verdict
UNION ALL SELECT source_id, 'scan-2', published, offers - published, 2 + conflicts, length(source_id), CASE WHEN complete THEN 'complete' ELSE 'partial' END, 99 FROM two_verdict""")
def scan_sink(spark, sf_dir):
    """The stored metrics of two scans with the caller's own figures; for the second also as the source row has them, where the caller's count."""
    store = CatalogStore(spark, work_path(spark, "catalog"), shards=4, buckets=4)
    for incoming, scan in two_scans(spark, sf_dir):
        own = F.create_map(F.lit("seconds"), F.length("source_id").cast("double"), F.lit("resources"), F.lit(99.0))
        publish(store, incoming, scan.withColumn("extra", own), last_first("_p1", "_p2"))
    last = store.read_sources().select("source_id", F.col("last_scan_id").alias("scan_id"), F.col("metrics")["resources"].cast("bigint").alias("resources"))
    figures = ["published", "duplicate_count", "quarantined"]
    rows = store.read_metrics().select("source_id", "scan_id", *[F.col(f).cast("bigint").alias(f) for f in figures], F.col("extra")["seconds"].cast("bigint").alias("seconds"), "completeness")
    return rows.join(last, ["source_id", "scan_id"], "left")


# Hours from the moment of the tables to the end of each step; the last one brings no offers.
STEPS = (-30, 0, 20)


@query("stream_availability_timers", f"""WITH {LISTINGS_SQL}, steps(step, hours) AS (VALUES (0, {STEPS[0]}), (1, {STEPS[1]}), (2, {STEPS[2]})),
seen AS (SELECT step, l_suppkey, is_voucher, start_at, end_at_exclusive, {NOW_SQL} + to_hours(hours) AS t,
    withdrawn OR (step > 0 AND l_partkey % 10 = 0) AS gone, quality, CASE WHEN step > 0 AND l_partkey % 10 = 1 THEN CAST(epoch({NOW_SQL}) AS BIGINT) ELSE verified_s END AS verified
  FROM listings, steps),
counted AS (SELECT step, l_suppkey, CASE WHEN is_voucher THEN 'coupons' WHEN start_at > t THEN 'future' ELSE 'current' END AS kind FROM seen
  WHERE NOT gone AND quality <> 'quarantined' AND coalesce(end_at_exclusive > t, true) AND epoch(t) - verified <= 172800)
SELECT step, 'src-' || s_suppkey AS source_id, {", ".join(f"(SELECT count(*) FROM counted c WHERE c.step = steps.step AND c.l_suppkey = s_suppkey AND kind = '{k}') AS {k}" for k in ("current", "future", "coupons"))}
FROM supplier, steps""")
def stream_availability_timers(spark, sf_dir):
    """T5, T4: counts kept by signed changes, after all offers came, after some changed, and after only time passed."""
    folder = work_path(spark, "availability")
    flat = listings(spark, sf_dir)
    moment = [F.timestamp_seconds(F.unix_seconds(now()) + hours * 3600) for hours in STEPS]
    key = F.col("l_partkey") % 10
    changed = flat.where(key < 2).withColumns({
        "withdrawn": F.col("withdrawn") | (key == 0), "verified_s": F.when(key == 1, F.unix_seconds(now())).otherwise(F.col("verified_s"))})
    inputs = [A.offer_changes(as_catalog(flat), moment[0]), A.offer_changes(as_catalog(changed), moment[1]), A.clock(spark, moment[2])]
    sources = table(spark, sf_dir, "supplier").select(text("src-", F.col("s_suppkey")).alias("source_id"))
    steps = []
    for step, rows in enumerate(inputs):
        # Every step brings the clock with it, so that time is known even where nothing changes.
        rows.unionByName(A.clock(spark, moment[step])).write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/inbox")
        A.availability_changes(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/changes").format(
            "parquet").trigger(availableNow=True).start().awaitTermination()
        counts = A.availability_of(spark.read.schema(A.CHANGES).parquet(f"{folder}/changes"), sources)
        steps.append(written_once(counts.withColumn("step", F.lit(step)), "counts"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])
