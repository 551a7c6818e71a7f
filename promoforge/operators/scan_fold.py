"""Several scans of each source folded into the stored catalog at once.

What a scan does to an offer depends on what the offer was before, so scans seem to need one pass over the catalog each. They do not: a
sighting forgets all absences before it. So an offer's history is cut at its sightings into segments, and within a segment
only the complete scans of its campaign matter. Copies, sightings and segments are keyed aggregates and joins over all scans of
all sources together.

One thing runs from scan to scan for a whole source: a scan that lists less than a quarter of what was listed before it proves no absence. What was listed
depends on the absences the scans before it proved. It is found by rounds: with the verdicts assumed, one pass over the segments
counts what each scan found listed; where that changes a verdict, the sources concerned are counted again. A round settles at least one more
scan of each source, and without such a collapse the first round settles all.

Wide rows move once, to buckets by source and offer: the row that stays is elected by its place in the written batch (file and row number), and read from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoforge.functions.offers import fill_conditions
from promoforge.operators.winners import elect, fetch, with_address
from promoforge.schemas import CONDITIONS, OFFER
from promoforge.session import written_in_buckets, written_once
from promoforge.values import ABSENCE_SPACING_SECONDS, ABSENCES_TO_WITHDRAW, COLLAPSE_MIN_PREVIOUS, COLLAPSE_RATIO

KEY = ["source_id", "id"]
SPACING = ABSENCE_SPACING_SECONDS * 1_000_000
# Beyond all turns of a batch.
NEVER = 1 << 30
SEGMENT = T.StructType([T.StructField("turn", T.IntegerType()), T.StructField("campaign_id", T.StringType()), T.StructField("missing", T.LongType()),
                        T.StructField("last_us", T.LongType()), T.StructField("withdrawn", T.BooleanType())])


def scans_in_turn(scans: DataFrame, sources: DataFrame) -> DataFrame:
    """Scans that may publish, one after the other, with their ``turn`` among those of their source.

    A scan has to be newer than the last success before it, and another than the one before it. The scans of a
    source are those of one batch; their number is what a batch is allowed to hold.
    """
    if "extra" in scans.columns:
        # Maps have no order; as entries they have.
        scans = scans.withColumn("extra", F.array_sort(F.map_entries("extra")))
    scan = F.struct("scan_at", "scan_id", *[c for c in scans.columns if c not in ("source_id", "scan_at", "scan_id")])
    each = scans.groupBy("source_id").agg(F.array_sort(F.collect_set(scan)).alias("scans")).join(
        sources.select("source_id", F.col("last_success").alias("at"), F.col("last_scan_id").alias("last_id")), "source_id", "left")
    kind = each.schema["scans"].dataType.simpleString()
    start = F.struct(F.col("at"), F.col("last_id").alias("id"), F.array().cast(kind).alias("taken"))

    def step(state: Column, s: Column) -> Column:
        newer = (state["at"].isNull() | (s["scan_at"] > state["at"])) & (state["id"].isNull() | (s["scan_id"] != state["id"]))
        return F.when(newer, F.struct(s["scan_at"].alias("at"), s["scan_id"].alias("id"), F.array_append(state["taken"], s).alias("taken"))).otherwise(state)

    taken = each.select("source_id", F.posexplode(F.aggregate("scans", start, step)["taken"]).alias("pos", "scan"))
    rows = taken.select("source_id", (F.col("pos") + 1).alias("turn"), "scan.*")
    return rows.withColumn("extra", F.map_from_entries("extra")) if "extra" in rows.columns else rows


def sight(incoming: DataFrame, scans: DataFrame, position: Sequence[Column]) -> DataFrame:
    """One row per offer and turn: copies that disagree in price, benefit or conditions are a conflict, else the last one is the sighting.

    Offers that do not name their scan are those of the only scan of their source. Copies are counted first, where they lie; only then their scans are joined.
    """
    by = ["source_id", "scan_id"] if "scan_id" in incoming.columns else ["source_id"]
    found = elect(incoming, [*KEY, *by[1:]], position, ["price", "benefit", "conditions"], ["campaign_id", "quality", "first_seen_at", "conditions"])
    return found.join(scans.select(*by, "turn"), by).drop("scan_id")


def batch_verdicts(scans: DataFrame, sighted: DataFrame) -> DataFrame:
    """Scans with the counts of their offers; what was listed before is not known yet."""
    kept = ~F.col("conflicted")
    counts = sighted.groupBy("source_id", "turn").agg(
        F.sum("copies").alias("offers"), F.count_if(kept).alias("published"), F.count_if(kept & (F.col("quality") == "limited")).alias("limited"), F.count_if("conflicted").alias("conflicts"))
    rows = scans.join(counts, ["source_id", "turn"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("offers", "published", "limited", "conflicts")})
    return rows.withColumns({
        "quarantined": F.coalesce("quarantined", F.lit(0)) + F.col("conflicts"), "duplicate_count": F.col("offers") - F.col("published"),
        "complete": (F.col("completeness") == "complete") & (F.col("conflicts") == 0)})


def histories(catalog: DataFrame, sighted: DataFrame) -> DataFrame:
    """One narrow row per offer: ``segments`` in turn, the address of its last sighting, and what its history leaves.

    The join is on the columns the catalog is bucketed by.
    """
    sighting = F.struct("turn", "campaign_id", "first_seen_at", "conditions", "_file", "_row")
    news = sighted.where(~F.col("conflicted")).groupBy("source_id", "id").agg(F.array_sort(F.collect_list(sighting)).alias("seen"))
    old = catalog.select("source_id", "id", "campaign_id", "withdrawn", "missing_count", F.unix_micros("last_missing_at").alias("last_us"), "first_seen_at", "conditions")
    o, n = old.alias("o"), news.alias("n")
    joined = o.join(n, [F.col("o.source_id") == F.col("n.source_id"), F.col("o.id") == F.col("n.id")], "full_outer")
    known, seen = F.col("o.id").isNotNull(), F.coalesce("n.seen", F.array().cast(news.schema["seen"].dataType))
    stored = F.struct(F.lit(0).alias("turn"), F.col("o.campaign_id"), F.col("o.missing_count").alias("missing"), F.col("o.last_us"), F.col("o.withdrawn")).cast(SEGMENT)
    later = F.transform(seen, lambda s: F.struct(s["turn"], s["campaign_id"], F.lit(0), F.lit(None), F.lit(False)).cast(SEGMENT))
    last = F.try_element_at(seen, F.lit(-1))
    conditions = F.aggregate(seen, F.when(known, F.col("o.conditions")).cast(CONDITIONS), lambda kept, s: fill_conditions(s["conditions"], kept).cast(CONDITIONS))
    return joined.select(
        F.coalesce("o.source_id", "n.source_id").alias("source_id"), F.coalesce("o.id", "n.id").alias("id"),
        F.concat(F.when(known, F.array(stored)).otherwise(F.array().cast(T.ArrayType(SEGMENT))), later).alias("segments"),
        last["_file"].alias("_file"), last["_row"].alias("_row"),
        F.when(known, F.col("o.first_seen_at")).otherwise(F.get(seen, F.lit(0))["first_seen_at"]).alias("first_seen_at"), conditions.alias("conditions"))


def closing_scans(verdicts: DataFrame) -> DataFrame:
    """Per source and campaign: the complete scans that cover it, in turn.

    Like the campaigns asked for in :func:`listed_before` these are many more rows than scans, and campaigns that scans have in common take next to no room in
    their file, so Spark takes either for small and would build up a relation of more than ten times that size in the driver: both are merged, whatever their file's size.
    """
    each = verdicts.where("complete").select("source_id", F.explode("campaign_ids").alias("campaign_id"), "turn", F.unix_micros("scan_at").alias("us"))
    return each.groupBy("source_id", "campaign_id").agg(F.array_sort(F.collect_set(F.struct("turn", "us"))).alias("closing")).hint("merge")


def _absences(segment: Column, until: Column, closing: Column) -> Column:
    """State after a segment: counted absences, the last one, and the turn that withdrew the offer."""
    start = F.struct(segment["missing"].alias("missing"), segment["last_us"].alias("last_us"), F.when(segment["withdrawn"], 0).alias("out"))

    def step(state: Column, s: Column) -> Column:
        counts = (s["turn"] > segment["turn"]) & (s["turn"] < until) & (state["last_us"].isNull() | (s["us"] - state["last_us"] >= SPACING))
        missing = state["missing"] + 1
        return F.when(counts, F.struct(missing.alias("missing"), s["us"].alias("last_us"), F.coalesce(state["out"], F.when(missing >= ABSENCES_TO_WITHDRAW, s["turn"])).alias("out"))).otherwise(state)

    return F.aggregate(F.coalesce(closing, F.array().cast("array<struct<turn:int,us:bigint>>")), start, step)


def listed_before(history: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per source and turn: offers of the scanned campaigns that the scan found listed (``previous``)."""
    segments = history.select("source_id", F.posexplode("segments").alias("pos", "s"), F.col("segments").alias("all"))
    segments = segments.select("source_id", "s", F.coalesce(F.get("all", F.col("pos") + 1)["turn"], F.lit(NEVER)).alias("until"), F.col("s.campaign_id").alias("campaign_id"))
    known = segments.where(~F.col("s.withdrawn")).join(closing_scans(verdicts), ["source_id", "campaign_id"], "left")
    out = _absences(F.col("s"), F.col("until"), F.col("closing"))["out"]
    spans = known.select("source_id", "campaign_id", (F.col("s.turn") + 1).alias("start"), F.least("until", F.coalesce(out, F.lit(NEVER))).alias("end"))
    spans = spans.groupBy("source_id", "campaign_id", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    events = spans.select("source_id", "campaign_id", F.explode(F.array(
        F.struct(F.col("start").alias("turn"), F.col("n")), F.struct((F.col("end") + 1).alias("turn"), (-F.col("n")).alias("n")))).alias("e"))
    events = events.groupBy("source_id", "campaign_id", F.col("e.turn").alias("from")).agg(F.sum("e.n").alias("n"))
    asked = verdicts.select("source_id", "turn", F.explode(F.array_distinct("campaign_ids")).alias("campaign_id"))
    return asked.hint("merge").join(events, ["source_id", "campaign_id"]).where(F.col("from") <= F.col("turn")).groupBy("source_id", "turn").agg(F.sum("n").alias("previous"))


def settle(history: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final verdicts: ``previous``, ``collapsed``, ``complete`` and ``completeness`` of every scan."""
    own = verdicts.withColumns({"able": F.col("complete"), "last_turn": F.max("turn").over(Window.partitionBy("source_id"))})
    done: list[DataFrame] = []
    while True:
        counted = own.join(listed_before(history, own), ["source_id", "turn"], "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
        collapsed = (F.col("previous") > COLLAPSE_MIN_PREVIOUS) & (F.col("published") < F.col("previous") * F.lit(COLLAPSE_RATIO))
        counted = counted.withColumn("collapsed", collapsed).withColumn("now", F.col("able") & ~F.col("collapsed"))
        # A verdict that changed matters to the scans after it.
        changed = F.max((F.col("now") != F.col("complete")) & (F.col("turn") < F.col("last_turn"))).over(Window.partitionBy("source_id"))
        counted = written_once(counted.withColumns({"again": changed, "complete": F.col("now")}).drop("now"), "verdicts")
        done.append(counted.where(~F.col("again")).drop("again"))
        if counted.where("again").isEmpty():
            break
        own = counted.where("again").drop("again", "previous", "collapsed")
        history = history.join(own.select("source_id").distinct(), "source_id", "left_semi")
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return settled.drop("able", "last_turn").withColumn("completeness", F.when(F.col("complete"), "complete").when(F.col("completeness") == "complete", "partial").otherwise(F.col("completeness")))


def outcome(history: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reconciliation columns of every offer after the last scan."""
    last = F.element_at("segments", -1)
    rows = history.withColumn("campaign_id", last["campaign_id"]).join(closing_scans(verdicts), ["source_id", "campaign_id"], "left")
    state = F.transform(F.array(_absences(last, F.lit(NEVER), F.col("closing"))), lambda s: s)[0]
    rows = rows.select("source_id", "id", "_file", "_row", "first_seen_at", "conditions", state.alias("state"))
    return rows.select(
        "source_id", "id", "_file", "_row", "first_seen_at", "conditions", F.col("state.out").isNotNull().alias("withdrawn"),
        F.col("state.missing").alias("missing_count"), F.timestamp_micros("state.last_us").alias("last_missing_at"))


STATE = ("withdrawn", "missing_count", "last_missing_at")


def fold_scans(catalog: DataFrame, incoming: DataFrame, scans: DataFrame, position: Sequence[Column], buckets: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(stored offers as they are now, offers seen, verdicts)`` after all ``scans`` (see :func:`scans_in_turn`).

    ``incoming`` has the offers of the scans, with their ``scan_id`` or, if each source has one scan, without. The first result keeps the partitioning of ``catalog``,
    the second lies in buckets by source and offer, as many as a multiple of ``buckets``: offers as they came move once, when they are dealt to these.
    """
    scans = written_once(scans, "scans")
    given = [c for c in incoming.columns if c not in STATE]
    batch = with_address(written_in_buckets(incoming.select(*given), "incoming", KEY, buckets))
    sighted = written_once(sight(batch, scans, position), "sighted")
    history = written_once(histories(catalog, sighted), "histories")
    verdicts = settle(history, batch_verdicts(scans, sighted))
    now = outcome(history, verdicts)
    stay = now.where("_file is null").select("source_id", "id", *STATE)
    kept = catalog.drop(*STATE).join(stay, ["source_id", "id"])
    came = now.where("_file is not null").select(*KEY, "_file", "_row", F.col("first_seen_at").alias("_first"), F.col("conditions").alias("_conditions"), *STATE)
    rows = fetch(batch, came, KEY).withColumns({"first_seen_at": F.col("_first"), "conditions": F.col("_conditions")})
    return kept, rows.select(*OFFER.fieldNames(), *STATE), verdicts
