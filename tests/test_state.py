import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoforge.operators import reconcile as R
from promoforge.operators.absence import absence_state
from promoforge.operators.facets import facet_counts
from promoforge.operators.ranking import running, weighted_cut
from promoforge.operators.reports import retention, spread_sample
from promoforge.plans.publish import publish, publish_scans
from promoforge.plans.search import SearchRequest, facets, result_page
from promoforge.schemas import OFFER, SCAN, SOURCE
from promoforge.session import spent_after, written_once
from promoforge.sources.catalog import CatalogStore
from promoforge.streaming.absence import fold

NOW = datetime(2026, 9, 10, 12)


def offers(spark, rows, now=NOW):
    """Offers from ``(id, cents, loyalty)`` rows of one source and campaign."""
    flat = spark.createDataFrame(
        [(i, f"o{r[0]}", *r[1:]) for i, r in enumerate(rows)], "pos bigint, id string, cents bigint, loyalty boolean")
    values = {
        "id": F.col("id"), "offer_type": F.lit("product_offer"), "source_id": F.lit("src"), "campaign_id": F.lit("c"), "title": F.col("id"),
        "title_normalized": F.col("id"), "category_id": F.lit("carne"), "quality": F.lit("limited"), "retailer_id": F.lit("ret"),
        "price": F.struct(F.lit("EUR").alias("currency"), F.col("cents").alias("advertised_amount_cents"), F.lit("pack").alias("basis"),
                          *[F.lit(None).alias(n) for n in ("raw_text", "p", "c", "u", "calc", "prev")]),
        "conditions": F.struct(F.lit("partial").alias("status"), F.col("loyalty"), *[F.lit(None).alias(n) for n in "abcde"]),
        "validity": F.struct(F.lit("Europe/Rome").alias("tz"), F.lit(now - timedelta(days=1)).alias("s"), F.lit(now + timedelta(days=1)).alias("e"),
                             F.lit(None).alias("r"), F.lit("explicit_dates").alias("l")),
        **{n: F.lit(now) for n in ("first_seen_at", "last_seen_at", "last_verified_at")}}
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OFFER.fields]
    return flat.select(*fields, "pos")


def scan(spark, scan_id, at, completeness="complete"):
    return spark.createDataFrame([("src", scan_id, at, completeness, 1, 0, 1, 0, ["c"])], SCAN)


def run(spark, store, rows, scan_id, at, completeness="complete"):
    publish(store, offers(spark, rows, at), scan(spark, scan_id, at, completeness), [F.col("pos")])
    return {r.id: r for r in store.read().collect()}


def test_two_spaced_complete_scans_withdraw(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path), 2, 3)
    run(spark, store, [(1, 100, True), (2, 200, None)], "s1", NOW)
    state = run(spark, store, [(1, 110, None)], "s2", NOW + timedelta(hours=1))
    assert state["o2"].missing_count == 1 and not state["o2"].withdrawn
    assert state["o1"].conditions.loyalty_required is True and state["o1"].price.advertised_amount_cents == 110
    assert state["o1"].first_seen_at == NOW
    state = run(spark, store, [(1, 110, None)], "s3", NOW + timedelta(hours=1, minutes=10))
    assert state["o2"].missing_count == 1, "absences closer than half an hour count once"
    state = run(spark, store, [(1, 110, None)], "s4", NOW + timedelta(hours=2))
    assert state["o2"].withdrawn and state["o2"].missing_count == 2
    state = run(spark, store, [(2, 200, None)], "s5", NOW + timedelta(hours=3), "partial")
    assert not state["o2"].withdrawn and state["o2"].missing_count == 0
    assert state["o1"].missing_count == 0, "a partial scan proves no absence"
    assert store.read_sources().first().revision == 5


def test_superseded_and_repeated_scans_change_nothing(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path), 2, 3)
    run(spark, store, [(1, 100, None)], "s1", NOW)
    before = store.revision()
    run(spark, store, [(1, 999, None)], "s0", NOW - timedelta(hours=1))
    run(spark, store, [(1, 999, None)], "s1", NOW + timedelta(hours=1))
    assert store.revision() == before and store.read().first().price.advertised_amount_cents == 100


def test_conflicting_copies_are_dropped_and_make_the_scan_partial(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path), 2, 3)
    run(spark, store, [(1, 100, None), (2, 200, None)], "s1", NOW)
    state = run(spark, store, [(1, 100, None), (1, 90, None)], "s2", NOW + timedelta(hours=1))
    assert state["o1"].price.advertised_amount_cents == 100 and state["o2"].missing_count == 0
    source = store.read_sources().first()
    assert source.state == "partial" and source.metrics["quarantined"] == 1 and source.metrics["published"] == 0


def test_collapse_guard(spark):
    full = offers(spark, [(i, 100, None) for i in range(30)])
    stored, sources, _ = R.reconcile(
        R.next_catalog(spark.createDataFrame([], store_schema()), full.drop("pos"), empty_verdict(spark)), offers(spark, [(1, 100, None)]),
        scan(spark, "s2", NOW), spark.createDataFrame([], SOURCE), [F.col("pos")])
    assert stored.agg(F.sum("missing_count")).first()[0] == 0 and sources.first().completeness == "partial"


def plain_scans(catalog, scans, batches):
    """One scan after the other, an offer at a time."""
    done, verdicts = [], {}
    for scan_id, at, complete, campaigns in sorted(scans, key=lambda s: (s[1], s[0])):
        if done and (at <= done[-1][1] or scan_id == done[-1][0]):
            continue
        rows, conflicts = {}, set()
        for offer_id, cents, loyalty, campaign in batches.get(scan_id, ()):
            if offer_id in rows and rows[offer_id][:2] != (cents, loyalty):
                conflicts.add(offer_id)
            rows[offer_id] = (cents, loyalty, campaign)
        for c in conflicts:
            del rows[c]
        previous = sum(o["campaign"] in campaigns and not o["withdrawn"] for o in catalog.values())
        complete = complete and not conflicts and not (previous > 20 and len(rows) < previous / 4)
        for i, (cents, loyalty, campaign) in rows.items():
            old = catalog.get(i)
            catalog[i] = {"cents": cents, "loyalty": loyalty if loyalty is not None else old and old["loyalty"], "campaign": campaign, "withdrawn": False, "missing": 0, "last": None,
                          "first": old["first"] if old else at}
        for i, o in catalog.items():
            if complete and i not in rows and o["campaign"] in campaigns and (o["last"] is None or (at - o["last"]).total_seconds() >= 1800):
                o["missing"], o["last"] = o["missing"] + 1, at
                o["withdrawn"] = o["withdrawn"] or o["missing"] >= 2
        done.append((scan_id, at))
        verdicts[scan_id] = (previous, complete)
    return verdicts


@pytest.mark.parametrize("seed", range(2))
def test_fifty_scans_of_one_source_in_one_commit(spark, tmp_path, seed):
    """Collapses, conflicts, moved campaigns, absences close together, repeats and late scans."""
    rng = random.Random(seed)
    store, catalog = CatalogStore(spark, str(tmp_path), 2, 3), {}
    at, number = NOW, 0
    for count in (1, 50, 4):
        scans, batches = [], {}
        for _ in range(count):
            at += timedelta(seconds=rng.choice((0, 600, 1800, 5000)))
            scan_id = f"s{number if rng.random() < 0.95 else number - 1}"
            number += 1
            share = rng.choice((0.0, 0.1, 0.2, 0.7, 0.9, 1.0)) if number > 1 else 1.0
            rows = [(f"o{i}", 100 + rng.choice((0, 0, 5)), rng.choice((None, True, False)), rng.choice("ccd")) for i in range(40) if rng.random() < share]
            if rng.random() < 0.1 and rows:
                rows.append((rows[0][0], 1, None, "c"))
            if scan_id not in batches:
                batches[scan_id] = rows
                scans.append((scan_id, at, rng.random() < 0.8, rng.choice((["c"], ["c", "d"], ["d"]))))
        flat = [(int(i[1:]), cents, loyalty, scan_id, campaign, k, moment) for scan_id, moment, _, _ in scans for k, (i, cents, loyalty, campaign) in enumerate(batches[scan_id])]
        extra = spark.createDataFrame([(n, *f[3:]) for n, f in enumerate(flat)], "pos bigint, scan_id string, c string, k int, moment timestamp")
        incoming = offers(spark, [f[:3] for f in flat]).join(extra, "pos").withColumns({"campaign_id": F.col("c"), "first_seen_at": F.col("moment")}).drop("c", "moment")
        headers = spark.createDataFrame([("src", s, a, "complete" if full else "partial", 1, 0, 1, 0, c) for s, a, full, c in scans], SCAN)
        before = store.revision()
        publish_scans(store, incoming, headers, [F.col("k")])
        verdicts = plain_scans(catalog, [s for s in scans if not catalog or s[1] > newest], batches) if catalog else plain_scans(catalog, scans, batches)
        newest = max([s[1] for s in scans])
        assert store.revision() == before + bool(verdicts)
        got = {r.id: (r.price.advertised_amount_cents, r.conditions.loyalty_required, r.campaign_id, r.withdrawn, r.missing_count, r.last_missing_at, r.first_seen_at) for r in store.read().collect()}
        assert got == {i: (o["cents"], o["loyalty"], o["campaign"], o["withdrawn"], o["missing"], o["last"], o["first"]) for i, o in catalog.items()}
        metrics = {r.scan_id: r.completeness == "complete" for r in store.read_metrics().collect()}
        assert all(metrics[s] == complete for s, (_, complete) in verdicts.items())


def store_schema():
    from promoforge.schemas import CATALOG

    return CATALOG


def empty_verdict(spark):
    return scan(spark, "s", NOW).where("false")


@pytest.mark.parametrize("seed", range(3))
def test_absence_fold_batch_and_stream_agree_with_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"k{rng.integers(4)}", int(rng.integers(0, 3 * 86_400)) * 1_000_000, bool(rng.random() < 0.04)) for _ in range(600)]
    want = {}
    for key, us, seen in sorted(rows):
        count, last = want.get(key, (0, None))
        if seen:
            count, last = 0, None
        elif last is None or us - last >= 1_800_000_000:
            count, last = count + 1, us
        want[key] = (count, last)
    df = spark.createDataFrame(rows, "key string, us bigint, seen boolean").withColumn("ts", F.timestamp_micros("us"))
    got = {r.key: (r.missing_count, r.last_missing_us) for r in absence_state(df, ["key"], F.col("ts"), F.col("seen")).collect()}
    assert got == want
    for key in want:
        mine = [(us, seen) for k, us, seen in rows if k == key]
        state, cut = (0, None), 86_400_000_000
        for part in ([r for r in mine if r[0] < cut], [r for r in mine if r[0] >= cut]):
            if part:
                state = fold(np.array([p[0] for p in part]), np.array([p[1] for p in part]), *state)
        assert state == want[key]


@pytest.mark.parametrize("spread", [86_400, 7_300, 40_000_000])
def test_absence_chunks_with_one_dense_key(spark, spread):
    """A key with most rows, in one chunk or over thousands, among keys without absences and a null key."""
    rng = np.random.default_rng(5)
    instants = np.unique(rng.integers(0, spread, 30_000)) * 1_000_000
    rows = [("dense", int(us)) for us in instants] + [(None, int(us)) for us in instants[::7]] + [(f"k{i}", int(us)) for i, us in enumerate(instants[::500])]
    df = spark.createDataFrame(rows, "key string, us bigint").select("key", F.timestamp_micros("us").alias("ts"), F.lit(False).alias("seen"))
    df = df.unionByName(spark.createDataFrame([("quiet", True)], "key string, seen boolean").withColumn("ts", F.timestamp_micros(F.lit(1))))
    state = absence_state(df, ["key"], F.col("ts"), F.col("seen"))
    got = {r.key: (r.missing_count, r.last_missing_us) for r in state.collect()}
    want = {k: (0, None) for k, _ in rows} | {"quiet": (0, None)}
    for key, us in rows:
        count, last = want[key]
        if last is None or us - last >= 1_800_000_000:
            want[key] = (count + 1, us)
    assert got == want and "collect_list" not in state._jdf.queryExecution().optimizedPlan().toString()


def test_facets_add_up(spark):
    rows = offers(spark, [(i, 100 + i, None) for i in range(40)]).withColumns({
        "withdrawn": F.lit(False), "missing_count": F.lit(0), "last_missing_at": F.lit(None).cast("timestamp"),
        "category_id": F.when(F.col("pos") % 3 == 0, "carne").otherwise("pesce")})
    counts = {(r.facet, r.key): r.n for r in facets(rows, SearchRequest(NOW, validity="all")).collect()}
    assert sum(n for (f, _), n in counts.items() if f == "category") == counts["total", "all"] == 40
    assert sum(n for (f, _), n in counts.items() if f == "period") == 40 and len(counts) == 21
    page = result_page(rows, SearchRequest(NOW, sort="price", price_basis="pack", limit=10, offset=35)).collect()
    assert [r.rank for r in sorted(page, key=lambda r: r.rank)] == list(range(36, 41)) and not page[0].has_more
    first = sorted(result_page(rows, SearchRequest(NOW, sort="price", price_basis="pack", limit=10)).collect(), key=lambda r: r["rank"])
    last = {"amount_cents": first[-1].price.advertised_amount_cents, "id": first[-1].id}
    after = result_page(rows, SearchRequest(NOW, sort="price", price_basis="pack", limit=10, after=last)).collect()
    offset = result_page(rows, SearchRequest(NOW, sort="price", price_basis="pack", limit=10, offset=10)).collect()
    assert first[0].has_more and {r.id for r in after} == {r.id for r in offset}
    with pytest.raises(ValueError):
        SearchRequest(NOW, sort="price")
    with pytest.raises(ValueError):
        SearchRequest(NOW, targets=tuple(f"t{i}" for i in range(6)))
    assert facet_counts is not None


def test_running_totals_with_one_hot_group(spark):
    """A group holding most rows is cut over chunks and still numbered exactly."""
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id", (F.col("id") % 13).alias("v"))
    got = running(rows, ["g"], [F.desc("v"), F.asc("id")], F.col("v")).collect()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    for r in got:
        ordered = sorted(groups[r.g])
        at = ordered.index((-r.v, r.id))
        assert r.position == at + 1 and r.group_size == len(ordered)
        assert r.running_total == -sum(v for v, _ in ordered[: at + 1])


@pytest.mark.parametrize("limit", [0, 1, 499, 500, 50_000, 10**9])
def test_weighted_cut(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice((5, 6, 400_000_000_000, rng.randrange(600_000_000_000))), rng.randrange(0, 500)) for _ in range(400)]
    got = weighted_cut(spark.createDataFrame(rows, "at bigint, size bigint").coalesce(1), F.col("at"), F.col("size"), limit, 5, 600_000_000_000)
    total, want = 0, None
    for at in sorted({a for a, _ in rows}, reverse=True):
        here = sum(s for a, s in rows if a == at)
        if total + here > limit:
            want = (at, total)
            break
        total += here
    assert got == want


def test_retention_around_the_cut(spark):
    big = 200 * 1024 * 1024
    rows = [(1, 0, big, "b"), (2, 0, None, "b"), (3, 60, big, None), (4, 60, big, "b"), (5, 120, big, "b"), (6, 120, big, "b"), (7, 120, 1, "b"), (8, 180, 1, "b"), (9, 8 * 86_400, 1, "b"), (10, 8 * 86_400, 1, None)]
    frame = spark.createDataFrame(rows, "id int, ago long, size long, body string").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_800_000_000) - F.col("ago")))
    end = datetime.fromtimestamp(1_800_000_000)
    assert {r.id: r.dropped for r in retention(frame, end, F.col("size"), F.col("body"), [F.asc("id")]).collect()} == {
        1: False, 2: False, 4: False, 5: True, 6: True, 7: True, 8: True, 9: True}
    assert {r.id for r in retention(frame.where("id > 7"), end, F.col("size"), F.col("body"), [F.asc("id")]).where("dropped").collect()} == {9}
    assert retention(frame.where("id = 10"), end, F.col("size"), F.col("body"), [F.asc("id")]).count() == 0


def test_spread_sample_of_a_hot_group(spark):
    """A group over many chunks and groups that share one."""
    hint = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(6000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 90)).alias("g"), "id", (F.col("id") * 7919 % 6007).alias("v"))
        got = {(r.g, r.v, r.position, r.group_size, r.times) for r in spread_sample(rows, ["g"], [F.desc("v")]).collect()}
        groups = {}
        for r in rows.collect():
            groups.setdefault(r.g, []).append(r.v)
        want = set()
        for g, values in groups.items():
            values.sort(reverse=True)
            picks = [round(i * (len(values) - 1) / 49) for i in range(min(50, len(values)))]
            want |= {(g, values[p], p + 1, len(values), picks.count(p)) for p in picks}
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", hint)


def test_spread_sample_small_groups(spark):
    rows = spark.range(7).withColumn("g", F.lit("a"))
    got = sorted((r.id, r.times) for r in spread_sample(rows, ["g"], [F.asc("id")]).collect())
    picks = [round(i * 6 / 49) for i in range(7)]
    assert got == [(p, picks.count(p)) for p in sorted(set(picks))]


def test_spent_tables_go(spark):
    """Tables written inside go when all is done, kept ones and those of failed work stay."""
    def there(rows):
        return [Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in rows.inputFiles()]

    with spent_after(spark):
        spent, kept = written_once(spark.range(3), "spent"), written_once(spark.range(3), "kept", keep=True)
        files = spent.inputFiles()
        assert all(there(spent))
    assert kept.count() == 3 and all(there(kept))
    assert not any(Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in files)
    with pytest.raises(ValueError, match="lost"), spent_after(spark):
        left = written_once(spark.range(3), "left")
        raise ValueError("lost")
    assert left.count() == 3
    outside = written_once(spark.range(2), "outside")
    assert outside.count() == 2
