"""Sides of joins are sized as rows, not as their compressed files."""

from pyspark.sql import functions as F

from promoforge.sources import geometry as G


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_many_narrow_rows_are_not_broadcast(spark, tmp_path):
    """Keys of 600,000 documents are a file of a few MB, and over 50 MB as a relation in the driver."""
    spark.range(0, 600_000, 1, 2).select("id", F.lit("F").alias("status"), F.lit("x").alias("priority")).write.parquet(f"{tmp_path}/orders")
    orders = spark.read.parquet(f"{tmp_path}/orders")
    doc, none = F.col("id").cast("string").alias("doc_id"), F.lit(0.0)
    pages = orders.select(doc, F.lit(1).alias("page"), F.lit(G.RECT_PAGE[0]).alias("width"), F.lit(G.RECT_PAGE[1]).alias("height"))
    rects = orders.select(doc, F.lit(1).alias("page"), none.alias("x0"), none.alias("top"), (none + 185).alias("x1"), (none + 160).alias("bottom"), F.lit(True).alias("filled"))
    plan = plan_of(G.product_rects(rects, pages))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_small_tables_still_are(spark, tmp_path):
    spark.range(25).write.parquet(f"{tmp_path}/nation")
    spark.range(100_000).write.parquet(f"{tmp_path}/supplier")
    plan = plan_of(spark.read.parquet(f"{tmp_path}/supplier").join(spark.read.parquet(f"{tmp_path}/nation"), "id"))
    assert "BroadcastHashJoin" in plan


def test_many_parts_are_not_broadcast(spark, tmp_path):
    """The lines of the stored catalog's scans join all parts: 400,000 of them are a small file, but not small in the driver."""
    from promoforge.plans.driver.reconcile_queries import lines

    for name in ("lineitem", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(400_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("small widget "), F.col("id") % 9).alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    plan = plan_of(lines(spark, str(tmp_path)).select("id", "title"))
    assert "p_name" in plan and "BroadcastHashJoin" not in plan


def test_thirds_of_the_sightings_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from promoforge.plans.driver import reconcile_queries

    monkeypatch.setattr(reconcile_queries, "work_path", lambda spark, name: f"{tmp_path}/{name}")
    users = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id").distinct().count()
    assert reconcile_queries.stream_absence(spark, "/root/testdata/sf0.01").count() == users
    assert len(list((tmp_path / "sightings/inbox").glob("*.parquet"))) > 3


def test_connectors_are_planned_one_at_a_time(spark):
    """The readers of seven connectors in one plan filled the driver: what is returned only reads what each wrote."""
    from promoforge.plans.driver.leaflet_queries import CONNECTORS, extract_all

    rows = extract_all(spark, "/root/testdata/sf0.001")
    plan = plan_of(rows)
    assert len(plan) < 100_000 and "MapInArrow" not in plan and "Join" not in plan
    assert {r.connector for r in rows.collect()} == set(CONNECTORS)


def test_campaigns_of_scans_are_not_broadcast(spark, tmp_path):
    """Scans that cover the same campaigns are a small file, and a row for each of their campaigns."""
    from promoforge.operators import scan_fold

    source = F.concat(F.lit("src-"), F.col("id")).alias("source_id")
    spark.range(0, 60_000, 1, 1).select(source, F.lit(1).alias("turn"), F.lit(True).alias("complete"), F.lit(0).cast("timestamp").alias("scan_at"), F.array(
        *[F.lit(f"campaign-{m}") for m in range(9)]).alias("campaign_ids"), *[F.lit("x").alias(f"other{i}") for i in range(12)]).write.parquet(f"{tmp_path}/scans")
    segment = F.lit(None).cast(scan_fold.SEGMENT)
    spark.range(100).select(source, F.array(segment).alias("segments")).write.parquet(f"{tmp_path}/histories")
    rows = scan_fold.listed_before(spark.read.parquet(f"{tmp_path}/histories"), spark.read.parquet(f"{tmp_path}/scans"))
    plan = plan_of(rows.hint("merge"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def exchanged(rows):
    """Columns of each shuffle in the plan of ``rows``."""
    plan = rows._jdf.queryExecution().executedPlan()
    lines = plan.toString().split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line or "Exchange RoundRobin" in line]


def test_offers_of_a_batch_move_once(spark):
    """The copies that count are looked up where the batch lies: wide rows were dealt by address, and then by offer once more."""
    from promoforge.operators import reconcile as R
    from promoforge.plans.driver.reconcile_queries import lines

    copies = R.collapse_copies(lines(spark, "/root/testdata/sf0.001"), [F.col("_p1"), F.col("_p2")])
    assert exchanged(copies) == []
    joined = copies.join(R.accepted_offers(copies), R.KEY)
    assert exchanged(joined) == []


def test_addresses_are_numbers(spark, tmp_path):
    """An address of a path and a number took more room than what is elected by it."""
    from promoforge.operators.winners import elect, with_address

    spark.range(20).select((F.col("id") % 4).alias("k"), "id").write.parquet(f"{tmp_path}/rows")
    rows = with_address(spark.read.parquet(f"{tmp_path}/rows"))
    assert dict(rows.dtypes)["_file"] == "bigint"
    assert {r.k: r.id for r in elect(rows, ["k"], [F.col("id")], said=["id"]).collect()} == {0: 16, 1: 17, 2: 18, 3: 19}


def test_facts_tell_nulls_and_their_places(spark):
    from promoforge.operators.winners import facts_digest

    rows = spark.createDataFrame(
        [(1, None, None), (None, 1, None), (None, None, (None,)), (None, None, None), (1, None, None)], "a int, b int, c struct<d: string>")
    digests = [tuple(r) for r in rows.select(*facts_digest(rows, "a", "b", "c")).collect()]
    assert len(set(digests)) == 4 and digests[0] == digests[4]


def test_shuffle_files_go_with_their_step(tmp_path):
    """A query of many written steps kept the shuffles of all of them."""
    import subprocess
    import sys

    code = f"""
import glob, time
from pyspark.sql import SparkSession, functions as F
from promoforge.session import configure, written_once
spark = configure(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", "{tmp_path}/local")
    .config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.sql.shuffle.partitions", "2").getOrCreate())
rows = written_once(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
time.sleep(5)
left = glob.glob("{tmp_path}/local/**/shuffle_*.data", recursive=True)
assert not left, left
assert rows.count() == 7
"""
    (tmp_path / "local").mkdir()
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]), timeout=180)
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_a_streams_batches_leave_no_copy(spark, tmp_path, monkeypatch):
    """The micro-batch was written, and stayed in the shared folder after its commit."""
    from promoforge.plans.driver import reconcile_queries as Q
    from promoforge.session import shared_dir

    before = set(__import__("os").listdir(shared_dir(spark).removeprefix("file://")))
    assert Q.stream_availability(spark, "/root/testdata/sf0.001").count() == 150
    left = set(__import__("os").listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert not [name for name in left if name.startswith(("micro-batch", "incoming", "sighted", "histories"))]


def test_records_of_a_snapshot_are_compressed(spark, tmp_path, monkeypatch):
    """The JSON form was many times the tables; the bytes a snapshot states are still those of its lines."""
    from promoforge.plans.driver import snapshot_queries as Q

    monkeypatch.setattr(Q, "work_path", lambda spark, name: f"{tmp_path}/{name}")
    records = Q.snapshot_roundtrip(spark, "/root/testdata/sf0.001").count()
    files = list(tmp_path.glob("snapshot/v-*/records/part-*"))
    stated = spark.read.json(f"{tmp_path}/snapshot/_snapshots").first()
    assert stated.records == records and sum(f.stat().st_size for f in files) * 10 < stated.bytes


def test_products_of_leaflets_are_made_of_written_cells(spark):
    """What words and cells were shuffled by stayed until the products were made."""
    from promoforge.plans.driver.leaflet_queries import rect_products, rule_products

    for products in (rect_products, rule_products):
        rows = products(spark, "/root/testdata/sf0.001")
        assert "collect_list" not in plan_of(rows) and rows.count() > 0
