"""Scan batches arriving as files, reconciled into a stored catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promoforge.plans.publish import publish_scans
from promoforge.schemas import OFFER, SCAN
from promoforge.sources.catalog import CatalogStore

# One row per offer with the header of its scan; a scan that found nothing has one row without.
BATCH = T.StructType([T.StructField("scan", SCAN), T.StructField("pos", T.LongType()), T.StructField("offer", OFFER)])


def apply_batch(store: CatalogStore, batch: DataFrame) -> None:
    """Reconcile all scans of one micro-batch at once, a source's scans in the order they were made.

    Repeats and late scans fall to the fence of :func:`publish_scans`, so a replayed micro-batch
    after a failure changes nothing. The batch is read from its source twice, once for the headers alone; its offers are
    written once, by the commit that takes them.
    """
    offers = batch.where(F.col("offer").isNotNull()).select(F.col("scan.scan_id").alias("scan_id"), "pos", "offer.*")
    publish_scans(store, offers, batch.select("scan.*").distinct(), [F.col("pos")])


def ingest(spark: SparkSession, inbox: str, store: CatalogStore, checkpoint: str, max_files: int = 10_000, **trigger) -> StreamingQuery:
    """Watch ``inbox`` for Parquet scan batches; one file (or an atomic move) per scan, ``max_files`` of them to a micro-batch."""
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", max_files).parquet(inbox)
    return (
        stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
