"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else started.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot source or page is split at run time even where an aggregate follows the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows take up to thirty times the room of their Parquet file, and half as much again where that is written with zstd, and sides of joins are broadcast by that size: without the
    # factor, key columns of millions of rows count as a few MB and are built up in the driver. Sizes measured at run time stay as they are.
    "spark.sql.sources.fileCompressionFactor": "45",
    # What a written result was shuffled by goes when it is written, not when the driver happens to collect its garbage: a query of many
    # steps holds the shuffles of one step. A DataFrame that is run again shuffles again.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A task writes a few folders or buckets side by side instead of sorting its rows by them.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Page bodies travel to Python in Arrow batches; keep a batch to a few hundred pages.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Recording the Python call site of every expression costs more than planning a search.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with the cluster."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of this machine; on a cluster a
    missing setting is an error, because a lost node would take the data with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="promoforge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Tables written inside the innermost ``spent_after``, if there is one.
_SPENT: ContextVar[list[str] | None] = ContextVar("spent", default=None)


@contextmanager
def spent_after(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written_once`` wrote inside, once all inside is done; if it fails they stay.

    For work that ends in a written result: nothing read lazily later may come from a table written
    inside, except those marked ``keep``.
    """
    paths: list[str] = []
    token = _SPENT.set(paths)
    try:
        yield
    finally:
        _SPENT.reset(token)
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written_once(rows: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Rows stored in the shared folder and read from there.

    For results of costly work that several plans use: it is done once, survives the loss of
    an executor, and each user reads only the columns it needs. ``keep``: also beyond ``spent_after``.
    """
    path = work_path(rows.sparkSession, name)
    spent = _SPENT.get()
    if spent is not None and not keep:
        spent.append(path)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _table_name(path: str) -> str:
    return re.sub(r"\W", "_", path.rsplit("/", 1)[1])


def written_in_buckets(rows: DataFrame, name: str, keys: Sequence[str], multiple_of: int = 1) -> DataFrame:
    """As :func:`written_once`, dealt by ``keys`` into buckets of a file each: the one time these rows are shuffled, as joins and aggregates by all
    of the keys find them together. Buckets are as many as shuffles have partitions, rounded up to a multiple of ``multiple_of``: a table of that many buckets has its own rows in each.
    """
    spark = rows.sparkSession
    path = work_path(spark, name)
    spent = _SPENT.get()
    if spent is not None:
        spent.append(path)
    buckets = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // multiple_of) * multiple_of
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("compression", "zstd").option("path", path).saveAsTable(_table_name(path))
    return spark.table(_table_name(path))
