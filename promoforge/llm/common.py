"""Column helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words: space and the six ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows, so that what a task makes of a batch stays small; memory that is free again goes back in between."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def fresh(name: str) -> str:
    """A column name no input column can have by accident."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that names an outer expression would compute it again for every element; bound to a
    lambda variable it is computed once.
    """
    return F.transform(F.array(value), body)[0]


def blank_words(text: Column) -> Column:
    """Words between blanks, in order; no words for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")
