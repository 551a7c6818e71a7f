"""Spaced absences of offers from sightings: the batch form of the streaming counter.

A sighting resets; an absence counts if the last counted one is at least 30 minutes old; two withdraw. Only absences after the last
sighting matter, found with a partial aggregate. Which of them count depends on the one counted before, from the first to the last. To spread
a key over tasks its absences are cut into chunks of time. What a chunk needs to know of those before it is only the last
counted instant, and that decides only where counting starts in its first half hour: each chunk is summed up by the outcome (count, last
instant) of every start that makes a difference, following successor pointers for all starts at once. The summaries of a key are then
passed through in order, one row at a time. No row holds more than one instant or one outcome, and the work is linear in the absences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.values import ABSENCE_SPACING_SECONDS, ABSENCES_TO_WITHDRAW

SPACING = ABSENCE_SPACING_SECONDS * 1_000_000
# Absences of this much time are one chunk of a key.
CHUNK = 4 * SPACING


def _starts(rows: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Which rows begin a new group of equal values."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        column = rows.column(name)
        a, b = column.slice(0, max(0, len(column) - 1)), column.slice(1)
        differs = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def grouped(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches joined so that no group is cut, each with the places where its groups begin."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch, names)
        if waiting:
            # Does the first row go on with the group that waits?
            edge = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0]
            new[0] = _starts(edge, names)[1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            whole = pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks().to_batches()
            if whole:
                yield whole[0], np.flatnonzero(_starts(whole[0], names))
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
    if waiting:
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        yield whole, np.flatnonzero(_starts(whole, names))


def outcomes(instants: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk that begins at ``start``: greatest entry, count and last instant for each start of counting that makes a difference."""
    early = int(np.searchsorted(instants, start + SPACING))
    at = np.arange(min(early + 1, len(instants)))
    follow = np.searchsorted(instants, instants + SPACING)
    count = np.ones(len(at), np.int64)
    now = at.copy()
    while True:
        after = follow[now]
        going = after < len(instants)
        if not going.any():
            break
        count += going
        now = np.where(going, after, now)
    last = instants[now]
    # Neighbouring entries of one outcome are one; the greatest stands for them.
    ends = np.append((count[1:] != count[:-1]) | (last[1:] != last[:-1]), True)
    return instants[at][ends], count[ends], last[ends]


def _summaries(keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in grouped(batches, [*keys, "chunk"]):
            us, chunk = rows.column("us").to_numpy(), rows.column("chunk").to_numpy()
            ends = np.append(starts[1:], rows.num_rows)
            entry, count, last, row = [us[starts[ends - starts == 1]]], [], [], [starts[ends - starts == 1]]
            count.append(np.ones(len(entry[0]), np.int64))
            last.append(entry[0])
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                e, n, when = outcomes(us[a:b], int(chunk[a]) * CHUNK)
                entry.append(e)
                count.append(n)
                last.append(when)
                row.append(np.full(len(e), a))
            taken = rows.take(pa.array(np.concatenate(row)))
            columns = [taken.column(k) for k in (*keys, "chunk")] + [pa.array(np.concatenate(x)) for x in (entry, count, last)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "chunk", "entry", "n", "last"])

    return run


def _passed(keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in grouped(batches, keys):
            chunk, entry, n, last = (rows.column(c).to_numpy() for c in ("chunk", "entry", "n", "last"))
            counts, lasts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True)):
                total, before, done = 0, None, None
                for k in range(a, b):
                    if chunk[k] != done and (before is None or entry[k] - before >= SPACING):
                        total, before, done = total + int(n[k]), int(last[k]), chunk[k]
                counts[i], lasts[i] = total, before
            taken = rows.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*[taken.column(k) for k in keys], pa.array(counts), pa.array(lasts)], [*keys, "n", "last"])

    return run


def absence_state(sightings: DataFrame, keys: Sequence[str], ts: Column, seen: Column) -> DataFrame:
    """Per key: ``missing_count``, ``last_missing_us`` and ``withdrawn`` after all sightings; keys that are null are one key."""
    keys = list(keys)
    rows = sightings.select(*keys, F.unix_micros(ts).alias("us"), seen.alias("seen"))
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("seen"), F.col("us"))).alias("last_seen"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    absences = rows.where(~F.col("seen")).select(*keys, "us").distinct().alias("a").join(last.alias("l"), same)
    absences = absences.where(F.col("last_seen").isNull() | (F.col("us") > F.col("last_seen"))).select(*[F.col(f"a.{k}") for k in keys], "us")
    absences = absences.withColumn("chunk", F.floor(F.col("us") / CHUNK).cast("bigint"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in absences.select(*keys).schema)
    chunks = absences.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "us")
    summaries = chunks.mapInArrow(_summaries(keys), f"{names}, chunk bigint, entry bigint, n bigint, last bigint")
    passed = summaries.repartition(*keys).sortWithinPartitions(*keys, "chunk", "entry").mapInArrow(_passed(keys), f"{names}, n bigint, last bigint")
    count = F.coalesce(F.col("p.n"), F.lit(0))
    return last.alias("l").join(passed.alias("p"), [F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left").select(
        *[F.col(f"l.{k}") for k in keys], count.alias("missing_count"), F.col("p.last").alias("last_missing_us"), (count >= ABSENCES_TO_WITHDRAW).alias("withdrawn"))
