"""Removal of repeated byte strings by induction from sampled suffixes.

The question for every byte position is whether the 100 bytes that start there also start earlier. Sorting a tuple
for each byte costs many times the input in disk (see README), so, as in induced sorting, only a sample of the suffixes
is sorted and the rest follows from it. The sample is content-defined: the suffix at the smallest 32-byte hash of every
100-byte string, which is the same offset in equal strings. Each sampled suffix carries a tuple (hash of its first 32 bytes,
hash of the whole stretch that the strings it stands for cover, document, position), and Spark's external sort, which spills
to disk, brings equal prefixes together:

1. Tuples with an equal prefix and stretch after the first of them: all their strings are repeated.
2. First tuples whose prefix is shared by other stretches: their strings are compared one by one with the earlier ones of the
   same prefix, which carries the common parts to the left and right of it over to every position in between.
3. First tuples alone with their prefix: none of their strings is repeated.

Equality is that of two 64-bit hashes together. Within a task equal tuples are reduced before they are shuffled; what is
thereby known to be repeated is dealt out evenly. A prefix shared by many different stretches is compared by a
grouping over all tasks instead of inside one.

Defined cases: null texts are empty; texts below the length have nothing removed; rows with equal id and text are one document and
get the same result; null ids come last; empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promoforge.llm.common import text_key
from promoforge.session import written_once

LENGTH = 100
PREFIX = 32
# Start positions treated at a time within one text, and tuples of one prefix compared inside one task.
CHUNK = 1 << 18
IN_TASK = 2048
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64((1 << 24) - 1)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _joined(a, b):
    return _mixed(a * _B + (b ^ _C))


def _prefixes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-byte strings and hashes of 32-byte strings at every position that has them."""
    wide = data.astype(np.uint64)
    two = wide[:-1] | wide[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    h = _mixed(four[:-4] | four[4:] << np.uint64(32))
    h = _joined(h[:-8], h[8:])
    return four, _joined(h[:-16], h[16:])


def _strings(four: np.ndarray, h: np.ndarray, at) -> np.ndarray:
    """Hashes of the 100-byte strings at positions ``at``."""
    return _joined(_joined(_joined(h[at], h[at + 32]), h[at + 64]), four[at + 96])


def sampled(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples (prefix, stretch, first start, strings, offset of the suffix) of one text, a chunk at a time."""
    for base in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[base:base + CHUNK + LENGTH - 1]
        four, h = _prefixes(part)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32, 5):
            least = np.minimum(least[:-step], least[step:])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        offset, count = place[first] - first, last - first + 1
        stretch = _joined(_joined(_strings(four, h, first), _strings(four, h, last)), (offset * 128 + count).astype(np.uint64))
        yield h[place[first]], stretch, base + first, count, offset


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled tuples of each batch; ``known`` marks those that repeat an earlier tuple of the batch."""
    for batch in batches:
        docs, found = batch.column("doc").to_numpy(), []
        for row, text in enumerate(batch.column("text")):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            found += [(np.full(len(x[0]), docs[row]), *x) for x in sampled(data)] if len(data) >= LENGTH else []
        if not found:
            continue
        doc, prefix, stretch, start, count, offset = (np.concatenate([x[k] for x in found]) for k in range(6))
        order = np.lexsort((start, doc, stretch, prefix))
        same = np.concatenate(([False], (prefix[order][1:] == prefix[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])))
        known = np.zeros(len(doc), bool)
        known[order] = same
        # What is known need not meet anything: any even key will do.
        prefix = np.where(known, _joined(doc.astype(np.uint64), start.astype(np.uint64)), prefix)
        yield pa.RecordBatch.from_arrays([
            pa.array(known), pa.array(prefix.view(np.int64)), pa.array(np.where(known, np.uint64(0), stretch).view(np.int64)),
            pa.array(doc), pa.array((start.astype(np.int64) << 16) | (count << 8) | offset)], ["known", "prefix", "stretch", "doc", "at"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each listed stretch."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            rows += [(w["prefix"], w["many"], doc, w["at"], data[w["at"] >> 16:(w["at"] >> 16) + (w["at"] >> 8 & 255) + LENGTH - 1]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))], ["prefix", "many", "doc", "at", "bytes"])


def _string_hashes(data: bytes) -> np.ndarray:
    four, h = _prefixes(np.frombuffer(data, np.uint8))
    return _strings(four, h, np.arange(len(data) - LENGTH + 1))


def _runs(hit: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Byte ranges covered by the strings marked in ``hit``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield start + a, start + b + LENGTH - 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of tuples sorted by (prefix, doc, at): those an earlier tuple of the prefix holds."""
    now, seen = None, set()
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for prefix, doc, at, data in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc", "at", "bytes")), strict=True):
            if prefix != now:
                now, seen = prefix, set()
            strings = _string_hashes(data).tolist()
            hit = []
            for s in strings:
                hit.append(s in seen)
                seen.add(s)
            if any(hit):
                out += [(doc, a, b) for a, b in _runs(np.array(hit), at >> 16)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["doc", "start", "end"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for prefix, doc, at, data in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc", "at", "bytes")), strict=True):
            strings = _string_hashes(data)
            n = len(strings)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, prefix)), pa.array(strings.view(np.int64)), pa.array(np.full(n, doc)),
                                              pa.array((at >> 16) + np.arange(n))], ["prefix", "string", "doc", "start"])


def _merged(cut: list[dict]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for c in sorted((x["start"], x["end"]) for x in cut):
        if runs and c[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], c[1])
        else:
            runs.append(list(c))
    return [(a, b) for a, b in runs]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, cut in zip(batch.column("text"), batch.column("cut").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            runs = _merged(cut or [])
            places = [0, *[x for run in runs for x in run], len(data)]
            sizes.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
                                          pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["id", "n_bytes", "spans", "kept", "kept_sha256"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (id, text) with ``doc``, a number in the order of the ids, and whether each row has its own:
    then the ids themselves are the numbers."""
    unique = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if unique.n == unique.ids:
        return docs.withColumn("doc", F.col("id")), True
    keyed = docs.withColumn("key", text_key(F.col("text")))
    ranked = keyed.select("id", "key").distinct().orderBy(F.col("id").asc_nulls_last(), "key").withColumn("doc", F.monotonically_increasing_id())
    ranked = written_once(ranked.select(F.col("id").alias("ri"), F.col("key").alias("rk"), "doc"), "document-numbers")
    return keyed.join(ranked, F.col("id").eqNullSafe(F.col("ri")) & (F.col("key") == F.col("rk"))).select("id", "text", "doc"), False


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end): byte ranges of ``docs`` (doc, text) made of repeated strings; they may overlap."""
    docs = docs.select("doc", "text")
    tuples = docs.mapInArrow(_tuples, "known boolean, prefix long, stretch long, doc long, at long")
    ordered = Window.partitionBy("known", "prefix").orderBy("stretch", "doc", "at")
    sorted_ = tuples.repartition("known", "prefix")
    before = F.lag("stretch").over(ordered)
    marked = sorted_.withColumn("first", F.col("known") | before.isNull() | (before != F.col("stretch")))
    marked = marked.withColumn("stretches", F.sum(F.col("first").cast("long")).over(Window.partitionBy("known", "prefix")))
    kept = written_once(marked.where("known or not first or stretches > 1").select(
        "prefix", "doc", "at", (F.col("known") | ~F.col("first")).alias("whole"), (F.col("stretches") > IN_TASK).alias("many")), "suffix-tuples")

    start, count = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    whole = kept.where("whole").select("doc", start.alias("start"), (start + count + (LENGTH - 1)).alias("end"))
    wanted = kept.where("not whole").groupBy("doc").agg(F.collect_list(F.struct("prefix", "many", "at")).alias("wanted"))
    context = written_once(docs.join(wanted, "doc").mapInArrow(_contexts, "prefix long, many boolean, doc long, at long, bytes binary"), "suffix-contexts")
    few = context.where("not many").repartition("prefix").sortWithinPartitions("prefix", "doc", "at").mapInArrow(_compared, "doc long, start long, end long")
    # A prefix of very many stretches: each string finds its first start by a grouping with partial sums.
    strings = context.where("many").mapInArrow(_exploded, "prefix long, string long, doc long, start long")
    strings = written_once(strings, "suffix-strings")
    heads = strings.groupBy("prefix", "string").agg(F.min(F.struct("doc", "start")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = strings.join(heads, ["prefix", "string"]).where(F.struct("doc", "start") != F.col("head"))
    return whole.unionByName(few).unionByName(later.select("doc", "start", (F.col("start") + LENGTH).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_bytes, ``spans`` (removed byte ranges), ``kept`` (remaining bytes) and their SHA-256."""
    given, unique = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    cut = repeated_spans(given if unique else given.dropDuplicates(["doc"])).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    kind = "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    return given.join(cut, "doc", "left").select("id", "text", "cut").mapInArrow(_rest, kind)
