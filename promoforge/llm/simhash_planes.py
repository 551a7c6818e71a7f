"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in tasks that read whole texts. Equal fingerprints collapse first. A pair within four
differing bits agrees on at least two of six blocks of the 64 bits, so each fingerprint goes to the 15 buckets
of its block pairs. Inside a bucket the bits are stored as 64 vertical planes, one bit of 64 fingerprints to a
machine word; a fingerprint is compared with 64 others at once by adding the differing planes into carry-save
counters, and a word is abandoned as soon as all its lanes exceed the radius. A bucket of more than ``BLOCK``
fingerprints is cut by hash into blocks that are compared two by two in different tasks. Of every comparison
only the edges of a spanning forest leave the task, never all pairs of a group.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows and
ids collapse to the smallest id of their fingerprint; null ids get a fingerprint and the component of
it; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import fresh, text_key
from promoforge.llm.components import connected_components
from promoforge.session import written_once

RADIUS = 4
SHINGLE = 4
# Widths of the six blocks of the 64 bits, from the low end.
BLOCKS = (11, 11, 11, 11, 10, 10)
BLOCK = 2048
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER = bytes.maketrans(*UPPER)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1:] - 1).tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 4096):
        count += np.unpackbits(values[at:at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(prints)], ["id", "key", "print"])


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes, shape (64, words): lane i of word w of plane p is bit p of fingerprint 64 w + i."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query fingerprint, word of 64 lanes): the lanes within ``radius`` bits, as a 64-bit mask.

    Four carry-save counter planes hold the distance of every lane; the eights are sticky.
    """
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    ones = twos = fours = eights = np.zeros(len(queries), np.uint64)
    full = ~np.uint64(0)
    for p in range(64):
        mask = np.uint64(0) - ((queries >> np.uint64(p)) & np.uint64(1))
        carry = planes[p][words] ^ mask
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        fours, carry = fours ^ carry, fours & carry
        eights = eights | carry
        if p % 8 == 7:
            over = _exceeds(ones, twos, fours, eights, radius)
            if p == 63:
                out[live] = ~over
                break
            stay = over != full
            if not stay.all():
                live, queries, words = live[stay], queries[stay], words[stay]
                ones, twos, fours, eights = ones[stay], twos[stay], fours[stay], eights[stay]
                if not len(live):
                    break
    return out


def _exceeds(ones, twos, fours, eights, radius: int):
    """Lanes whose counter is above ``radius`` (below eight): compared bit by bit from the top."""
    above, equal = eights, ~eights
    for plane, weight in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & weight:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def _forest(prints: np.ndarray, masks: np.ndarray) -> tuple[list[int], list[int]]:
    """Star edges of the components of one group; ``masks`` (n, words) says which lanes are near."""
    left, right, todo = [], [], np.ones(len(prints), bool)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :len(prints)].astype(bool)
    for start in range(len(prints)):
        if not todo[start]:
            continue
        todo[start] = False
        front = np.array([start])
        while len(front):
            reached = bits[front].any(axis=0) & todo
            front = np.flatnonzero(reached)
            todo[front] = False
            left += [int(prints[start])] * len(front)
            right += prints[front].tolist()
    return left, right


def group_edges(keys: np.ndarray, prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning edges within each run of equal ``keys``; runs are whole and bounded by two blocks."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(keys)])))
    left: list[int] = []
    right: list[int] = []
    # Small groups share machine words: each lies inside one.
    small = [(int(c), int(n)) for c, n in zip(cuts, sizes, strict=True) if 2 <= n <= 64]
    if small:
        place, at = [], 0
        for _, n in small:
            if at % 64 + n > 64:
                at += 64 - at % 64
            place.append(at)
            at += n
        lanes = np.zeros(-(-at // 64) * 64, np.uint64)
        for (c, n), p in zip(small, place, strict=True):
            lanes[p:p + n] = prints[c:c + n]
        planes = planes_of(lanes)
        count = np.array([n for _, n in small])
        first = np.repeat(np.array(place), count)
        where = first + np.concatenate([np.arange(n) for n in count])
        width = np.repeat(count, count).astype(np.uint64)
        own = (~np.uint64(0) >> (np.uint64(64) - width)) << (first % 64).astype(np.uint64)
        later = own & ~((np.uint64(2) << (where % 64).astype(np.uint64)) - np.uint64(1))
        masks = near_lanes(planes, lanes[where], where // 64)
        ahead = masks & later
        group = np.repeat(np.arange(len(small)), count)
        offset = (np.cumsum(count) - count).tolist()
        for g in np.unique(group[ahead != 0]).tolist():
            c, n = small[g]
            rows = slice(offset[g], offset[g] + n)
            near = ((masks[rows] & own[rows]) >> np.uint64(place[g] % 64)).reshape(-1, 1)
            a, b = _forest(prints[c:c + n], near)
            left += a
            right += b
    for c, n in zip(cuts.tolist(), sizes.tolist(), strict=True):
        if n > 64:
            part = prints[c:c + n]
            planes = planes_of(part)
            across = planes.shape[1]
            masks = np.empty((n, across), np.uint64)
            for at in range(0, n, 1024):
                rows = part[at:at + 1024]
                masks[at:at + 1024] = near_lanes(planes, np.repeat(rows, across), np.tile(np.arange(across), len(rows))).reshape(-1, across)
            a, b = _forest(part, masks)
            left += a
            right += b
    return left, right


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted (task, print) rows; the last group of a batch waits for the next."""
    def emit(keys, prints):
        a, b = group_edges(keys, prints)
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate((keys, batch.column("task").to_numpy()))
        prints = np.concatenate((prints, batch.column("print").to_numpy().view(np.uint64)))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield emit(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield emit(keys, prints)


def _bucket_keys():
    """The 15 bucket keys of column ``print``: number of the block pair above the bits of both blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]

    def bits(i):
        return F.shiftrightunsigned("print", starts[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1).cast("long"))

    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    return F.array(*[(F.lit(number << 22).cast("long") + bits(i) * (1 << 11) + bits(j)).alias("key") for number, (i, j) in enumerate(pairs)])


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the radius; ``prints`` are distinct."""
    placed = written_once(prints.select(F.explode(_bucket_keys()).alias("key"), "print"), "simhash-buckets")
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written_once(counts.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-counts")
    sharing = placed.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    # With one block the bucket is its own task; with more, each pair of blocks is a task.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))).alias("other")
    tasks = sharing.select("key", "block", "print", other).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "print")
    ordered = tasks.repartition("task").sortWithinPartitions("task", "print")
    return ordered.mapInArrow(_edges, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, ``key`` (see ``text_key``), ``print`` (signed 64 bits) and ``component`` (smallest id reachable)."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    read = written_once(text.mapInArrow(_fingerprints, "id long, key binary, print long"), "simhash-prints")
    heads = written_once(read.groupBy("print").agg(F.min("id").alias("head")), "simhash-heads")
    edges = written_once(link_fingerprints(heads.select("print")).distinct(), "simhash-edges")
    groups = connected_components(edges)
    placed = heads.join(groups, heads["print"] == groups["node"], "left").select("print", "head", F.coalesce("component", "print").alias("group"))
    placed = written_once(placed, "simhash-groups")
    least = placed.groupBy("group").agg(F.min("head").alias("component"))
    named = placed.join(least, "group").select("print", "component")
    return read.join(named, "print").select("id", "key", "print", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id; rows without id all stay.

    Repeated rows of one id stay once if they are equal in all columns.
    """
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def first_of_groups(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that ``found`` (id, key, component) names as the first of their group, and those without id."""
    head, key = fresh("head"), fresh("key")
    heads = found.where("id = component").select(F.col("id").alias(head), F.col("key").alias(key)).distinct()
    named = docs.where(docs[id_col].isNotNull())
    ids = found.where("id is not null").agg(F.count("id").alias("n"), F.count_distinct("id").alias("ids")).first()
    kept = (named if ids.n == ids.ids else named.dropDuplicates()).join(heads, (docs[id_col].cast("long") == heads[head]) & (text_key(docs[text_col]) == heads[key]), "left_semi")
    return kept.unionByName(docs.where(docs[id_col].isNull()))
