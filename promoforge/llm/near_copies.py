"""Near copies by exact similarity: pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

No pair is lost by sampling. Two sets of sizes a and b that similar have at least 0.8 max(a, b) shingles in common. So in any order common to
all sets, the first n - ceil(0.8 n) + k shingles of each hold the first k common ones (prefix filter with a margin). The first pass takes the
order of the hashes and a margin of a twentieth of the set: only a quarter of the shingles go through a shuffle, and a set goes on only if a
twentieth of it is met in others of fitting size. A shared passage of a few lines is not enough for that. The second pass takes the sets that are
left in full and orders their shingles from the rarest to the most frequent: shingles of one set alone come first and are met by nobody, so a set is
compared only if four fifths of it occur elsewhere too.

The sets left are linked first as op 2 links texts: by fingerprints (of five-word shingles here) within four bits, found by bit planes, and
confirmed by exact similarity. Most near copies differ in more than four bits, so the shingles are asked for the rest; pairs inside a group known
by then are not compared again.

Sets that meet at a shingle of at most ``FEW`` sets are compared pair by pair, each pair once. Those that meet at more frequent ones are
joined to groups, and a group is cut by size: near copies differ in size by less than a fourth, so sets are compared only inside two neighbouring
size classes. Classes are cut by hash into blocks, and blocks are compared two by two in tasks of their own; a task sends out
edges of a spanning forest, never all pairs. Both compare whole sets.

Defined cases: words are what ``simhash_planes`` takes for words; texts of fewer words than a shingle are one shingle, null, empty and
blank texts none, and equal sets are near copies; repeated rows and ids collapse to the smallest id of their set; an empty table gives
an empty result. Sets and shingles are known by 64-bit hashes. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.llm.common import slices, text_key
from promoforge.llm.components import connected_components
from promoforge.llm.simhash_planes import LOWER, WORD, fingerprint, first_of_groups, link_fingerprints
from promoforge.session import written_once

SHINGLE = 5
# Near copies have at least this Jaccard similarity: a numerator and a denominator.
SIMILAR = (4, 5)
# The first pass asks for one shared shingle in so many.
MARGIN = 20
# Shingles of up to so many sets give single pairs.
FEW = 32
# Sets of a block: a sixteenth of the group within these bounds.
BLOCK = (128, 2048)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1:] - 1).tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 7)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` that the first pass looks at."""
    above, below = SIMILAR
    return min(n, n + above * n // -below + max(1, n // MARGIN))


def least_shared(n: int) -> int:
    """How many of them a near copy of any size shares at least."""
    above, below = SIMILAR
    return max(1, -(above * n // -below) // MARGIN)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        short = [s[:prefix_length(len(s))] for s in sets]
        sizes = pa.array([len(s) for s in sets], pa.int32())
        least = pa.array([least_shared(len(s)) for s in sets], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), _longs([_set_key(s) for s in sets]), sizes, least, _lists(short)],
                                         ["id", "key", "set", "n", "least", "prefix"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.as_py() for t in batch.column("text")]
        sets = [shingle_set(t) for t in texts]
        yield pa.RecordBatch.from_arrays([_longs([_set_key(s) for s in sets]), _longs([fingerprint(t, SHINGLE) for t in texts]), _lists(sets)], ["set", "print", "tokens"])


def forest(keys: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Star edges of the components of near copies among non-empty sets."""
    above, below = SIMILAR
    left: list[int] = []
    right: list[int] = []
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    todo = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not todo[start]:
            continue
        todo[start] = False
        front = [start]
        while front and todo.any():
            at = front.pop()
            own = codes[starts[at]:starts[at] + sizes[at]]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[own] = 0
            reached = np.flatnonzero(todo & (below * both >= above * (sizes + sizes[at] - both))).tolist()
            todo[reached] = False
            front += reached
            left += [keys[start]] * len(reached)
            right += [keys[i] for i in reached]
    return left, right


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of (task, set, tokens) rows sorted by task; the last task of a batch waits for the next."""
    task, keys, sets = None, [], []

    def emit():
        a, b = forest(keys, sets) if len(keys) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        columns = batch.column("task").to_pylist(), batch.column("set").to_pylist(), batch.column("tokens")
        for now, key, tokens in zip(*columns, strict=True):
            if now != task:
                yield emit()
                task, keys, sets = now, [], []
            keys.append(key)
            sets.append(tokens.values.to_numpy())
    yield emit()


def _needed(n: Column) -> Column:
    """Shingles that a set of ``n`` shares with each near copy at least."""
    return F.ceil(n * SIMILAR[0] / SIMILAR[1]).cast("int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are near copies."""
    pairs = pairs.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("tb")), "b")
    pairs = pairs.select("a", "b", (F.size("ta") + F.size("tb")).alias("total"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    return pairs.where(F.col("both") * SIMILAR[1] >= (F.col("total") - F.col("both")) * SIMILAR[0]).select("a", "b")


def link_by_planes(sets: DataFrame) -> DataFrame:
    """Edges (a, b) of the sets whose texts' fingerprints the bit planes link, as far as they are near copies; ``sets`` (set, print, tokens) are stored."""
    heads = written_once(sets.groupBy("print").agg(F.min("set").alias("head")), "copies-prints")
    equal = sets.join(heads, "print").where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    left, right = heads.select(F.col("print").alias("a"), F.col("head").alias("ha")), heads.select(F.col("print").alias("b"), F.col("head").alias("hb"))
    near = link_fingerprints(heads.select("print")).distinct().join(left, "a").join(right, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    return _confirmed(equal.unionByName(near), sets)


def link_sets(sets: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose components, with those of ``linked``, are those of all near copies; ``sets`` (set, tokens) are distinct and stored.

    ``linked`` (node, component) are groups of near copies known before: pairs inside one are not compared again.
    """
    each = sets.select("set", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = written_once(each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "copies-common")
    known = each.join(common, "token").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("known"))
    more = F.size("known") - _needed(F.col("n")) + 1
    placed = known.where(more > 0).select("set", "n", F.explode(F.slice("known", 1, more)).alias("k")).select("set", "n", "k.token")
    placed = written_once(placed, "copies-placed")
    met = placed.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("set").alias("head")).where("m > 1")
    met = written_once(met, "copies-met")
    # Single pairs.
    few = placed.join(met.where(F.col("m") <= FEW).select("token"), "token")
    pairs = few.select("token", F.col("set").alias("a"), F.col("n").alias("na")).join(few.select("token", F.col("set").alias("b"), F.col("n").alias("nb")), "token")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.least("na", "nb") * SIMILAR[1] >= F.greatest("na", "nb") * SIMILAR[0])).select("a", "b").distinct()
    if linked is not None:
        for side in ("a", "b"):
            pairs = pairs.join(linked.select(F.col("node").alias(side), F.col("component").alias(f"known_{side}")), side, "left")
        pairs = pairs.where(~F.coalesce(F.col("known_a") == F.col("known_b"), F.lit(False))).select("a", "b")
    pairs = _confirmed(pairs, sets)
    # Groups of sets that meet at frequent shingles, cut by size: each class with the next larger one.
    many = placed.join(met.where(F.col("m") > FEW).select("token", "head"), "token").select("set", "head").distinct()
    groups = connected_components(many, "set", "head").join(sets.select(F.col("set").alias("node"), F.size("tokens").alias("n")), "node")
    size_class = F.floor(F.log(SIMILAR[1] / SIMILAR[0] + 0.01, "n")).cast("int")
    groups = written_once(groups.select("component", "node", size_class.alias("class")), "copies-groups")
    arenas = groups.select("node", "class", "component", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("arena"))
    sizes = arenas.groupBy("component", "arena").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("class") == F.col("arena")).alias("own")).where("own > 0 and size > 1")
    sizes = sizes.select("component", "arena", F.ceil(F.col("size") / F.least(F.greatest(F.col("size") / 16, F.lit(BLOCK[0])), F.lit(BLOCK[1]))).cast("int").alias("blocks"))
    inside = arenas.join(sizes, ["component", "arena"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))).alias("other")
    tasks = inside.select("component", "arena", "block", F.col("node").alias("set"), other).select(
        F.xxhash64("component", "arena", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "set")
    ordered = tasks.join(sets, "set").select("task", "set", "tokens").repartition("task").sortWithinPartitions("task")
    return pairs.unionByName(ordered.mapInArrow(_forests, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, ``key`` (see ``text_key``), ``set`` and ``component`` (smallest id reachable)."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    read = written_once(text.mapInArrow(_prefixes, "id long, key binary, set long, n int, least int, prefix array<bigint>"), "copies-read")
    # Sets that share enough shingles of the first pass with others of fitting size.
    first = read.dropDuplicates(["set"]).select("set", "n", "least", F.explode("prefix").alias("token"))
    met = first.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"))
    met = written_once(met.where((F.col("sets") > 2) | ((F.col("sets") == 2) & (F.col("low") * SIMILAR[1] >= F.col("high") * SIMILAR[0]))).select("token"), "copies-met")
    shared = first.join(met, "token").groupBy("set", "least").agg(F.count(F.lit(1)).alias("shared"))
    maybe = shared.where("shared >= least").select("set")
    texts = written_once(read.select("set", "key").join(maybe, "set", "left_semi").groupBy("set").agg(F.min("key").alias("key")), "copies-texts")
    again = text.join(texts.select("key"), "key", "left_semi").select("text")
    sets = written_once(again.mapInArrow(_whole_sets, "set long, print long, tokens array<bigint>").dropDuplicates(["set"]), "copies-sets")
    near = written_once(link_by_planes(sets), "copies-near")
    edges = written_once(link_sets(sets, connected_components(near)).unionByName(near).distinct(), "copies-edges")
    heads = written_once(read.groupBy("set").agg(F.min("id").alias("head")), "copies-heads")
    groups = connected_components(edges)
    placed = heads.join(groups, heads["set"] == groups["node"], "left").select("set", "head", F.coalesce("component", "set").alias("group"))
    placed = written_once(placed, "copies-components")
    least = placed.groupBy("group").agg(F.min("head").alias("component"))
    named = placed.join(least, "group").select("set", "component")
    return read.join(named, "set").select("id", "key", "set", "component")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; rows without id all stay."""
    return first_of_groups(docs, near_copies(docs, id_col, text_col), id_col, text_col)
