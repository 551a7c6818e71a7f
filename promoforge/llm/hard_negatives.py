"""Hard negatives: for each anchor and each of its best positives, the rows of another label that score nearly as high.

Scores are exact integer inner products, computed in a residue number system: components become integers, the integers become residues
modulo several small primes, and one float32 matrix product per prime gives the residues of all scores of a tile. A residue is at most half
its prime in size, so a sum of up to ``2**24 / (prime / 2)**2`` products is exact in float32; longer vectors are summed in such
pieces. The Chinese remainder theorem (mixed radix, in 64-bit integers) gives back the signed score. As many primes are taken as the largest
component and the longest vector need, and a table whose scores could reach 2**58 is refused.

Anchors and rows are cut into blocks by a hash of their id; each pair of an anchor block and a row block is one group of one task, of bounded
size, and sends out only the best few rows per anchor (and positive). Windows then pick among those, and Spark limits ranks before
the exchange too. A first round finds the positives, a second one, knowing their scores, the negatives; no score is stored.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; rows that share an id count once (the least label,
then vector, stays); vectors of different lengths are taken as filled up with zeros; anchors without positives and positives without
negatives give no rows; ties go to the smaller id; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoforge.session import written_once

# Moduli of the residue number system, the largest primes of eight bits first.
PRIMES = tuple(p for p in range(255, 2, -1) if all(p % d for d in range(2, 16)))
# Scores stay below this size, so that twenty times a score fits 64 bits.
MOST = 1 << 58
# Rows of a block, in the mean; anchors of a block; anchors of a tile.
ROWS, ANCHORS, TILE = 4096, 2048, 512
NONE = np.iinfo(np.int64).min


def moduli(bound: int) -> tuple[int, ...]:
    """The primes whose residues tell apart all integers from -bound to bound."""
    if bound >= MOST:
        raise ValueError(f"scores of up to {bound} do not fit 64-bit arithmetic")
    product, taken = 1, []
    for p in PRIMES:
        if product > 2 * bound:
            break
        product *= p
        taken.append(p)
    return tuple(taken)


def residues(rows: np.ndarray, prime: int) -> np.ndarray:
    """Residues of integers in float32, from -prime // 2 to prime // 2."""
    low = np.mod(rows, prime)
    return np.where(low > prime // 2, low - prime, low).astype(np.float32)


def products(left: list[np.ndarray], right: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of all pairs of rows, from their residues by prime."""
    total, radix = None, 1
    for prime, a, b in zip(primes, left, right, strict=True):
        piece = max(1, (1 << 24) // (prime // 2) ** 2)
        rest = None
        for start in range(0, max(1, a.shape[1]), piece):
            part = np.rint(a[:, start:start + piece] @ b[:, start:start + piece].T).astype(np.int64)
            rest = part if rest is None else (rest + part) % prime
        if total is None:
            total = rest % prime
        else:
            # The next digit of the mixed-radix number.
            total = total + radix * ((rest - total) % prime * pow(radix, -1, prime) % prime)
        radix *= prime
    return np.where(total > radix // 2, total - radix, total)


class _Side:
    """One side of a group: ids in order, labels, and residues by prime."""

    def __init__(self, rows: pa.Table, width: int, primes: tuple[int, ...]):
        ids = rows.column("id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[self.order], rows.column("label").to_numpy()[self.order]
        lists = rows.column("vector").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = lists.value_lengths().to_numpy()
        full = np.zeros((len(lengths), width))
        full[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
        self.residues = [residues(full[self.order], p) for p in primes]


def _best(scores: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of the greatest scores of each row, the first column where equal; ``scores`` is used up."""
    for _ in range(min(count, scores.shape[1])):
        at = scores.argmax(axis=1)
        rows = np.flatnonzero(scores[np.arange(len(at)), at] > NONE)
        if not len(rows):
            return
        yield rows, at[rows], scores[rows, at[rows]]
        scores[rows, at[rows]] = NONE


def _tiles(anchors: _Side, rows: _Side, primes: tuple[int, ...]) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(anchors.ids), TILE):
        part = slice(start, start + TILE)
        yield part, products([r[part] for r in anchors.residues], rows.residues, primes)


def _frame(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate([np.zeros(0, np.int64), *parts])) for name, parts in columns.items()})


def _positives(width: int, primes: tuple[int, ...], count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"anchor": [], "positive": [], "score": []}
        if len(anchors) and len(rows):
            a, b = _Side(anchors, width, primes), _Side(rows, width, primes)
            for part, scores in _tiles(a, b, primes):
                scores[(a.labels[part, None] != b.labels) | (a.ids[part, None] == b.ids)] = NONE
                for r, c, score in _best(scores, count):
                    for name, values in (("anchor", a.ids[part][r]), ("positive", b.ids[c]), ("score", score)):
                        found[name].append(values)
        return _frame(found)

    return run


def _negatives(width: int, primes: tuple[int, ...], count: int, low: Fraction, high: Fraction):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"anchor": [], "positive": [], "score": [], "negative": [], "other": []}
        if len(anchors) and len(rows):
            a, b = _Side(anchors, width, primes), _Side(rows, width, primes)
            chosen = anchors.column("positives").to_pylist()
            chosen = [chosen[i] for i in a.order]
            for part, scores in _tiles(a, b, primes):
                scores[a.labels[part, None] == b.labels] = NONE
                here = chosen[part]
                for k in range(max(map(len, here))):
                    own = np.flatnonzero([len(p) > k for p in here])
                    ids, said = (np.array([here[i][k][f] for i in own], np.int64) for f in ("positive", "score"))
                    mine = scores[own]
                    away = (mine == NONE)
                    mine[away] = 0
                    away |= (low.denominator * mine < low.numerator * said[:, None]) | (high.denominator * mine > high.numerator * said[:, None])
                    mine[away] = NONE
                    for r, c, score in _best(mine, count):
                        for name, values in (("anchor", a.ids[part][own[r]]), ("positive", ids[r]), ("score", said[r]), ("negative", b.ids[c]), ("other", score)):
                            found[name].append(values)
        return _frame(found)

    return run


def _rank(rows: DataFrame, keys: list[str], score: str, tie: str, count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie))
    return rows.withColumn("rank", place).where(F.col("rank") <= count)


def _blocks(rows: DataFrame, size: int) -> int:
    return max(1, ceil(rows.count() / size))


def mine_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5,
                   negatives: int = 3, low: Fraction = Fraction(1, 2), high: Fraction = Fraction(19, 20), scale: int = 256) -> DataFrame:
    """One row per negative found: anchor, positive, rank, negative, positive_score, negative_score (all long, rank int).

    Components count as ``floor(scale * x)``. A positive is one of the ``positives`` best other rows of the anchor's label; a negative is one of
    the ``negatives`` best rows of another label whose score lies between ``low`` and ``high`` times the positive's, both included.
    ``is_anchor`` is a condition on the columns of ``rows``.
    """
    if max(low.denominator, high.denominator, abs(low.numerator), abs(high.numerator)) > 20:
        raise ValueError("shares of the positive score are fractions of at most 20")
    vector = F.transform(rows[vector_col].cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    given = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("raw"),
                        vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select("id", "label", "vector", "anchor")
    known = given.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*")
    known = written_once(known, "negatives-rows")
    top = known.agg(F.max(F.size("vector")), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()
    width, largest = top[0] or 0, int(top[1] or 0)
    primes = moduli(max(1, width * largest * largest))
    n_rows, n_anchors = _blocks(known, ROWS), _blocks(known.where("anchor"), ANCHORS)

    def spread(side: DataFrame, own: int, others: int, seed: int, mine: str, theirs: str) -> DataFrame:
        """Each row with its own block and every block of the other side. Both are integers of one type: equal numbers of two types hash to different partitions."""
        return side.withColumn(mine, F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    side = ["id", "label", "vector"]
    against = spread(known.select(*side), n_rows, n_anchors, 1, "r", "a").groupBy("a", "r")
    anchors = known.where("anchor").select(*side)
    first = spread(anchors, n_anchors, n_rows, 2, "a", "r").groupBy("a", "r").cogroup(against).applyInArrow(
        _positives(width, primes, positives), "anchor long, positive long, score long")
    best = _rank(first, ["anchor"], "score", "positive", positives)
    best = best.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("positives"))
    ready = written_once(anchors.join(best, anchors["id"] == best["anchor"]).select(*side, "positives"), "negatives-anchors")
    second = spread(ready, n_anchors, n_rows, 2, "a", "r").groupBy("a", "r").cogroup(against).applyInArrow(
        _negatives(width, primes, negatives, low, high), "anchor long, positive long, score long, negative long, other long")
    return _rank(second, ["anchor", "positive"], "other", "negative", negatives).select(
        "anchor", "positive", "rank", "negative", F.col("score").alias("positive_score"), F.col("other").alias("negative_score"))
