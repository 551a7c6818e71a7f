"""Exact scores from residues, and hard negatives against a plain search."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from promoforge.llm import hard_negatives as hn


@pytest.mark.parametrize(("width", "size"), [(1, 1), (64, 300), (64, 70_000), (3000, 127), (5000, 4_000_000), (2, 300_000_000)])
def test_products_are_exact(width, size):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-size, size, (5, width), endpoint=True) for _ in range(2))
    a[0], b[0], b[1] = size, size, -size
    primes = hn.moduli(width * size * size)
    got = hn.products([hn.residues(a.astype(float), p) for p in primes], [hn.residues(b.astype(float), p) for p in primes], primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]


def test_too_large_scores_are_refused():
    with pytest.raises(ValueError):
        hn.moduli(1 << 58)


def plain(rows, positives=5, negatives=3):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        now = label, [int(np.floor(x * 256)) for x in v]
        kept[i] = min(kept.get(i, now), now)
    out = []
    for a, (label, v) in kept.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items()}  # noqa: B905
        order = sorted((i for i in kept if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            fit = [i for i in order if kept[i][0] != label and score[p] <= 2 * score[i] and 20 * score[i] <= 19 * score[p]]
            out += [(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 2048, 512), (7, 2, 1), (50, 3, 2)])
def test_against_a_plain_search(spark, rng, monkeypatch, blocks):
    for name, size in zip(("ROWS", "ANCHORS", "TILE"), blocks, strict=True):
        monkeypatch.setattr(hn, name, size)
    rows = [(i, rng.randrange(3), [rng.choice((-0.5, 0.25, 0.5, 0.003, 1.0)) for _ in range(4)]) for i in range(260)]
    rows += [(300, 1, None), (350, None, [1.0]), (None, 1, [1.0] * 4), (400, 1, [1.0, None]), (450, 1, [float("nan")] * 4), (500, 1, [float("inf")] * 4),
             (550, 2, []), (600, 2, [0.5]), (650, 1, [0.5, 0.5, 0.5, 0.5, 0.25, 2.0]), (100, 2, [0.5] * 4), (100, 0, [0.25] * 4), rows[7], rows[7], (700, 77, [0.5] * 4)]
    given = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, label int, embedding array<float>, a string, anchor string, id string")
    got = hn.mine_negatives(given, F.col("vec_id") % 50 == 0).collect()
    want = plain([(i, la, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, la, v in rows])
    assert sorted(map(tuple, got)) == want and len(want) > 40


def test_blocks_meet_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), [float(np.float32(x)) for x in rng.uniform(0, 1, 6)]) for i in range(400)]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = sorted(map(tuple, hn.mine_negatives(given, F.col("vec_id") % 50 == 0).collect()))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == plain(rows) and len(got) > 50


def test_empty_and_unfit_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mine_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0]), (7, 2, [1.0])], empty.schema)
    assert hn.mine_negatives(alone, F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(ValueError):
        hn.mine_negatives(alone, F.lit(True), low=Fraction(1, 30))
