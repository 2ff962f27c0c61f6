import math
import random

import numpy as np
import pytest

from codeloom.llm import hard_negatives as h
from codeloom.llm import queries
from tests.llm.helpers import write

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, positives=5, k=10):
    """By the contract, over rows (vec_id, embedding, label) as Python numbers."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out, rows = [], list(known)
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b is not a)
        for minus, p, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fit = [s for s in scored if s[2] != a[1] and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:k]
            out += [(a[0], p, n + 1, s[1], -minus, -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


def mined(spark, df, folder):
    write(df, folder, "embeddings")
    return sorted(tuple(r) for r in queries.op12_hard_negatives(spark, str(folder)).collect())


@pytest.mark.parametrize("block", [40, 1 << 14])
def test_same_as_brute_force(spark, tmp_path, monkeypatch, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 9))
    rows = [(i, (centres[i % 6] + 0.6 * rng.normal(size=9)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(0, 1200, 3)]
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 9)], i % 2) for i in range(60)]  # many ties
    rows += rows[:40] + [(100, rows[1][1], 3), (None, rows[0][1], 1), (5000, None, 1), (5100, rows[0][1], None), (5200, [float("nan")] * 9, 1), (5300, [None] * 9, 1), (5400, [float("inf")] * 9, 1)]
    monkeypatch.setattr(h.mine, "__defaults__", (*h.mine.__defaults__[:-1], block))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = mined(spark, df, tmp_path)
    assert got == brute(rows) and len(got) > 200


def test_empty_other_lengths_and_huge_components(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(spark, empty, tmp_path) == []
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(150)]
    odd = [(300, [1.0, 2.0], 1), (400, [], 1), (500, [3e38] * 4, 1)]
    assert mined(spark, spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA), tmp_path) == brute(
        [(i, np.float32(v).astype(float).tolist(), label) for i, v, label in rows]
    )
    alone = spark.createDataFrame([(100, [1.0, 0.0], 1, "x", 1), (101, [1.0, 0.0], 2, "x", 1)], SCHEMA)
    assert mined(spark, alone, tmp_path) == []


def test_bounds_hold_whatever_the_codebooks(spark):
    rng = np.random.default_rng(2)
    for sample, vectors in ((rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (400, 7))), (rng.integers(-2, 2, (3, 7)), rng.integers(-9000, 9000, (400, 7)))):
        q = h.Quantiser(sample)
        codes, norms = q.encode(vectors)
        anchors = vectors[:50]
        lower, upper = q.bounds(anchors, codes, norms)
        score = anchors @ vectors.T
        assert (lower <= score).all() and (score <= upper).all()


def test_rows_are_scored_exactly_only_where_bounds_do_not_decide(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(3000, 8))).astype(np.int64)
    q = h.Quantiser(vectors)
    codes, norms = q.encode(vectors)
    block = h.Block(q, np.arange(3000), np.arange(3000), np.zeros(3000, np.int64), vectors, codes, norms)
    scored = []
    exact = block._exact
    monkeypatch.setattr(block, "_exact", lambda anchors, a, r: scored.append(len(a)) or exact(anchors, a, r))
    a, r, score = block.positives(np.arange(20), np.zeros(20, np.int64), vectors[:20], 5)
    assert len(a) == 100 and scored[0] < 0.1 * 20 * 3000
    truth = vectors[:20] @ vectors.T
    truth[np.arange(20), np.arange(20)] = h.LOWEST
    assert np.array_equal(np.sort(score.reshape(20, 5)), np.sort(-np.sort(-truth, axis=1)[:, :5]))
