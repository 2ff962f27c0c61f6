import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], SCHEMA)


def unit(rng, n, dims=64):
    v = rng.normal(size=(n, dims)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def recall(got, v, every, k=20):
    found = {(r.query_id, r.vec_id) for r in got}
    w = v.astype(np.float64)
    true = {(q, int(i)) for q in range(0, len(v), every) for i in np.argsort(-np.where(np.arange(len(v)) == q, -np.inf, w @ w[q]), kind="stable")[:k]}
    assert len(found) == len(true)
    return len(found & true) / len(true)


@pytest.mark.parametrize("cell", [64, 1 << 15])
def test_candidates_are_all_pairs_that_meet_and_are_within_the_radius(spark, monkeypatch, cell):
    """Brute force over codes; small cells have more first bits and are split, and a crowd of like codes is hot."""
    monkeypatch.setattr(ann, "CELL", cell)
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (700, ann.BITS // 8), dtype=np.uint8)
    codes[:300] = codes[0] ^ np.packbits(rng.random((300, ann.BITS)) < 0.1, axis=1)
    codes[650:] = codes[600:650] ^ np.packbits(rng.random((50, ann.BITS)) < 0.3, axis=1)
    bands = [0] * 600 + [3] * 100
    row = lambda i, band: (int(i), band, codes[i].view(np.uint16).astype(int).tolist(), codes[i].tobytes())
    schema = "entry long, band int, keys array<int>, code binary"
    coded = spark.createDataFrame([row(i, bands[i]) for i in range(700)], schema)
    queries = list(range(0, 700, 7))
    model = ann.Model(1.0, np.zeros((3, ann.BITS)), {0: (130, 2), 3: (140, 3)})
    got = [tuple(r) for r in ann.candidates(coded, spark.createDataFrame([row(i, -1) for i in queries], schema), model, {0: 600, 3: 100}).collect()]
    split = np.bitwise_count(codes.view(np.uint16)[queries][:, None, :] ^ codes.view(np.uint16)[None, :, :])
    apart, closest = split.sum(axis=2, dtype=int), split.min(axis=2)
    radius, reach = np.where(np.array(bands) == 0, 130, 140), np.where(np.array(bands) == 0, 2, 3)
    want = {(queries[a], int(b)) for a, b in np.argwhere((apart <= radius) & (closest <= reach))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    # What pigeonhole promises: every code nearer than substrings x (reach + 1) bits.
    sure = {(queries[a], int(b)) for a, b in np.argwhere((apart < ann.BITS // ann.SUBSTRING * (reach + 1)) & (apart <= radius))}
    assert sure <= set(got)


def test_one_round_of_probes_answers_every_query(spark, monkeypatch):
    rounds, made = [], ann.candidates
    monkeypatch.setattr(ann, "candidates", lambda *a: rounds.append(a[4]) or made(*a))
    v = unit(np.random.default_rng(3), 2000)
    got = ann.nearest(spark, table(spark, v), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert rounds == [0] and recall(got, v, 20) >= 0.9


def test_lengths_that_differ_a_hundredfold(spark):
    rng = np.random.default_rng(5)
    v = unit(rng, 4000) * np.exp(rng.uniform(0, np.log(100), (4000, 1))).astype(np.float32)
    got = ann.nearest(spark, table(spark, v), "vec_id", "embedding", F.col("vec_id") % 40 == 0).collect()
    assert recall(got, v, 40) >= 0.9


def test_short_queries_are_asked_again(spark, monkeypatch):
    """Two crowds far from each other: a small one's queries find its members first and need the other one's too."""
    rounds, made = [], ann.candidates
    monkeypatch.setattr(ann, "candidates", lambda *a: rounds.append(a[4]) or made(*a))
    rng = np.random.default_rng(7)
    v = np.concatenate([unit(rng, 1, 32) + 0.05 * unit(rng, 900, 32), -unit(rng, 1, 32) + 0.05 * unit(rng, 10, 32)]).astype(np.float32)
    v = v[rng.permutation(len(v))]
    got = ann.nearest(spark, table(spark, v), "vec_id", "embedding", F.col("vec_id") >= 0).collect()
    assert len(got) == 20 * len(v) and len(rounds) > 1
    assert recall(got, v, 1) >= 0.9


def test_one_vector_in_a_third_of_all_rows_and_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 0)  # nothing is broadcast
    rng = np.random.default_rng(11)
    v = unit(rng, 600)
    v[100:300] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[500].tolist()), (0, v[0].tolist())]
    got = ann.nearest(spark, spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 31 * 20  # id 0 asks with two vectors
    for q in (100, 120, 280):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(100, 122) if i != q][:20]
    assert {r.vec_id for r in got if r.query_id == 500 and r["rank"] == 1} == {0}
