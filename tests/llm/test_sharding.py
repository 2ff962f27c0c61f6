import hashlib
import math
import zlib

from pyspark.sql import functions as F

from codeloom.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, slot int"


def owner(key, weights):
    def score(i):
        h = hashlib.md5(f"shard:{i}:{'null' if key is None else key}".encode()).hexdigest()[:13]
        return -math.log((int(h, 16) + 0.5) / 2**52) / weights[i]

    return min(range(len(weights)), key=lambda i: (score(i), i))


def test_matches_brute_force_and_moves_only_into_the_new_shard(spark):
    weights = [1.0, 2.0, 1.0]
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(df, "doc_id", weights, grown=[*weights, 1.0], fine=7).collect()
    assert len(rows) == 2000
    for r in rows[::37]:
        assert r.shard == owner(r.doc_id, weights)
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert 300 < sum(r.grown_shard == 3 for r in rows) < 500
    assert 850 < sum(r.shard == 1 for r in rows) < 1150
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_nulls_repeats_clashing_names_and_empty(spark, tmp_path):
    data = [(1, "Ünï", "x", 1), (1, "Ünï", "x", 1), (None, "a", "y", 2), (5, None, "z", 3), (6, "", "z", 3)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_rendezvous_sharding(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in data
    )
    assert len({(r.shard, r.slot) for r in rows}) == 5
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard(empty.select("doc_id", F.lit(1).alias("n")), "doc_id", [1.0] * 8).count() == 0


def test_every_key_by_brute_force_and_one_row_in_a_third_of_all(spark):
    rng = list(range(900))
    keys = [k * 7919 for k in rng] + [None] * 300 + [5] * 300
    rows = [(k, "t" * (i % 11 if k is None else 3), "x", i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.shard(df, "doc_id", [1.0] * 8, [F.length("text").cast("long").alias("size")], grown=[1.0] * 9).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == owner(r.doc_id, [1.0] * 8) and r.grown_shard == owner(r.doc_id, [1.0] * 9)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(k), len(t)) for k, t, *_ in rows)


def test_a_row_repeated_very_often_is_carried_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    stored, made = [], sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda *a: stored.append(made(*a)) or stored[-1])
    keys = [5] * 500 + [None] * 14 + [8] * 7 + list(range(100, 300))
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = sharding.shard(df, "doc_id", [1.0] * 8, fine=64).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, keys))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    parts = stored[0].where("doc_id = 5").collect()
    assert len(parts) == 72 and max(r["_n"] for r in parts) == 7 and len({r["_fine"] for r in parts}) > 30
