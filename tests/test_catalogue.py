"""Every registered query of the graph side against its SQL, as the driver compares them."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.extract import udtf
from codeloom.functions import identity as ident
from codeloom.operators import ranking
from codeloom.plans import catalogue
from codeloom.session import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return None if value is None else str(value)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    rows = canon(df.columns, df.collect())
    assert rows and rows == canon(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_byte_slices_that_cut_characters(spark):
    text = "aé日\U0001f600ß\u0800z\U0010ffff"
    n = len(text.encode())
    ranges = spark.createDataFrame([(text, a, b) for a in range(n + 2) for b in range(n + 3)], "t string, a int, b int")
    for r in ranges.select("*", ident.byte_slice("t", "a", "b").alias("piece")).collect():
        assert r.piece == text.encode()[r.a : r.b].decode("utf-8", "replace"), (r.a, r.b)


def test_byte_slice_of_every_document(spark, con):
    got = catalogue.QUERIES["byte_slice_all"](spark, SF).collect()
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert any(len(t) != len(t.encode()) for _, t in rows)
    want = [(i, t.encode()[i % 17 : i % 17 + 40].decode("utf-8", "replace")) for i, t in rows]
    assert any("\ufffd" in piece for _, piece in want)
    assert sorted((r.doc_id, r.piece) for r in got) == sorted(want)


def test_recall_of_lsh(spark, con):
    ids, vectors = zip(*con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall(), strict=True)
    v = np.array(vectors, np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = lambda i: {f"v{ids[j]}" for j in np.argsort(-unit @ unit[i])[:10]}
    rows = table(spark, SF, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("moniker"), "embedding", "vec_id").cache()
    recall = []
    for i in range(0, len(ids), len(ids) // 10):
        got = ranking.top_k_lsh(rows, rows.where(F.col("vec_id") == ids[i]).select(F.col("embedding").alias("q")), catalogue.LSH_PLANES)
        recall.append(len(near(i) & {r.moniker for r in got.collect()}) / 10)
    rows.unpersist()
    assert np.mean(recall) >= 0.9
    exact = {r.moniker for r in catalogue.QUERIES["vector_topk"](spark, SF).collect()}
    assert len(exact & {r.moniker for r in catalogue.QUERIES["vector_topk_lsh"](spark, SF).collect()}) >= 9


def test_fixture_vectors_same_as_numpy(spark, con):
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = catalogue.QUERIES["fixture_embed"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        seed = int.from_bytes(hashlib.sha256(text[r.doc_id].encode()).digest()[-4:], "big")
        assert np.array_equal(np.array(r.embedding, np.float32), np.random.default_rng(seed).random(384).astype(np.float32))


@pytest.mark.parametrize("language", ["python", "go", "typescript"])
def test_made_files_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch, language):
    n = table(spark, SF, "customer").count()
    monkeypatch.setattr(catalogue, "FILES_A_TASK", 10)
    assert catalogue._code(spark, SF, language).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 10))


def parsed(spark, monkeypatch):
    """A counter of the Python files that extractors parse from now on."""
    count, extract = spark.sparkContext.accumulator(0), udtf.REGISTRY["python"]

    def counted(*file):
        count.add(1)
        return extract(*file)

    monkeypatch.setitem(udtf.REGISTRY, "python", counted)
    return count


def test_the_graph_parses_a_file_once(spark, monkeypatch):
    count = parsed(spark, monkeypatch)
    assert catalogue.QUERIES["graph_json"](spark, SF).collect()
    assert count.value == table(spark, SF, "customer").count()


def test_chunks_parse_a_file_once_and_leave_nothing_cached(spark, monkeypatch):
    count, cached = parsed(spark, monkeypatch), spark.sparkContext._jsc.getPersistentRDDs
    held = set(cached())
    assert catalogue.QUERIES["function_chunk"](spark, SF).collect()
    assert set(cached()) <= held
    assert count.value == table(spark, SF, "customer").count()
