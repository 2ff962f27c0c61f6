"""Delta commits and the stored vector index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions.vectors import FixtureEmbedder
from codeloom.plans import incremental, index
from codeloom.session import table
from codeloom.storage import snapshot
from codeloom.storage.snapshot import Delta, SnapshotStore, layers_of
from codeloom.storage.vectors import VectorStore
from tests.test_plans import URL, Repo, state

VECTORS = "/root/testdata/sf0.1"
EMBEDDER = FixtureEmbedder(4)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def failures(spark, **errors):
    return spark.createDataFrame([(path, error, "r") for path, error in errors.items()], "path string, error string, repo_name string")


def held(store, part=None, version=None):
    return sorted((r["repo_name"], r["path"], r["error"]) for r in store.read("failed_files", part, version).collect())


def test_layers_are_merged_on_read(spark, store, monkeypatch):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    store.commit("r", {"failed_files": failures(spark, a="1", b="1", c="1")})
    store.commit("other", {"failed_files": failures(spark, a="x").withColumn("repo_name", F.lit("other"))})
    first = store.manifest()["version"]
    store.commit("r", {"failed_files": Delta(failures(spark, b="2", d="2"), paths("b"))})
    store.commit("r", {"failed_files": Delta(None, paths("a", "nowhere"))})
    store.commit("r", {"failed_files": Delta(failures(spark, a="3"), paths("d"))})
    want = [("r", "a", "3"), ("r", "b", "2"), ("r", "c", "1")]
    assert held(store, "r") == want and held(store) == [("other", "a", "x"), *want]
    assert held(store, version=first) == [("other", "a", "x"), ("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")]
    store.commit("new", {"failed_files": Delta(failures(spark, q="9").withColumn("repo_name", F.lit("new")), paths("q"))})
    assert held(store, "new") == [("new", "q", "9")]
    assert store.compact("r") == [] and len(layers_of(store.manifest()["tables"]["failed_files"]["r"])) == 4

    publish = store._publish  # another delta comes while the layers are made one
    raced = []

    def late(manifest):
        if not raced:
            raced.append(SnapshotStore(spark, store.root).commit("r", {"failed_files": Delta(failures(spark, e="4"), paths("c"))}))
        return publish(manifest)

    monkeypatch.setattr(store, "_publish", late)
    assert store.compact("r", 1) == ["failed_files"]
    assert len(layers_of(store.manifest()["tables"]["failed_files"]["r"])) == 2
    assert held(store, "r") == [("r", "a", "3"), ("r", "b", "2"), ("r", "e", "4")]
    assert store.compact("r", 1) == ["failed_files"] and isinstance(store.manifest()["tables"]["failed_files"]["r"], str)
    assert held(store, "r") == [("r", "a", "3"), ("r", "b", "2"), ("r", "e", "4")]
    monkeypatch.setattr(snapshot, "KEPT", 1)
    store.set_sha("r", "s")
    store.amend(lambda m: None)
    assert any(x.endswith("-gone") for x in store.collect_garbage(-60)) and len(held(store)) == 5


def written(store, repo):
    """Rows of the newest layer of each table."""
    tables = store.manifest()["tables"]
    return {t: store.spark.read.schema(snapshot.TABLES[t]).parquet(f"{store.root}/{layers_of(parts[repo])[-1]['rows']}").collect() for t, parts in tables.items()}


def test_an_update_of_one_file_writes_rows_of_that_file(spark, store, tmp_path):
    root = tmp_path / "checkout"
    root.mkdir()
    repo = Repo(root)
    files = {f"m{i}_dot_py": f"from m0 import f0\ndef f{i}(x):\n    return f0({i})\n" for i in range(9)}
    repo.commit(**files)
    incremental.update(spark, root, URL, "shop", store, EMBEDDER)
    before, version = state(store), store.manifest()["version"]
    repo.commit(m4_dot_py="def f4(x):\n    return 'new'\n\ndef more():\n    return f4(1)\n")
    result = incremental.update(spark, root, URL, "shop", store, EMBEDDER)
    assert (result.fell_back, result.added) == (False, 1)
    new = written(store, "shop")
    assert {r["file_path"] for r in new["symbols"]} == {r["file_path"] for r in new["relationships"]} == {"m4.py"} and {r["path"] for r in new["files"]} == {"m4.py"}
    assert {r["moniker"] for r in new["embeddings"]} == {"loom python shop m4.py f4().", "loom python shop m4.py more()."}
    assert all("m4.py" in r["src"] + r["dst"] for r in new["edges"]) and new["failed_files"] == []
    fresh = SnapshotStore(spark, str(tmp_path / "fresh"))
    index.full_index(spark, root, URL, "shop", fresh, embedder=EMBEDDER)
    assert state(store) == state(fresh)
    assert {r["id"] for r in store.read("symbols", version=version).collect()} == set(before[0])
    store.compact("shop", 1)
    assert state(store) == state(fresh)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """All vectors of sf0.1 in an indexed table of 64 dimensions."""
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("indexed")))
    vectors = VectorStore(store, 64)
    rows = table(spark, VECTORS, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("moniker"), "embedding")
    vectors.upsert("all", rows)
    vectors.index.build(cell_rows=8)
    return vectors, {r["moniker"]: np.array(r["embedding"], np.float64) for r in rows.collect()}


def exact(known, query, k=10):
    names = sorted(known)
    v = np.array([known[n] for n in names])
    dist = 1 - v @ query / np.sqrt((v**2).sum(axis=1) * (query**2).sum())
    return [names[j] for j in np.lexsort((np.arange(len(names)), dist))[:k]]


def recall(vectors, known, queries):
    hits = [len({r["moniker"] for r in vectors.search(q.tolist()).collect()} & set(exact(known, q))) for q in queries]
    return sum(hits) / (10 * len(hits))


def scans(plan):
    """Metrics of the scans of an executed plan: files read."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    own = [plan.metrics().apply("numFiles").value()] if name == "FileSourceScanExec" else []
    children = plan.children()
    return own + [n for k in range(children.size()) for n in scans(children.apply(k))]


def test_search_reads_few_files_and_finds_the_nearest(spark, indexed):
    vectors, known = indexed
    record = vectors.index.record()
    assert record["cells"] == len(known) // 8 and record["probes"] <= record["cells"]
    queries = [known[f"v{i}"] for i in range(0, 2000, 400)] + list(np.random.default_rng(1).normal(size=(3, 64)))
    assert recall(vectors, known, queries) >= 0.9
    rows, rest = vectors.index.near(queries[0].tolist())
    assert 10 <= len(rows.collect()) <= 40 and rest.count() == 0
    files = spark.read.parquet(f"{vectors.store.root}/{record['segments'][0]['vectors']}").inputFiles()
    assert sum(scans(rows._jdf.queryExecution().executedPlan())) < 0.2 * len(files)


def test_index_follows_upserts_deletes_and_compaction(spark, indexed):
    vectors, known = indexed
    known, query = dict(known), known["v7"]
    first = exact(known, query)
    rows = [("new", (query + 0.01).astype(np.float32).tolist()), (first[1], (-query).astype(np.float32).tolist())]
    vectors.upsert("all", spark.createDataFrame(rows, "moniker string, embedding array<float>"))
    vectors.delete("all", spark.createDataFrame([(first[2],)], "moniker string"))
    known |= {m: np.array(e, np.float64) for m, e in rows}
    del known[first[2]]
    got = [r["moniker"] for r in vectors.search(query.tolist()).collect()]
    assert got[:2] == ["v7", "new"] and not {first[1], first[2]} & set(got) and len(set(got) & set(exact(known, query))) >= 9
    assert recall(vectors, known, [query, known["v40"]]) >= 0.9
    vectors.upsert("two", spark.createDataFrame([("other", query.astype(np.float32).tolist())], "moniker string, embedding array<float>"))
    known["other"] = query
    assert {r["moniker"] for r in vectors.search(query.tolist(), 2).collect()} == {"v7", "other"}
    assert [r["moniker"] for r in vectors.search(query.tolist(), 3, repo="two").collect()] == ["other"]
    assert vectors.index.refresh() and not vectors.index.refresh()
    assert vectors.store.compact("all", 1) == ["embeddings"] and vectors.index.refresh()
    record = vectors.index.record()
    assert len(record["segments"]) == 2 and not vectors.index._standing(vectors.store.manifest(), record)[1]
    assert recall(vectors, known, [query, known["v40"], known["v1000"]]) >= 0.9
    assert {r["moniker"] for r in vectors.search(query.tolist(), 2).collect()} == {"v7", "other"}
    vectors.setup(recreate=True)
    assert vectors.index.record() is None and vectors.search(query.tolist()).count() == 0
    vectors.index.build()
    assert vectors.index.record() is None
