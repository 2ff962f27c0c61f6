"""Repository to snapshot and back: full index, export, incremental updates, streams and the job queue."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import chunks
from codeloom.functions.vectors import ConfigError, FixtureEmbedder, RemoteEmbedder, from_config
from codeloom.operators import jobs, ranking
from codeloom.plans import incremental, index
from codeloom.plans.export import export, read_summary
from codeloom.sources import git
from codeloom.sources.gitignore import Rules
from codeloom.sources.repository import indexable, read_repository, walk
from codeloom.storage.snapshot import SnapshotStore
from codeloom.storage.vectors import VectorStore
from codeloom.streaming.ledger import EVENTS, JobQueue, stream_changed_files, stream_job_states

USER = '''"""Accounts."""
from typing import Any
import logging

LIMIT: int = 3


class Record:
    pass


class Account(Record):
    def __init__(self, name: str) -> None:
        self.name = name

    def rename(self, name):
        return self._check(name)


def _check(name):
    return bool(name)


def open_account(name):
    if _check(name):
        return Account(name).rename(name)
'''


class Repo:
    def __init__(self, root):
        self.root = root
        self.git("init", "-q", "-b", "main")
        self.git("config", "user.email", "t@example.com")
        self.git("config", "user.name", "t")

    def git(self, *args):
        subprocess.run(["git", "-C", str(self.root), *args], check=True, capture_output=True)

    def write(self, **files):
        for name, text in files.items():
            path = self.root / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)

    def commit(self, **files):
        self.write(**files)
        self.git("add", "-A", "-f")
        self.git("commit", "-q", "--allow-empty", "-m", "c")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "checkout"
    root.mkdir()
    return Repo(root)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


EMBEDDER = FixtureEmbedder(4)
URL = "https://git.example/org/shop.git"


def update(spark, repo, store, **more):
    return incremental.update(spark, repo.root, URL, "shop", store, EMBEDDER, **more)


def state(store):
    """What a snapshot says, without times and emission order."""
    symbols = {r["id"]: (r["body_hash"], r["enclosing_class_id"]) for r in store.read("symbols").collect()}
    edges = {(r["src"], r["label"], r["dst"]) for r in store.read("edges").collect()}
    vectors = {r["moniker"]: tuple(r["embedding"]) for r in store.read("embeddings").collect()}
    files = {r["path"] for r in store.read("files").collect()}
    return symbols, edges, vectors, files


def test_walk_and_ignore(repo):
    repo.write(a_dot_py="", src___private_dot_py="", _dot_hid__b_dot_ts="", node_modules__x_dot_py="", lib__x_dot_egg="", c_dot_go="", c_test_dot_go="", gen__z_dot_py="", gen__keep_dot_py="", readme_dot_md="")
    (repo.root / "a.egg-info").mkdir()
    (repo.root / "a.egg-info/q.py").write_text("")
    (repo.root / ".gitignore").write_text("gen/*\n!gen/keep.py\n*.log\n")
    assert walk(repo.root) == [".hid/b.ts", "a.py", "c.go", "gen/keep.py", "gen/z.py", "src/_private.py"]
    assert walk(repo.root, Rules.load(repo.root)) == [".hid/b.ts", "a.py", "c.go", "gen/keep.py", "src/_private.py"]
    assert indexable(["a.py", "gone.py", "c_test.go", "dist/x.py", "gen/z.py", "x.md"], Rules.load(repo.root), repo.root) == ["a.py"]
    rules = Rules({"": ["/top", "doc/**/x.py", "*.l?g", "[ab].ts", "#c", "\\#d", "dir/"], "sub": ["*.tmp", "/own"]})
    yes = ["top", "top/a", "doc/x.py", "doc/p/q/x.py", "a/b.log", "a.ts", "#d", "dir/x", "k/dir/x", "sub/x.tmp", "sub/k/x.tmp", "sub/own"]
    no = ["k/top", "x.py", "c.ts", "#c", "dir", "x.tmp", "sub/k/own", "own"]
    assert [p for p in yes if not rules.ignores(p)] == [] and [p for p in no if rules.ignores(p)] == []


def test_full_index_and_export(spark, repo, store, tmp_path):
    repo.commit(src__account_dot_py=USER)
    result = index.full_index(spark, repo.root, URL, "shop", store, tmp_path / "out", EMBEDDER)
    kinds = {r["kind"]: r["n"] for r in result.symbols.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"module": 1, "class": 2, "method": 2, "function": 2, "variable": 1}
    kinds = {r["kind"]: r["n"] for r in result.relationships.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"contains": 7, "extends": 1, "calls": 5, "imports": 2}
    g = json.loads((tmp_path / "out/graph.json").read_text())
    ids = [s["id"] for s in g["symbols"]]
    assert ids == sorted(ids) and len(g["relationships"]) == 15 and g["repository"]["languages"] == {"python": 1} and g["failed_files"] == []
    order = [(r["source_id"], r["target_name"] or "", r["target_id"] or "") for r in g["relationships"]]
    assert order == sorted(order)
    names = json.loads((tmp_path / "out/embeddings_index.json").read_text())
    vectors = np.load(tmp_path / "out/embeddings.npy")
    assert vectors.dtype == np.float32 and vectors.shape == (6, 4) and names == sorted(names)
    assert {s["id"]: s["embedding_id"] for s in g["symbols"] if s["embedding_id"] is not None} == {n: i for i, n in enumerate(names)}
    for r in g["relationships"]:
        if r["kind"] == "imports" and r["target_name"] == "Any":
            assert r["metadata"] == {"import_source": "typing", "alias": None}
    built = {r["moniker"]: r["chunk"] for r in chunks.build(result.symbols, result.relationships).collect()}
    assert np.array_equal(vectors, EMBEDDER.embed([built[n] for n in names]))
    assert read_summary(spark, str(tmp_path / "out/graph.json")) == {"symbols": 8, "relationships": 15, "files": 1, "failed_files": 0, "embeddings": 6}
    (tmp_path / "bad.json").write_text("{nothing")
    assert read_summary(spark, str(tmp_path / "bad.json")) is None
    assert state(store)[3] == {"src/account.py"} and store.last_sha("shop") == git.head_sha(repo.root)
    assert len(state(store)[1]) == 7
    found = VectorStore(store, 4).search(vectors[2].tolist(), 3).collect()
    assert found[0]["moniker"] == names[2] and abs(found[0]["dist"]) < 1e-6


def test_chunk_texts():
    lines = ["def f(a,", "      b):", '    """Doc', '    more."""', "    x = 1", "    return x"]
    assert chunks.python_body(lines) == ["    x = 1", "    return x"]
    assert chunks.python_body(["def f():", '    """Doc."""', "    return 1"]) == ["    return 1"]
    assert chunks.python_body(["def f(): return 1"]) == []
    assert chunks.delegate(["  # note", "  return await g.h(x)"]) == "g.h"
    assert chunks.delegate(["try:", "  return g(x)", "except Exception as e:", "  raise"]) == "g"
    assert chunks.delegate(["return x"]) is None and chunks.delegate(["a()", "return b()"]) is None
    text, target = chunks.implementation("def f():\n" + "\n".join(f"    a{i}()" for i in range(200)), "python")
    assert text.endswith("... (50 more lines)") and text.count("\n") == 151 and target is None
    assert chunks.implementation("func F(a int) {\n\tg()\n}", "go")[0] == "Implementation:\n\tg()"


def test_class_chunk_lists_thirty_methods(spark, repo):
    body = "".join(f"    def m{i}(self, x: int):\n        return {i}\n" for i in range(40))
    repo.commit(a_dot_py="class Big(Base):\n" + body)
    result = index.build(spark, repo.root, URL, "shop", EMBEDDER)
    text = next(r["chunk"] for r in chunks.build(result.symbols, result.relationships).collect() if r["moniker"].endswith("Big#"))
    assert text.startswith("Class: a.Big\nFile: a.py\nExtends: Base\nMethods:\n  m0(x: int)\n") and text.endswith("\n  m29(x: int)\n  ... (10 more)")


def test_go_methods_link_across_files(spark, repo, store):
    repo.commit(a_dot_go="package p\ntype T struct{}\n", b_dot_go="package p\nfunc (t *T) M() {}\nfunc (u U) N() {}\n")
    index.full_index(spark, repo.root, URL, "shop", store, embedder=EMBEDDER)
    symbols, edges, _, _ = state(store)
    assert symbols["loom go shop b.go T#M()."][1] == "loom go shop a.go T#" and symbols["loom go shop b.go U#N()."][1] is None
    assert ("loom go shop a.go T#", "CONTAINS", "loom go shop b.go T#M().") in edges


def test_duplicates_and_failures(spark, repo):
    repo.commit(a_dot_py="def f():\n    pass\ndef f():\n    return 1\n", b_dot_ts="export const a: number = 1;")
    (repo.root / "gone.py").symlink_to(repo.root / "nowhere.py")
    first = index.build(spark, repo.root, URL, "shop", EMBEDDER)
    assert first.symbols.where("kind = 'function'").count() == 1
    assert [(r["path"], r["error"].split(":")[0]) for r in first.failed_files.collect()] == [("gone.py", "FileNotFoundError")]
    with pytest.raises(index.DuplicateMonikers):
        index.build(spark, repo.root, URL, "shop", EMBEDDER, on_duplicate="error")
    assert read_repository(spark, repo.root, "shop").where("path = 'a.py'").first()["size_bytes"] == 40


FILES = {f"m{i}_dot_py": f"def f{i}(x):\n    return {i}\n" for i in range(6)}


def test_updates_end_where_a_full_index_would(spark, repo, store, tmp_path):
    repo.commit(**FILES, t_dot_go="package p\ntype T struct{}\n", c_dot_py="class C:\n    def a(self):\n        return 1\n")
    assert update(spark, repo, store).fell_back
    assert vars(update(spark, repo, store)) | {"old_sha": 0, "new_sha": 0} == {"old_sha": 0, "new_sha": 0, "added": 0, "updated": 0, "deleted": 0, "skipped": 0, "fell_back": False, "failed_files": []}
    repo.write(m0_dot_py="def f0(x):\n    return 'other'\ndef g():\n    return f0(1)\n", u_dot_go="package p\nfunc (t T) M() {}\n", c_dot_py="class C:\n    def a(self):\n        return 1\n    def b(self):\n        return 2\n")
    (repo.root / "m1.py").unlink()
    repo.commit()
    r = update(spark, repo, store)
    assert (r.added, r.updated, r.deleted, r.skipped, r.fell_back) == (4, 4, 2, 1, False)
    assert r.new_sha == git.head_sha(repo.root) == store.last_sha("shop")
    fresh = SnapshotStore(spark, str(tmp_path / "fresh"))
    index.full_index(spark, repo.root, URL, "shop", fresh, embedder=EMBEDDER)
    assert state(store) == state(fresh)
    again = update(spark, repo, store)
    assert (again.added, again.updated, again.deleted) == (0, 0, 0)


def test_update_corner_cases(spark, repo, store):
    repo.commit(**FILES)
    update(spark, repo, store)
    before = state(store)
    repo.commit(docs_dot_md="words", dist__x_dot_py="def x(): pass")
    r = update(spark, repo, store)
    assert (r.added, r.updated, r.fell_back) == (0, 0, False) and store.last_sha("shop") == git.head_sha(repo.root) and state(store) == before
    repo.commit(**{f"m{i}_dot_py": "x: int = 1\n" for i in range(5)})
    assert update(spark, repo, store).fell_back
    assert len(state(store)[0]) == 12  # replaced, no ghosts
    (repo.root / "m5.py").rename(repo.root / "n5.py")
    repo.commit()
    r = update(spark, repo, store)
    assert (r.added, r.deleted) == (2, 2) and "n5.py" in state(store)[3]
    with pytest.raises(git.GitError):
        git.changes(repo.root, "0" * 40, "HEAD")


def test_two_repositories_do_not_touch(spark, repo, store, tmp_path):
    repo.commit(**FILES)
    update(spark, repo, store)
    other = tmp_path / "other"
    other.mkdir()
    two = Repo(other)
    two.commit(m0_dot_py="def f0(): pass\n")
    incremental.update(spark, other, "https://git.example/org/b.git", "b", store, EMBEDDER)
    assert len(state(store)[3]) == 6 and store.read("symbols", "b").count() == 2 and store.read("symbols").count() == 14


def test_nothing_is_published_before_the_swap(spark, repo, store, monkeypatch):
    repo.commit(**FILES)
    update(spark, repo, store)
    before = (store.manifest(), state(store))
    repo.commit(m0_dot_py="def f0(x):\n    return 'new'\n")
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            update(spark, repo, store)
    assert (store.manifest(), state(store)) == before
    assert update(spark, repo, store).updated == 2


def test_vector_rules(spark, store):
    v = VectorStore(store, 3)
    v.setup()
    v.setup()
    assert v.write("r", [], []) == 0
    v.write("r", ["a", "b", "c"], [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    v.write("r", ["b"], [[1, 1, 0]])
    assert [(r["moniker"], round(r["dist"], 6)) for r in v.search([1, 0, 0], 2).collect()] == [("a", 0.0), ("b", 0.292893)]
    v.delete("r", spark.createDataFrame([("a",), ("zz",)], "moniker string"))
    assert {r["moniker"] for r in store.read("embeddings").collect()} == {"b", "c"}
    for bad in (lambda: v.write("r", ["a"], []), lambda: v.write("r", ["a"], [[1, 2]]), lambda: v.search([1]), lambda: VectorStore(store, 5).setup(), lambda: VectorStore(store, 0)):
        with pytest.raises(ValueError):
            bad()
    VectorStore(store, 5).setup(recreate=True)
    assert store.read("embeddings").count() == 0 and store.properties()["dimensions"] == 5


def test_embedders(tmp_path, monkeypatch):
    a = FixtureEmbedder().embed(["x", "y"])
    assert a.shape == (2, 384) and a.dtype == np.float32 and np.array_equal(a, FixtureEmbedder().embed(["x", "y"])) and FixtureEmbedder().embed([]).shape == (0, 384)
    assert from_config(tmp_path / "none.yaml").dimensions == 384
    sent = []
    remote = RemoteEmbedder(lambda texts: (sent.append(len(texts)) or [[0.0, 1.0]] * len(texts), 7), dimensions=2, batch=2)
    assert remote.embed(["a", "b", "c"]).shape == (3, 2) and sent == [2, 1] and remote.usage_stats()["total_tokens"] == 14
    config = tmp_path / "c.yaml"
    for text in ("embedder:\n  provider: nobody\n", "embedder:\n  provider: openai\n", "embedder:\n  provider: local\n"):
        config.write_text(text)
        monkeypatch.delenv("OPENAI_API_KEY", raising=False)
        with pytest.raises(ConfigError):
            from_config(config)
    config.write_text("embedder:\n  provider: fixture\n  dimensions: 12\n")
    assert from_config(config).dimensions == 12


def test_dense_ids_over_many_partitions(spark):
    df = spark.createDataFrame([(f"k{i:05}",) for i in range(1000)], "m string").repartition(7)
    rows = ranking.dense_ids(df, "m", partitions=5).orderBy("m").collect()
    assert [r["embedding_id"] for r in rows] == list(range(1000))
    odd = spark.createDataFrame([(None, 1), ("a", None), ("a", 2), ("a", 2), ("b", 0)], "k string, n int").withColumn("key", F.struct("k", "n"))
    got = ranking.dense_ids(odd, "key", "place", partitions=4).orderBy("place").collect()
    assert [(r["place"], r["k"], r["n"]) for r in got] == [(0, None, 1), (1, "a", None), (2, "a", 2), (3, "a", 2), (4, "b", 0)]
    nulls = spark.createDataFrame([(None,), ("x",), (None,), ("a",)], "k string")
    assert [r["k"] for r in ranking.dense_ids(nulls, "k", "place", partitions=3).orderBy("place").collect()] == [None, None, "a", "x"]
    assert ranking.dense_ids(nulls.limit(0), "k").count() == 0


def test_job_queue(spark, tmp_path):
    path = str(tmp_path / "events")
    q = JobQueue(spark, path)
    with pytest.raises(ValueError):
        q.submit("not a url")
    a, b, c = (q.submit(f"https://git.example/{x}.git") for x in "abc")
    assert [r["id"] for r in jobs.queue_positions(q.state()).orderBy("queue_position").collect()] == [a, b, c]
    assert q.cancel(b) and not q.cancel(b)
    assert q.run_next(lambda url: {"embedding_total_tokens": 5, "embedding_estimated_cost_usd": 0.5}) == a
    assert q.run_next(lambda url: 1 / 0) == c and q.run_next(dict) is None
    states = {r["id"]: r for r in q.state().collect()}
    assert [states[j]["status"] for j in (a, b, c)] == ["succeeded", "cancelled", "failed"] and states[c]["error"].startswith("ZeroDivisionError")
    assert jobs.cost_summary(q.state()).first()["total_tokens"] == 5
    q._append(q.submit("https://git.example/d.git"), status="running")
    assert JobQueue(spark, path).state().where("status = 'running'").count() == 0


def test_streams(spark, tmp_path):
    events = tmp_path / "in"
    events.mkdir()
    rows = [{"id": "j", "seq": 1, "status": "queued", "at": "2024-01-01T00:00:00"}, {"id": "j", "seq": 1, "status": "queued", "at": "2024-01-01T00:00:00"}, {"id": "j", "seq": 2, "status": "running", "at": "2024-01-01T00:01:00"}]
    (events / "a.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    stream_job_states(spark, str(events), str(tmp_path / "ck"), lambda df: seen.extend((r["id"], r["status"]) for r in df.collect())).awaitTermination(60)
    assert ("j", "running") in seen and "status" in EVENTS
    changes = tmp_path / "changes"
    changes.mkdir()
    (changes / "a.json").write_text('{"path": "a", "status": "added"}\n{"path": "b", "status": "modified"}\n')
    held = {"df": spark.createDataFrame([("b", "added")], "path string, status string")}

    def save(df):
        held["df"] = spark.createDataFrame(df.collect(), "path string, status string")

    stream_changed_files(spark, str(changes), str(tmp_path / "ck2"), lambda: held["df"], save).awaitTermination(60)
    assert {(r["path"], r["status"]) for r in held["df"].collect()} == {("a", "added"), ("b", "modified")}


def test_export_needs_no_vectors(spark, repo, tmp_path):
    repo.commit(a_dot_py="x: int = 1\n")
    counts = export(index.build(spark, repo.root, URL, "shop", EMBEDDER), tmp_path / "out")
    assert counts["embeddings"] == 0 and np.load(tmp_path / "out/embeddings.npy").shape == (0, 384)


def test_commits_at_once_lose_nothing(spark, tmp_path):
    """Each commit finds, when it publishes, that another one has taken its number."""
    root = str(tmp_path / "store")
    one, two = SnapshotStore(spark, root), SnapshotStore(spark, root)
    rows = lambda name: spark.createDataFrame([("a.py", "err", name)], "path string, error string, repo_name string")
    publish, raced = one._publish, []

    def late(manifest):
        if not raced:
            raced.append(two.commit("b", {"failed_files": rows("b")}, sha="2"))
        return publish(manifest)

    one._publish = late
    assert one.commit("a", {"failed_files": rows("a")}, sha="1") == 2 and raced == [1]
    assert {r["repo_name"] for r in one.read("failed_files").collect()} == {"a", "b"} and (one.last_sha("a"), two.last_sha("b")) == ("1", "2")
    for _ in range(15):
        two.set_sha("b", "3")
        two.amend(lambda m: m["properties"].update(x=1))
    assert len(two._versions()) <= 11 and one.properties() == {"x": 1}


def test_remote_usage_is_counted_where_it_is_made_and_paid_once(spark, repo, store, tmp_path):
    calls = tmp_path / "calls"

    def send(texts):
        with calls.open("a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(t)), 1.0, 2.0, 3.0] for t in texts], 10 * len(texts)

    from codeloom.functions.vectors import RemoteEmbedder

    repo.commit(src__account_dot_py=USER)
    result = index.full_index(spark, repo.root, URL, "shop", store, tmp_path / "out", RemoteEmbedder(send, dimensions=4, batch=2))
    sent = [int(x) for x in calls.read_text().split()]
    assert sum(sent) == 6 and store.read("embeddings").count() == 6
    assert result.embedding_usage == {"model": "text-embedding-3-small", "total_tokens": 60, "requests": len(sent), "estimated_cost_usd": round(60 / 1e6 * 0.02, 8)}


def test_an_update_with_another_dimension_is_an_error(spark, repo, store):
    from codeloom.storage.vectors import VectorStore as Vectors

    repo.commit(a_dot_py="def f():\n    pass\n")
    Vectors(store, 4).setup()
    update(spark, repo, store)
    with pytest.raises(ValueError, match="4 dimensions, not 8"):
        incremental.update(spark, repo.root, URL, "shop", store, FixtureEmbedder(8))
    Vectors(store, 8).setup(recreate=True)
    assert store.read("embeddings").count() == 0 and store.properties() == {"dimensions": 8}


def test_the_last_status_of_a_path_counts(spark, tmp_path):
    from codeloom.streaming.ledger import stream_changed_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path":"x","status":"modified","seq":1}\n{"path":"x","status":"deleted","seq":2}\n{"path":"y","status":"deleted","seq":3}\n{"path":"y","status":"added","seq":4}\n')
    kept = []
    stream_changed_files(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda: spark.createDataFrame([], "path string, status string"), lambda df: kept.append(sorted(tuple(r) for r in df.select("path", "status").collect()))).awaitTermination()
    assert kept == [[("x", "deleted"), ("y", "added")]]


def test_clone(spark, repo, tmp_path):
    repo.commit(a_dot_py="def f():\n    return 1\n")
    root = git.clone(str(repo.root), tmp_path / "new" / "checkout")
    assert git.head_sha(root) == git.head_sha(repo.root) and git.remote_url(root) == str(repo.root)
    assert index.build(spark, root, URL, "shop", EMBEDDER).symbols.count() == 2
    for url in (str(tmp_path / "nowhere"), "--upload-pack=touch x"):
        with pytest.raises(git.GitError, match="git clone failed with exit code 128"):
            git.clone(url, tmp_path / "other")


def test_lists_of_strings_are_written_one_at_a_time(tmp_path):
    from codeloom.plans import export

    for values in ([], ["a"], ['b "é"', "c\n"]):
        with (tmp_path / "x.json").open("w", encoding="utf-8") as out:
            assert export._write_strings(out, iter(values)) == len(values)
        assert (tmp_path / "x.json").read_text(encoding="utf-8") == json.dumps(values, indent=2)


def test_garbage_is_what_no_manifest_names(spark, tmp_path, monkeypatch):
    root = tmp_path / "store"
    store = SnapshotStore(spark, str(root))
    row = lambda name, sha: spark.createDataFrame([(name, "u", sha)], "name string, url string, commit_sha string").withColumn("indexed_at", F.current_timestamp())
    assert store.collect_garbage(0) == []
    store.commit("one", {"repositories": row("one", "a")}, "a")
    store.commit("two", {"repositories": row("two", "a")}, "a")
    store.commit("one", {"repositories": row("one", "b")}, "b")
    store.staged(row("one", "c"))
    first = store._load(1)["tables"]["repositories"]["one"]
    assert store.collect_garbage() == []
    gone = store.collect_garbage(-60)
    assert len(gone) == 1 and gone[0].startswith("_staged/") and (root / first).exists()
    monkeypatch.setattr("codeloom.storage.snapshot.KEPT", 1)
    store.set_sha("one", "d")
    assert store.collect_garbage(-60) == [first] and not (root / first).exists()
    assert sorted((r["name"], r.commit_sha) for r in store.read("repositories").collect()) == [("one", "b"), ("two", "a")]
