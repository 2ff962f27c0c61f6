"""The life of jobs as keyed state, the ledger's files, and a job from submission to summary."""

import json
import random
import threading
import time

import pytest

from codeloom import cli
from codeloom.functions.vectors import RemoteEmbedder
from codeloom.operators import jobs
from codeloom.plans.job_work import IndexingWork
from codeloom.sources import git
from codeloom.storage.snapshot import SnapshotStore
from codeloom.streaming import ledger, lifecycle
from codeloom.streaming.ledger import EVENTS, JobQueue
from tests.test_plans import Repo

START = 1_700_000_000


def event(job, seq, at, **fields):
    return {"id": job, "seq": seq, "at": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(START + at))} | fields


def run_stream(spark, tmp_path, files, **options):
    """The changes that a stream over these files of events gives, in order; one file is one batch."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    stream = spark.readStream.schema(EVENTS + ", at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    for n, rows in enumerate(files):
        (folder / f"{n:03}.json").write_text("\n".join(map(json.dumps, rows)))
        query = lifecycle.follow(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
        query.trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(r.asDict() for r in df.collect())).start().awaitTermination(120)
    return seen


def test_same_states_as_the_ledger_whatever_the_order(spark, tmp_path):
    rng, events = random.Random(5), []
    for j in range(12):
        job, end = f"j{j}", rng.choice(["succeeded", "failed", "cancelled", None])
        steps = [{"status": "queued", "repo_url": f"u{j}", "created_at": "c"}, {"status": "running", "pid": j}, {"embedding_total_tokens": j}, {"status": end, "exit_code": 0, "embedding_estimated_cost_usd": 0.5}]
        events += [event(job, 10 * j + k, j + k, **s) for k, s in enumerate(steps[: 3 if end is None else 4])]
    shuffled = rng.sample(events, len(events)) + rng.choices(events, k=10)
    seen = run_stream(spark, tmp_path, [shuffled[k::3] for k in range(3)])
    last = {r["id"]: r for r in seen}
    plain = spark.createDataFrame([tuple(e.get(n.split()[0]) for n in EVENTS.split(", ")) for e in events], EVENTS)
    for want in jobs.latest_state(plain).collect():
        assert {k: last[want["id"]][k] for k in want.asDict()} == want.asDict()
    assert all(r["refused"] == [] for r in last.values()) and {r["action"] for r in seen} == {None}


def test_steps_that_cannot_be_are_refused_until_they_can(spark, tmp_path):
    files = [
        [event("a", 2, 1, status="running"), event("b", 1, 1, status="queued"), event("b", 2, 2, status="succeeded")],
        [event("a", 1, 3, status="queued"), event("b", 3, 3, status="cancelled"), event("b", 4, 4, status="running")],
    ]
    seen = run_stream(spark, tmp_path, files)
    by = lambda job: [(r["status"], r["refused"]) for r in seen if r["id"] == job]
    assert by("a") == [(None, [2]), ("running", [])]
    assert by("b") == [("queued", [2]), ("cancelled", [2, 4])]


def test_timers_fail_the_stale_and_kill_after_the_grace(spark, tmp_path):
    files = [
        [event(j, k, k, status=s) for j in ("stale", "slow", "good") for k, s in enumerate(["queued", "running"])],
        [event("slow", 5, 20, status="cancelling"), event("good", 5, 20, status="cancelling"), event("good", 6, 22, status="cancelled")],
        [event("clock", 1, 40, status="queued")],
        [event("clock", 2, 130, pid=1)],
        [event("clock", 3, 131, pid=2)],
    ]
    seen = run_stream(spark, tmp_path, files, stale=100, grace=10, lateness="0 seconds")
    by = lambda job: [(r["status"], r["action"], r["error"]) for r in seen if r["id"] == job]
    assert by("slow") == [("running", None, None), ("cancelling", "stop", None), ("cancelled", "kill", None)]
    assert by("good") == [("running", None, None), ("cancelled", None, None)]
    assert by("stale") == [("running", None, None), ("failed", "stale", jobs.STALE)]


def test_event_files_are_made_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FILES", 5)
    queue = JobQueue(spark, str(tmp_path / "events"))
    ids = [queue.submit(f"https://git.example/{k}.git") for k in range(13)]
    files = list((tmp_path / "events").glob("*.parquet"))
    assert len(files) <= 6 and not list((tmp_path / "events").glob("_made*"))
    assert {r["id"] for r in queue.state().where("status = 'queued'").collect()} == set(ids) and queue.events().count() == 13
    assert queue.compact() > 1 and queue.compact() == 1 and queue.events().count() == 13


def test_two_workers_take_different_jobs(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "events"))
    ids = [queue.submit(f"https://git.example/{k}.git") for k in range(4)]
    taken, lock = [], threading.Lock()

    def work(url):
        with lock:
            taken.append(url)
        return {}

    workers = [threading.Thread(target=cli.run_jobs, args=(queue, work, threading.Event(), 0)) for _ in range(2)]
    [w.start() for w in workers]
    [w.join(120) for w in workers]
    assert sorted(taken) == [f"https://git.example/{k}.git" for k in range(4)]
    assert queue.state().where("status = 'succeeded'").count() == len(ids)


def test_a_job_that_does_not_stop_is_killed(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "events"))
    job = queue.submit("https://git.example/x.git")
    queue._append(job, status="running")
    watching = queue.watch(str(tmp_path / "ck"), grace=1)
    queue._append(job, status="cancelling")
    for _ in range(120):
        if queue.status_of(job) == "cancelled":
            break
        time.sleep(0.5)
    watching.stop()
    assert queue.status_of(job) == "cancelled"


def test_a_job_from_submission_to_summary(spark, tmp_path, monkeypatch):
    url, root = "https://git.example/org/shop.git", tmp_path / "origin"
    root.mkdir()
    repo = Repo(root)
    repo.commit(**{f"m{i}_dot_py": f"def f{i}(x):\n    return {i}\n" for i in range(5)})
    real = git.clone
    monkeypatch.setattr(git, "clone", lambda u, to: real(str(root) if u == url else u, to))
    embedder = RemoteEmbedder(lambda texts: ([[float(len(t)), 1.0] for t in texts], 10 * len(texts)), dimensions=2)
    queue, store = JobQueue(spark, str(tmp_path / "events")), SnapshotStore(spark, str(tmp_path / "store"))
    work = IndexingWork(spark, store, tmp_path / "home", embedder, "remote")
    first = queue.submit(url)
    lines = []
    monkeypatch.setattr(queue, "log", lambda line, source="stdout": lines.append((source, line)))
    assert cli.run_jobs(queue, work, threading.Event(), 0) == 1
    repo.commit(m0_dot_py="def f0(x):\n    return 'other'\n")
    second, gone = queue.submit(url), queue.submit("https://git.example/nowhere.git")
    assert cli.run_jobs(queue, work, threading.Event(), 0) == 2
    rows = {r["id"]: r for r in jobs.record(queue.state()).collect()}
    assert [rows[j]["status"] for j in (first, second, gone)] == ["succeeded", "succeeded", "failed"]
    one, two = rows[first]["summary"], rows[second]["summary"]
    assert (one["symbol_count"], one["file_count"], one["languages"], one["embedding_total_tokens"]) == (10, 5, {"python": 5}, 50)
    assert (two["symbol_count"], two["embedding_total_tokens"], two["commit_sha"]) == (10, 10, git.head_sha(root))
    assert rows[gone]["error"].startswith("GitError") and ("stderr", lines[-1][1]) == lines[-1]
    assert jobs.cost_summary(queue.state()).first()["total_tokens"] == 60
    assert len(json.loads((tmp_path / "home" / second / "graph.json").read_text())["symbols"]) == 10
    assert not list((tmp_path / "home" / "clones").iterdir()) and "updating" in " ".join(line for _, line in lines)
    usage = jobs.usage(spark.createDataFrame([("j", k, line) for k, (_, line) in enumerate(lines)], "job_id string, seq int, line string")).first()
    assert usage["total_tokens"] == 10


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    where = ["--jobs", str(tmp_path / "events")]
    assert cli.main(["submit", *where, "--repo-url", "https://git.invalid/x.git"]) == 0
    monkeypatch.setattr(git, "clone", lambda url, to: (_ for _ in ()).throw(git.GitError("no such host")))
    assert cli.main(["work", *where, "--store", str(tmp_path / "s"), "--home", str(tmp_path / "h")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"jobs": 1}
    row = JobQueue(spark, str(tmp_path / "events")).state().first()
    assert (row["status"], row["error"]) == ("failed", "GitError: no such host")
    with pytest.raises(SystemExit):
        cli.main(["serve"])
