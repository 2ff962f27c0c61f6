"""The job queue over HTTP."""

import json
import threading
import urllib.error
import urllib.request

from codeloom import api
from codeloom.streaming.ledger import JobQueue


def test_routes(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "events"))
    server = api.server(queue, tmp_path)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data)) as r:
                raw = r.read()
                return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())["detail"]

    try:
        assert set(call("/api/health")[1]) == {"openai_key_set", "disk_free_gb"}
        assert call("/api/jobs") == (200, [])
        assert call("/api/jobs", {"repoUrl": "not a url"}) == (400, "repoUrl must look like a git URL")
        assert call("/api/jobs", {}) == (400, "repoUrl is missing") and call("/api/jobs", b"{") == (400, "the request is not JSON")
        assert call("/api/jobs", b" " * (api.LARGEST + 1))[0] == 400
        one = call("/api/jobs", {"repoUrl": "https://git.example/org/shop.git", "replace": True})[1]
        two = call("/api/jobs", {"repoUrl": "https://git.example/org/shop.git"})[1]
        assert (one["status"], one["replace"], one["queuePosition"], two["queuePosition"]) == ("queued", True, 1, 2)
        assert {j["id"] for j in call("/api/jobs")[1]} == {one["id"], two["id"]}
        assert call(f"/api/jobs/{one['id']}/cancel", {}) == (200, {"status": "cancelled"})
        assert call(f"/api/jobs/{one['id']}/cancel", {}) == (409, "job already finished")
        assert call("/api/jobs/abc") == (404, "job not found") and call("/api/else") == (404, "not found")
        (tmp_path / two["id"]).mkdir()
        (tmp_path / two["id"] / "graph.json").write_text("{}")
        queue.run_next(lambda url: {"output_path": str(tmp_path / two["id"]), "embedding_total_tokens": 5})
        assert call(f"/api/jobs/{two['id']}")[1]["status"] == "succeeded"
        assert call(f"/api/jobs/{two['id']}/artifacts/graph.json") == (200, b"{}")
        assert call(f"/api/jobs/{two['id']}/artifacts/embeddings.npy") == (404, "artifact not found")
        assert call(f"/api/jobs/{two['id']}/artifacts/secrets") == (404, "artifact not allowed")
        assert call(f"/api/jobs/{two['id']}/artifacts/../x")[0] == 404
        assert isinstance(call("/api/jobs/cost-summary")[1], dict)
    finally:
        server.shutdown()
        server.server_close()


def test_lines_of_a_running_job_are_streamed(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "events"))
    job = queue.submit("https://git.example/org/shop.git")
    server = api.server(queue, tmp_path)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    seen, started = [], threading.Event()

    def listen():
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/jobs/{job}/stream") as r:
            for line in r:
                seen.append(line.decode().strip())
                started.set()

    def work(url):
        queue.log("first")
        listener = threading.Thread(target=listen)
        listener.start()
        assert started.wait(60)
        queue.log("second", "stderr")
        work.listener = listener
        return {}

    try:
        assert queue.run_next(work) == job
        work.listener.join(60)
        events = [(seen[k].removeprefix("event: "), json.loads(seen[k + 1].removeprefix("data: "))) for k in range(len(seen)) if seen[k].startswith("event: ")]
        assert events[:2] == [("log", {"source": "stdout", "line": "first"}), ("log", {"source": "stderr", "line": "second"})]
        assert events[2][0] == "completed" and events[2][1]["status"] == "succeeded" and events[2][1]["pid"] > 0
    finally:
        server.shutdown()
        server.server_close()


def test_slow_listeners_lose_the_oldest_and_quiet_ones_are_told():
    from codeloom.streaming.logs import LogHub

    hub = LogHub(kept=3)
    for k in range(5):
        hub.line("j", "stdout", str(k))
    lines, listener = hub.listen("j")
    assert [x["line"] for x in lines] == ["2", "3", "4"]
    events = listener.events(quiet=0.01)
    assert next(events) is None
    for k in range(1500):
        hub.line("j", "stdout", str(k))
    hub.end("j", "over")
    got = list(events)
    assert len(got) == 1000 and got[0][1]["line"] == "501" and got[-1] == ("completed", "over") and hub.listen("j")[0] == []
