"""The job queue over HTTP, with the standard library's server: one route is one library call, answers are JSON.

GET /api/health, /api/jobs, /api/jobs/cost-summary, /api/jobs/<id>, /api/jobs/<id>/artifacts/<name>, and /api/jobs/<id>/stream,
which sends the lines of a running job as server-sent events until the job is completed; POST /api/jobs with
{"repoUrl", "replace"}, /api/jobs/<id>/cancel. Errors are {"detail"} with 400, 404 or 409. The server listens on this machine
only unless it is given another address, and knows neither users nor passwords.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import functions as F

from codeloom.operators import jobs
from codeloom.streaming.ledger import JobQueue
from codeloom.streaming.logs import END

#: The files of an export that may be fetched.
ARTIFACTS = ("graph.json", "embeddings.npy", "embeddings_index.json")
#: Bytes of the largest request that is read.
LARGEST = 1 << 16
_JOB = re.compile(r"/api/jobs/([0-9a-f]+)(?:/(cancel|stream|artifacts/([\w.]+)))?")


class Problem(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def _event(name: str, value: object) -> bytes:
    return f"event: {name}\ndata: {json.dumps(value, default=str)}\n\n".encode()


class Routes:
    """What the routes answer: JSON values, the path of a file, or events."""

    def __init__(self, queue: JobQueue, home: str | Path):
        self.queue, self.home = queue, Path(home)

    def _records(self, rows) -> list[dict]:
        return [r.asDict(recursive=True) for r in jobs.record(rows).collect()]

    def _job(self, job: str) -> dict:
        found = self._records(self._state().where(F.col("id") == job))
        if not found:
            raise Problem(404, "job not found")
        return found[0]

    def _state(self):
        state = self.queue.state()
        places = jobs.queue_positions(state).select("id", F.col("queue_position").alias("_place"))
        return state.join(places, "id", "left").withColumn("queue_position", F.col("_place").cast("int")).drop("_place")

    def get(self, path: str) -> object:
        if path == "/api/health":
            return {"openai_key_set": bool(os.environ.get("OPENAI_API_KEY", "").strip()), "disk_free_gb": round(shutil.disk_usage(self.home).free / 2**30, 2)}
        if path == "/api/jobs":
            return self._records(jobs.latest_jobs(self._state()))
        if path == "/api/jobs/cost-summary":
            return jobs.cost_summary(self.queue.state()).first().asDict()
        match = _JOB.fullmatch(path)
        if match is None or match[2] == "cancel":
            raise Problem(404, "not found")
        if match[2] is None:
            return self._job(match[1])
        if match[2] == "stream":
            return self.stream(match[1], self._job(match[1]))
        if match[3] not in ARTIFACTS:
            raise Problem(404, "artifact not allowed")
        file = Path(self._job(match[1])["outputPath"] or self.home / match[1]) / match[3]
        if not file.is_file():
            raise Problem(404, "artifact not found")
        return file

    def stream(self, job: str, record: dict) -> Iterator[bytes]:
        """Server-sent events: the lines so far, each line to come, and the job's record when it is over."""
        lines, listener = self.queue.hub.listen(job)
        try:
            for value in lines:
                yield _event("log", value)
            # Asked again after listening has begun, so that an end between the two is not missed.
            if self._job(job)["status"] in jobs.FINISHED:
                yield _event(END, self._job(job))
                return
            for found in listener.events():
                yield b": keepalive\n\n" if found is None else _event(*found) if found[0] != END else _event(END, self._job(job))
        finally:
            self.queue.hub.leave(job, listener)

    def post(self, path: str, body: object) -> object:
        if path == "/api/jobs":
            if not isinstance(body, dict) or not isinstance(body.get("repoUrl"), str):
                raise Problem(400, "repoUrl is missing")
            try:
                return self._job(self.queue.submit(body["repoUrl"], body.get("replace") is True))
            except ValueError:
                raise Problem(400, "repoUrl must look like a git URL") from None
        match = _JOB.fullmatch(path)
        if match is None or match[2] != "cancel":
            raise Problem(404, "not found")
        before = self._job(match[1])["status"]
        if not self.queue.cancel(match[1]):
            raise Problem(409, "job already finished")
        return {"status": "cancelled" if before == "queued" else "cancelling"}


def server(queue: JobQueue, home: str | Path, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; ``serve_forever`` runs it."""
    routes = Routes(queue, home)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, value: object) -> None:
            if isinstance(value, Iterator):
                self.send_response(status)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                with contextlib.suppress(BrokenPipeError, ConnectionResetError):
                    for event in value:
                        self.wfile.write(event)
                        self.wfile.flush()
                value.close()
                return
            is_file = isinstance(value, Path)
            data = b"" if is_file else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/octet-stream" if is_file else "application/json")
            self.send_header("Content-Length", str(value.stat().st_size if is_file else len(data)))
            self.end_headers()
            if is_file:
                with value.open("rb") as f:
                    shutil.copyfileobj(f, self.wfile)
            else:
                self.wfile.write(data)

        def _run(self, route, *args) -> None:
            try:
                self._answer(200, route(self.path.partition("?")[0], *args))
            except Problem as e:
                self._answer(e.status, {"detail": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            self._run(routes.get)

        def do_POST(self) -> None:  # noqa: N802
            size = self.headers.get("Content-Length", "0")
            if not size.isdigit() or int(size) > LARGEST:
                self.close_connection = True
                return self._answer(400, {"detail": "the request is too large"})
            try:
                body = json.loads(self.rfile.read(int(size)) or b"null")
            except ValueError:
                return self._answer(400, {"detail": "the request is not JSON"})
            self._run(routes.post, body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
