"""The job ledger as an append-only event table, its driver-side queue, and streams into both.

Events are small Parquet appends; the state of a job is the last value set of each field (``jobs.latest_state``). The
stream form reads event files as they arrive, with a watermark that bounds the state kept for dropping repeats.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import jobs
from codeloom.operators.graph import upsert
from codeloom.schemas import CHANGED_FILES, JOBS
from codeloom.streaming import lifecycle
from codeloom.streaming.logs import LogHub

EVENTS = "id string, seq bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in JOBS.fields if f.name != "id")


#: Event files above which they are made one.
FILES = 64


def now() -> str:
    return datetime.now(UTC).isoformat()


class JobQueue:
    """First in first out: queued, running, then succeeded, failed or cancelled. Threads may share a queue: numbers are given, and a
    job is taken, under its lock. Event files are made one when there are more than ``FILES``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._lock, self._appended = threading.RLock(), 0
        self.hub, self.running = LogHub(), None
        self.seq = self.events().agg(F.max("seq")).first()[0] or 0
        for r in self.state().where("status = 'running'").select("id").collect():  # a restart ends what ran
            self._append(r["id"], status="failed", error=jobs.STALE, finished_at=now())

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(self.path)
        except Exception as e:  # the folder is made by the first event
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENTS)

    def state(self) -> DataFrame:
        return jobs.latest_state(self.events())

    def _append(self, job: str, **fields) -> None:
        with self._lock:
            # Microseconds, so that events of several writers are in order of time; never less than this writer's last.
            self.seq = max(self.seq + 1, time.time_ns() // 1000)
            row = {"id": job, "seq": self.seq} | fields
            names = [x.split(" ", 1)[0] for x in EVENTS.split(", ")]
            self.spark.createDataFrame([tuple(row.get(n) for n in names)], EVENTS).coalesce(1).write.mode("append").parquet(self.path)
            self._appended += 1
            if self._appended % FILES == 0:
                self.compact()

    def compact(self) -> int:
        """Make one of the event files there are, and return how many they were. The new file is there before the old ones go;
        events that are read twice count once."""
        with self._lock:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
            fs = path(self.path).getFileSystem(conf)
            files = [s.getPath() for s in fs.listStatus(path(self.path)) if s.isFile() and s.getPath().getName().endswith(".parquet")]
            if len(files) < 2:
                return len(files)
            made = f"{self.path}/_made-{uuid.uuid4().hex}"
            events = self.spark.read.schema(EVENTS).parquet(*[f.toString() for f in files])
            events.distinct().coalesce(1).write.parquet(made)
            for s in fs.listStatus(path(made)):
                if s.getPath().getName().endswith(".parquet"):
                    fs.rename(s.getPath(), path(f"{self.path}/all-{uuid.uuid4().hex}.parquet"))
            for f in files:
                fs.delete(f, False)
            fs.delete(path(made), True)
            return len(files)

    def watch(self, checkpoint: str, stale: float = 3600, grace: float = 10, clock: str = "processing", trigger: dict | None = None):
        """Follow the ledger's own events (see ``lifecycle``) and do what is due: Spark jobs of one that is to stop or to be killed are
        cancelled, and what a timer has decided goes into the ledger."""
        events = self.spark.readStream.schema(EVENTS).option("ignoreMissingFiles", "true").parquet(self.path).withColumn("at", F.timestamp_micros("seq"))

        def act(rows: DataFrame, _: int) -> None:
            for r in rows.where("action is not null").select("id", "status", "action", "error").collect():
                self.spark.sparkContext.cancelJobsWithTag(f"job-{r['id']}")
                if r["action"] != "stop" and self.status_of(r["id"]) not in jobs.FINISHED:
                    self._append(r["id"], status=r["status"], error=r["error"], finished_at=now())
                    self.hub.end(r["id"])

        changes = lifecycle.follow(events, stale, grace, clock=clock)
        return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(act).start()

    def status_of(self, job: str) -> str | None:
        row = self.state().where(F.col("id") == job).first()
        return row["status"] if row else None

    def log(self, line: str, source: str = "stdout") -> None:
        """A line of the job that runs, for those who listen to it."""
        if self.running is not None:
            self.hub.line(self.running, source, line)

    def submit(self, url: str, replace: bool = False) -> str:
        """Queue a job; the url must look like one of a git repository."""
        from codeloom.functions.identity import is_git_url

        if not self.spark.range(1).select(is_git_url(F.lit(url)).alias("ok")).first()["ok"]:
            raise ValueError(f"not a git url: {url}")
        job = uuid.uuid4().hex
        self._append(job, repo_url=url.strip(), replace=replace, status="queued", created_at=now())
        return job

    def cancel(self, job: str) -> bool:
        """Cancel a job that has not ended; a running one has its Spark jobs stopped."""
        row = self.state().where(F.col("id") == job).first()
        if row is None or row["status"] in jobs.FINISHED:
            return False
        self.spark.sparkContext.cancelJobsWithTag(f"job-{job}")
        self._append(job, status="cancelled", finished_at=now())
        self.hub.end(job)
        return True

    def run_next(self, work: Callable[[str], dict]) -> str | None:
        """Run the oldest queued job's work under its tag; its result's fields go into the ledger. ``work`` is called with the url, or,
        if it has a method ``run``, that with the job's row and a function that logs a line."""
        with self._lock:
            row = self.state().where("status = 'queued'").orderBy("created_at", "id").first()
            if row is None:
                return None
            job, context = row["id"], self.spark.sparkContext
            self._append(job, status="running", started_at=now(), pid=os.getpid())
        self.running = job
        context.addJobTag(f"job-{job}")
        try:
            done = {"status": "succeeded", "exit_code": 0} | (work.run(row.asDict(), self.log) if hasattr(work, "run") else work(row["repo_url"]))
        except Exception as e:  # noqa: BLE001  the job failed, not the worker
            done = {"status": "failed", "exit_code": 1, "error": f"{type(e).__name__}: {e}"}
            self.log(f"{type(e).__name__}: {e}", "stderr")
        finally:
            context.removeJobTag(f"job-{job}")
        if self.state().where(F.col("id") == job).first()["status"] == "running":
            self._append(job, finished_at=now(), **done)
        self.running = None
        self.hub.end(job)
        return job


def stream_job_states(spark: SparkSession, source: str, checkpoint: str, publish: Callable[[DataFrame], None], lateness: str = "1 hour"):
    """Follow event files (JSON with an ``at`` timestamp): repeats within ``lateness`` are dropped, and each batch's changes
    are handed to ``publish`` as one row per job. Ends when all files there are have been read."""
    events = spark.readStream.schema(EVENTS + ", at timestamp").json(source)
    fresh = events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id", "seq"])

    def batch(rows: DataFrame, _: int) -> None:
        publish(jobs.latest_state(rows.drop("at")))

    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def stream_changed_files(spark: SparkSession, source: str, checkpoint: str, state: Callable[[], DataFrame], save: Callable[[DataFrame], None]):
    """Follow JSON files of (path, status) rows, with a growing ``seq`` where one file holds several of a path, and keep the last
    status of each path: of the largest seq, else of the latest file. A batch that is repeated after a failure writes the
    same rows again."""
    file = F.col("_metadata")
    order = F.struct(F.coalesce("seq", F.lit(0).cast("long")), file["file_modification_time"], file["file_name"], "status")
    changes = spark.readStream.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CHANGED_FILES.fields)}, seq bigint").json(source)
    changes = changes.withColumn("order", order)

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("path").agg(F.max_by("status", "order").alias("status"))
        save(upsert(state(), last, "path", keep_old_values=False))

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
