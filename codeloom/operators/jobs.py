"""Queries over the job ledger and its logs.

The ledger is append-only: events carry a job's id, a sequence number and the fields that they set; the current
state is the latest non-null value of each field. So a crash between writes loses nothing, and no row is updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINISHED = ("succeeded", "failed", "cancelled")
LOG_LINES = 10_000
STALE = "the service restarted while the job ran"


def is_finished(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*FINISHED)


def latest_state(events: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per job: the last value set of every field."""
    fields = [c for c in events.columns if c not in (key, seq)]
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields])


def fail_stale(jobs: DataFrame) -> DataFrame:
    """After a restart: what was running has failed; what was queued stays queued."""
    stale = F.col("status") == "running"
    return jobs.withColumn("error", F.when(stale, STALE).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def cost_summary(jobs: DataFrame) -> DataFrame:
    done = jobs.where(F.col("status") == "succeeded")
    return done.agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("embedding_total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("embedding_estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )


def cost_by_repo(jobs: DataFrame) -> DataFrame:
    done = jobs.where(F.col("status") == "succeeded")
    sums = done.groupBy("repo_url").agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("embedding_total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("embedding_estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )
    return sums.orderBy(F.desc("total_cost_usd"), F.desc("total_tokens"), "repo_url")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """id and place (from 1) of the queued jobs, oldest first. There is one queue with one worker, so its length bounds the
    single task that this takes."""
    order = Window.orderBy("created_at", "id")
    return jobs.where(F.col("status") == "queued").select("id", F.row_number().over(order).alias("queue_position"))


def latest_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def last_value(logs: DataFrame, pattern: str, name: str = "value", group: int = 1) -> DataFrame:
    """Per job the pattern's group in the last line that matches it."""
    found = F.regexp_extract("line", pattern, group)
    return logs.where(F.col("line").rlike(pattern)).groupBy("job_id").agg(F.max_by(found, "seq").alias(name))


def usage(logs: DataFrame) -> DataFrame:
    """Last tokens and cost per job, in any of the forms in which index commands print them."""
    tokens = last_value(logs, r"(?i)tokens(?: used)?\s*[:=]\s*([0-9][0-9,]*)", "tokens")
    cost = last_value(logs, r"(?i)cost(?:_usd| \(USD\))?\s*[:=]\s*\$?([0-9]+(?:\.[0-9]+)?)", "cost")
    both = tokens.join(cost, "job_id", "full_outer")
    return both.select("job_id", F.regexp_replace("tokens", ",", "").cast("long").alias("total_tokens"), F.col("cost").cast("double").alias("cost_usd"))


def failure_detail(logs: DataFrame) -> DataFrame:
    """Per job the last line on stderr that says what failed rather than where."""
    line = F.trim("line")
    telling = (F.col("source") == "stderr") & (line != "") & ~line.startswith('File "') & ~line.startswith("Traceback ") & ~line.startswith("^")
    return logs.where(telling).groupBy("job_id").agg(F.max_by(line, "seq").alias("error_detail"))


def log_tail(logs: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """The last n lines of every job; ranks are cut inside tasks first."""
    return logs.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("_r") <= n).drop("_r")


#: Ledger columns and the names that the API gives them.
API_NAMES = {
    "id": "id", "repo_url": "repoUrl", "replace": "replace", "status": "status", "queue_position": "queuePosition", "started_at": "startedAt", "finished_at": "finishedAt", "exit_code": "exitCode", "clone_path": "clonePath",
    "output_path": "outputPath", "error": "error", "error_detail": "errorDetail", "embedding_prompt_tokens": "embeddingPromptTokens", "embedding_total_tokens": "embeddingTotalTokens",
    "embedding_estimated_cost_usd": "embeddingEstimatedCostUsd", "pid": "pid", "created_at": "createdAt",
}
SUMMARY = (
    "symbol_count BIGINT, file_count BIGINT, languages MAP<STRING, BIGINT>, commit_sha STRING, embedding_provider STRING, embedding_model STRING, "
    "embedding_prompt_tokens BIGINT, embedding_total_tokens BIGINT, embedding_estimated_cost_usd DOUBLE"
)


def record(jobs: DataFrame) -> DataFrame:
    """Ledger rows as the API shows them; a summary that is no JSON object is null."""
    parsed = F.from_json("summary_json", SUMMARY + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    named = [F.coalesce("replace", F.lit(False)).alias("replace") if c == "replace" else F.col(c).alias(n) for c, n in API_NAMES.items()]
    return jobs.withColumn("_summary", parsed).select(*named, F.when(F.col("_summary._corrupt").isNull(), F.col("_summary").dropFields("_corrupt")).alias("summary"))


def duration_seconds(started: Column | str, finished: Column | str) -> Column:
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return F.round((micros(finished) - micros(started)) / 1e6, 3)


def usd(cost: Column | str) -> Column:
    return F.format_string("$%.6f", F.col(cost) if isinstance(cost, str) else cost)


def summary_counts(graph: DataFrame, *keys: str) -> DataFrame:
    """Sizes of an exported graph's arrays."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return graph.select(*keys, size("symbols").alias("symbols"), size("relationships").alias("relationships"), size("files").alias("files"), size("failed_files").alias("failed_files"), F.col("embeddings.count").alias("embeddings"))
