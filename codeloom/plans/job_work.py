"""What a job of the queue does: clone, index or update, export, and say what came of it and what it cost."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.functions.identity import repo_name
from codeloom.functions.vectors import Embedder, FixtureEmbedder
from codeloom.operators import graph
from codeloom.plans import incremental, index
from codeloom.plans.export import export
from codeloom.sources import git
from codeloom.storage.snapshot import SnapshotStore
from codeloom.storage.vectors import VectorStore


class IndexingWork:
    """Jobs over one store. A repository that the store knows is updated, unless the job says to replace it; the exported files go
    to ``<home>/<job>``, and the checkout is deleted when the job has ended, however it did."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, home: str | Path, embedder: Embedder | None = None, provider: str = "fixture"):
        self.spark, self.store, self.home = spark, store, Path(home)
        self.embedder, self.provider = embedder or FixtureEmbedder(), provider

    def run(self, job: dict, log: Callable[[str], None] = print) -> dict:
        url, checkout, output = job["repo_url"], self.home / "clones" / job["id"], self.home / job["id"]
        try:
            log(f"cloning {url}")
            root = git.clone(url, checkout)
            repo = self.spark.range(1).select(repo_name(F.lit(url)).alias("n")).first()["n"]
            VectorStore(self.store, self.embedder.dimensions).setup()
            if job.get("replace") or self.store.last_sha(repo) is None:
                log(f"indexing {repo}")
                result = index.full_index(self.spark, root, url, repo, self.store, embedder=self.embedder)
                usage = result.embedding_usage
            else:
                log(f"updating {repo}")
                done = incremental.update(self.spark, root, url, repo, self.store, self.embedder)
                log(f"added {done.added}, updated {done.updated}, deleted {done.deleted}, unchanged {done.skipped}")
                usage = done.embedding_usage
            export(self.published(repo, url), output)
            usage = {"total_tokens": 0, "estimated_cost_usd": 0.0, "model": self.provider} | (usage or {})
            log(f"tokens: {usage['total_tokens']} cost: ${usage['estimated_cost_usd']:.6f}")
            cost = {"embedding_prompt_tokens": usage["total_tokens"], "embedding_total_tokens": usage["total_tokens"], "embedding_estimated_cost_usd": float(usage["estimated_cost_usd"])}
            return {"clone_path": str(checkout), "output_path": str(output), "summary_json": json.dumps(self.summary(repo) | {"embedding_provider": self.provider, "embedding_model": usage["model"]} | cost)} | cost
        finally:
            shutil.rmtree(checkout, ignore_errors=True)

    def published(self, repo: str, url: str) -> index.IndexResult:
        """What the store holds of a repository."""
        read = lambda table: self.store.read(table, repo)
        return index.IndexResult(repo, url, self.store.last_sha(repo), read("files"), read("symbols"), read("relationships"), read("failed_files"), read("embeddings").select("moniker", "embedding"))

    def summary(self, repo: str) -> dict:
        languages = {r["language"]: r["n"] for r in graph.counts_by(self.store.read("files", repo), "language").collect()}
        return {"symbol_count": self.store.read("symbols", repo).count(), "file_count": sum(languages.values()), "languages": languages, "commit_sha": self.store.last_sha(repo)}
