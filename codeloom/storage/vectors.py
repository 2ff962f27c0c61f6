"""The vector table: dimension rules, upsert, delete, its index, and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import ranking
from codeloom.storage.snapshot import Delta, SnapshotStore
from codeloom.storage.vector_index import VectorIndex


class VectorStore:
    def __init__(self, store: SnapshotStore, dimensions: int):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.store, self.dimensions, self.index = store, dimensions, VectorIndex(store)

    def check(self) -> None:
        """Another dimension than the stored one is an error."""
        known = self.store.properties().get("dimensions")
        if known is not None and known != self.dimensions:
            raise ValueError(f"the table holds vectors of {known} dimensions, not {self.dimensions}")

    def setup(self, recreate: bool = False) -> None:
        """Declare the table, or make it anew: all parts and the dimension change in one swap."""
        if not recreate:
            self.check()
        if recreate:
            self.store.amend(lambda m: (m["tables"].pop("embeddings", None), m.get("indexes", {}).pop("embeddings", None), m["properties"].update(dimensions=self.dimensions)))
        elif "dimensions" not in self.store.properties():
            self.store.amend(lambda m: m["properties"].setdefault("dimensions", self.dimensions))
            self.check()

    def checked(self, vectors: DataFrame) -> DataFrame:
        """vectors, whose use fails on a vector of another length."""
        wrong = F.raise_error(F.format_string("a vector of %d dimensions, not " + str(self.dimensions), F.size("embedding")))
        return vectors.withColumn("embedding", F.when(F.size("embedding") == self.dimensions, F.col("embedding")).otherwise(wrong.cast("array<float>")))

    def write(self, repo: str, monikers: Sequence[str], vectors: Sequence[Sequence[float]]) -> int:
        """Upsert given rows; lengths are checked before anything is written."""
        if len(monikers) != len(vectors):
            raise ValueError(f"{len(monikers)} monikers, {len(vectors)} vectors")
        for v in vectors:
            if len(v) != self.dimensions:
                raise ValueError(f"a vector of {len(v)} dimensions, not {self.dimensions}")
        if monikers:
            rows = [(m, [float(x) for x in v]) for m, v in zip(monikers, vectors, strict=True)]
            self.upsert(repo, self.store.spark.createDataFrame(rows, "moniker string, embedding array<float>"))
        return len(monikers)

    def upserted(self, repo: str, vectors: DataFrame) -> Delta:
        """The change that puts the vectors in."""
        new = self.checked(vectors).select("moniker", "embedding", F.current_timestamp().alias("indexed_at"), F.lit(repo).alias("repo_name"))
        return Delta(new, new.select("moniker"))

    def upsert(self, repo: str, vectors: DataFrame) -> None:
        """Only the given rows are written; see ``SnapshotStore.compact``."""
        self.store.commit(repo, {"embeddings": self.upserted(repo, vectors)})
        self._tidy(repo)

    def delete(self, repo: str, monikers: DataFrame) -> None:
        """Delete by moniker; what is not there is no error."""
        self.store.commit(repo, {"embeddings": Delta(None, monikers.select("moniker"))})
        self._tidy(repo)

    def _tidy(self, repo: str) -> None:
        """Where a part had too many layers, one base of them, and the index of that."""
        if self.store.compact(repo):
            self.index.refresh()

    def search(self, query: Sequence[float], k: int = 10, repo: str | None = None) -> DataFrame:
        """moniker and dist of the k nearest vectors by cosine distance: approximate where the table has an index
        (``self.index.build``), else exact."""
        if len(query) != self.dimensions:
            raise ValueError(f"a query of {len(query)} dimensions, not {self.dimensions}")
        if self.index.record() is not None:
            return self.index.search(query, k, repo)
        asked = self.store.spark.range(1).select(F.array(*[F.lit(float(x)) for x in query]).alias("q"))
        return ranking.top_k(self.store.read("embeddings", repo), asked, k)
