"""The full index: files to symbols, relationships, edges, chunks and vectors, published as one snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import udtf
from codeloom.functions import chunks
from codeloom.functions.vectors import Embedder, FixtureEmbedder
from codeloom.operators import graph, ranking
from codeloom.sources import git
from codeloom.sources.repository import read_repository
from codeloom.storage.snapshot import Delta, SnapshotStore
from codeloom.storage.vector_index import VectorIndex


class DuplicateMonikers(ValueError):
    """Two symbols of one run share a moniker."""


@dataclass
class IndexResult:
    repo_name: str
    url: str
    commit_sha: str
    files: DataFrame
    symbols: DataFrame
    relationships: DataFrame
    failed_files: DataFrame
    vectors: DataFrame  # moniker, embedding
    embedding_usage: dict | None = None

    def languages(self) -> DataFrame:
        return graph.counts_by(self.files, "language")

    def edges(self) -> DataFrame:
        return graph.write_edges(self.symbols, self.relationships).withColumn("repo_name", F.lit(self.repo_name))


def _file_of(moniker: str) -> F.Column:
    return F.split(moniker, " ")[3]


def link_go_methods(symbols: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Go methods whose type is in another file get it as enclosing class, and a resolved containment. Of types that share a
    qualified name the last in (path, emission) order counts. Links of an earlier run across files are made anew."""
    own_file = F.replace("file_path", F.lit(" "), F.lit("%20"))
    loose = (F.col("language") == "go") & (F.col("kind") == "method") & (F.col("enclosing_class_id").isNull() | (_file_of("enclosing_class_id") != own_file))
    types = symbols.where("language = 'go' and kind = 'class'").select("id", "qualified_name", F.struct("file_path", "ord").alias("ord"))
    linked = graph.link_methods(symbols.where(loose).withColumn("enclosing_class_id", F.lit(None).cast("string")), types).select(*symbols.columns)
    new = linked.where("enclosing_class_id is not null").select(
        F.col("enclosing_class_id").alias("source_id"), F.lit("contains").alias("kind"), F.lit(True).alias("is_resolved"), F.col("id").alias("target_id"), F.lit(None).cast("string").alias("target_name"),
        F.lit(None).cast(relationships.schema["location"].dataType).alias("location"), F.lit(None).cast(relationships.schema["metadata"].dataType).alias("metadata"), "repo_name", "file_path", "ord",
    )
    across = (F.col("kind") == "contains") & (_file_of("source_id") != own_file)
    return symbols.where(~loose).unionByName(linked), relationships.where(~across).unionByName(new)


def unique_symbols(symbols: DataFrame, on_duplicate: str) -> DataFrame:
    """Fail on repeated monikers, or keep the first of each in (path, emission) order."""
    if on_duplicate == "first":
        return ranking.first_by(symbols, ["id"], [F.col("file_path"), F.col("ord")])
    found = graph.duplicates(symbols, ["id"]).orderBy("id").limit(5).collect()
    if found:
        raise DuplicateMonikers(", ".join(r["id"] for r in found))
    return symbols


def keep_vectors(built: DataFrame, embedder: Embedder, store: SnapshotStore | None) -> tuple[DataFrame, dict | None]:
    """moniker and embedding of chunks, made once and kept in a folder of the store where there is one, else cached; and what they
    cost, as observed by the job that makes them. Of embedders that are paid (``identity``) the store also keeps vectors by the
    digest of their text, so a text that any repository or commit has had before costs nothing."""
    wanted, seen = built.select("moniker", "chunk"), Observation()
    by_digest = store is not None and embedder.identity is not None
    if by_digest:
        digests = store.staged(wanted.withColumn("digest", F.sha2("chunk", 256)))
        known = store.read("chunk_vectors", embedder.identity)
        wanted = digests.join(known, "digest", "left_anti").dropDuplicates(["digest"]).select(F.col("digest").alias("moniker"), "chunk")
    made = wanted.select("moniker", embedder.measured("chunk").alias("made")).select("moniker", "made.embedding", "made.tokens", "made.requests")
    watched = made.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "requests")])
    if store:
        rows = store.staged(watched)
    else:
        rows = watched.persist()
        rows.count()
    if by_digest:
        new = rows.select(F.col("moniker").alias("digest"), "embedding")
        if new.limit(1).count():
            store.commit(embedder.identity, {"chunk_vectors": Delta(new, new.select("digest"))})
            store.compact(embedder.identity)
        rows = digests.join(known.unionByName(new), "digest")
    return rows.select("moniker", "embedding"), embedder.usage_of(seen.get["tokens"], seen.get["requests"])


def extract_repository(spark: SparkSession, root: str | Path, repo: str, gitignore: bool = True, paths: list[str] | None = None) -> DataFrame:
    """Extraction rows, kept, as files, symbols, relationships and failures are all read from them."""
    return udtf.extract(read_repository(spark, root, repo, gitignore, paths)).persist()


def build(spark: SparkSession, root: str | Path, url: str, repo: str, embedder: Embedder | None = None, gitignore: bool = True, on_duplicate: str = "first", store: SnapshotStore | None = None) -> IndexResult:
    """Index a checkout without publishing anything. Vectors are made once, as a provider is paid for them: kept in a folder of
    the store where there is one, else cached."""
    extracted = extract_repository(spark, root, repo, gitignore)
    symbols = unique_symbols(udtf.symbols_of(extracted), on_duplicate)
    symbols, relationships = link_go_methods(symbols, udtf.relationships_of(extracted))
    embedder = embedder or FixtureEmbedder()
    made, usage = keep_vectors(chunks.build(symbols, relationships), embedder, store)
    return IndexResult(repo, url, git.head_sha(root), udtf.files_of(extracted), symbols, relationships, udtf.failures_of(extracted), made.select("moniker", "embedding"), usage)


def publish(store: SnapshotStore, result: IndexResult) -> int:
    """Replace the repository's part of every table, and record its commit, in one swap."""
    spark = store.spark
    row = spark.createDataFrame([(result.repo_name, result.url, result.commit_sha)], "name string, url string, commit_sha string").withColumn("indexed_at", F.current_timestamp())
    vectors = result.vectors.withColumn("indexed_at", F.current_timestamp()).withColumn("repo_name", F.lit(result.repo_name))
    return store.commit(
        result.repo_name,
        {"repositories": row, "files": result.files, "symbols": result.symbols, "relationships": result.relationships, "edges": result.edges(), "embeddings": vectors, "failed_files": result.failed_files},
        sha=result.commit_sha,
    )


def full_index(spark: SparkSession, root: str | Path, url: str, repo: str, store: SnapshotStore | None = None, output: str | Path | None = None, embedder: Embedder | None = None, gitignore: bool = True, on_duplicate: str = "first") -> IndexResult:
    """Build, export and publish: artifacts first, then the snapshot of vectors and graph."""
    from codeloom.plans.export import export

    result = build(spark, root, url, repo, embedder, gitignore, on_duplicate, store)
    if output is not None:
        export(result, output)
    if store is not None:
        publish(store, result)
        VectorIndex(store).refresh()
    return result
