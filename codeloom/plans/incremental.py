"""Incremental update: only files that differ between two commits are read, compared and written.

All changed files go through one plan: old and new symbols meet in one full outer join on (id), and what is
unchanged is neither embedded nor written: a commit is a delta with the rows of the changed files, of Go files whose methods found or lost
their type in another file, and of the edges that touch any of their symbols. The new snapshot and the new commit are
published by one swap, so a failed run changes nothing and a repeated one finds nothing to do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import udtf
from codeloom.functions import chunks
from codeloom.functions.vectors import Embedder, FixtureEmbedder
from codeloom.operators import graph
from codeloom.plans import index
from codeloom.sources import git
from codeloom.sources.gitignore import Rules
from codeloom.sources.repository import indexable, walk
from codeloom.storage.snapshot import Delta, SnapshotStore
from codeloom.storage.vector_index import VectorIndex
from codeloom.storage.vectors import VectorStore

THRESHOLD, LEAST_FILES = 0.5, 2


@dataclass
class UpdateResult:
    old_sha: str | None
    new_sha: str
    added: int = 0
    updated: int = 0
    deleted: int = 0
    skipped: int = 0
    fell_back: bool = False
    failed_files: list[tuple[str, str]] = field(default_factory=list)

    #: Of embedders that count their usage: what the vectors of this update cost. Set where there is one.
    embedding_usage = None


def _paths(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], f"{column} string")


def _edge_changes(now: DataFrame, ids: DataFrame, before: DataFrame, after: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to write, and those that older layers hold no more: all that touch one of ``ids`` (symbols of the files at
    ``paths``, before or after), or that relationships of these files say. They are made again from the relationships of any file."""
    touching = lambda df, *ends: [df.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*df.columns) for end in ends]
    said = graph.resolved(before.join(paths, "file_path", "left_semi")).select(F.col("source_id").alias("src"), F.upper("kind").alias("label"), F.col("target_id").alias("dst"))
    old = edges.select("src", "label", "dst")
    gone = said
    for some in touching(old, "src", "dst"):
        gone = gone.union(some)
    keyed = graph.resolved(after).withColumns({"src": F.col("source_id"), "label": F.upper("kind"), "dst": F.col("target_id")})
    wanted = keyed.join(paths, "file_path", "left_semi").select(*keyed.columns)
    for some in (*touching(keyed, "source_id", "target_id"), keyed.join(gone, ["src", "label", "dst"], "left_semi").select(*keyed.columns)):
        wanted = wanted.union(some)
    new = graph.write_edges(now, wanted.drop("src", "label", "dst")).persist()
    return new, gone.union(new)


def _full(spark: SparkSession, root, url: str, repo: str, store: SnapshotStore, embedder: Embedder, old: str | None, new: str, gitignore: bool) -> UpdateResult:
    result = index.full_index(spark, root, url, repo, store, embedder=embedder, gitignore=gitignore)
    failed = [(r["path"], r["error"]) for r in result.failed_files.collect()]
    update = UpdateResult(old, new, added=store.read("symbols", repo).count(), fell_back=True, failed_files=failed)
    if result.embedding_usage is not None:
        update.embedding_usage = result.embedding_usage
    return update


def _touched(spark: SparkSession, table: DataFrame, paths: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the given files, and the others."""
    those = spark.createDataFrame([(p,) for p in paths], f"{column} string")
    return table.join(those, column, "left_semi"), table.join(those, column, "left_anti")


def update(spark: SparkSession, root: str | Path, url: str, repo: str, store: SnapshotStore, embedder: Embedder | None = None, threshold: float = THRESHOLD, gitignore: bool = True, strict_checkpoint: bool = False) -> UpdateResult:
    """Bring the snapshot of a repository to the checked-out commit.

    Unknown commits on either side, a failing diff, or more than ``threshold`` of the files changed lead to a full index. With
    ``strict_checkpoint`` files that fail keep the old commit on record, so the next run tries them again.
    """
    embedder = embedder or FixtureEmbedder()
    VectorStore(store, embedder.dimensions).check()
    old, new = store.last_sha(repo), git.head_sha(root)
    if old is None or git.UNKNOWN in (old, new):
        return _full(spark, root, url, repo, store, embedder, old, new, gitignore)
    if old == new:
        return UpdateResult(old, new)
    try:
        diff = git.changes(root, old, new)
    except git.GitError:
        return _full(spark, root, url, repo, store, embedder, old, new, gitignore)
    rules = Rules.load(root) if gitignore else None
    files = walk(root, rules)
    if len(files) >= LEAST_FILES and len(diff) / len(files) > threshold:
        return _full(spark, root, url, repo, store, embedder, old, new, gitignore)

    deleted = [p for p, status in diff if status == "deleted"]
    to_read = indexable([p for p, status in diff if status != "deleted"], rules, root)
    if not deleted and not to_read:
        store.set_sha(repo, new)
        return UpdateResult(old, new)

    extracted = index.extract_repository(spark, root, repo, gitignore, to_read)
    failed = [(r["path"], r["error"]) for r in udtf.failures_of(extracted).collect()]
    lost = {p for p, _ in failed}
    read = [p for p in to_read if p not in lost]  # a file that fails keeps what it had
    fresh = index.unique_symbols(udtf.symbols_of(extracted), "first")
    fresh_relationships = udtf.relationships_of(extracted)

    symbols, relationships = store.read("symbols", repo), store.read("relationships", repo)
    before, kept = _touched(spark, symbols, [*deleted, *read], "file_path")
    statuses = graph.diff(before.select("id", "body_hash"), fresh.select("id", "body_hash", "ord")).persist()
    counts = graph.diff_counts(statuses).first()

    now, all_relationships = index.link_go_methods(
        kept.unionByName(fresh), _touched(spark, relationships, [*deleted, *read], "file_path")[1].unionByName(fresh_relationships)
    )
    now = now.persist()
    # Vectors: of symbols that are new or differ, and of classes whose list of methods has changed.
    changed = statuses.where(F.col("status").isin("added", "updated")).select("id")
    owners = now.where("kind = 'method'").join(changed, "id", "left_semi").select(F.col("enclosing_class_id").alias("id")).where("id is not null")
    former = before.where("kind = 'method'").join(statuses.where("status = 'deleted'").select("id"), "id", "left_semi").select(F.col("enclosing_class_id").alias("id")).where("id is not null")
    to_embed = changed.union(owners).union(former).distinct()
    wanted = now.join(to_embed, "id", "left_semi")
    methods_of = now.where("kind = 'method'").join(to_embed.select(F.col("id").alias("enclosing_class_id")), "enclosing_class_id", "left_semi").select(*now.columns)
    scope = wanted.unionByName(methods_of).dropDuplicates(["id"])
    built = chunks.build(scope, graph.affected(all_relationships, to_embed)).join(to_embed.select(F.col("id").alias("moniker")), "moniker", "left_semi")
    vectors, usage = index.keep_vectors(built, embedder, store)
    stamped = vectors.select("moniker", "embedding", F.current_timestamp().alias("indexed_at"), F.lit(repo).alias("repo_name"))

    # Files to write anew: those that changed, and those of Go methods with another type than before.
    relinked = now.where("language = 'go' and kind = 'method'").select("id", "file_path", "enclosing_class_id").join(symbols.select("id", F.col("enclosing_class_id").alias("_was")), "id")
    relinked = relinked.where(~F.col("enclosing_class_id").eqNullSafe(F.col("_was"))).select("file_path")
    paths = _paths(spark, [*deleted, *read], "file_path").union(relinked).distinct().persist()
    old_ids = symbols.join(paths, "file_path", "left_semi").select("id")
    new_symbols = now.join(paths, "file_path", "left_semi")
    lost_ids = old_ids.join(now.select("id"), "id", "left_anti")
    edges, gone_edges = _edge_changes(now, old_ids.union(new_symbols.select("id")).distinct(), relationships, all_relationships, store.read("edges", repo), paths)
    row = spark.createDataFrame([(repo, url, new)], "name string, url string, commit_sha string").withColumn("indexed_at", F.current_timestamp())
    store.commit(
        repo,
        {
            "repositories": row,
            "files": Delta(udtf.files_of(extracted), _paths(spark, [*deleted, *read], "path")),
            "symbols": Delta(new_symbols, old_ids),
            "relationships": Delta(all_relationships.join(paths, "file_path", "left_semi"), paths),
            "edges": Delta(edges.withColumn("repo_name", F.lit(repo)), gone_edges),
            "embeddings": Delta(stamped, to_embed.union(lost_ids).select(F.col("id").alias("moniker"))),
            "failed_files": Delta(udtf.failures_of(extracted), _paths(spark, [*deleted, *to_read], "path")),
        },
        sha=old if strict_checkpoint and failed else new,
    )
    for df in (extracted, statuses, now, paths, edges):
        df.unpersist()
    if store.compact(repo):
        VectorIndex(store).refresh()
    result = UpdateResult(old, new, counts["added"], counts["updated"], counts["deleted"], counts["skipped"], False, failed)
    if usage is not None:
        result.embedding_usage = usage
    return result
