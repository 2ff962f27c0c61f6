"""Joins and DML of the property graph, as pure DataFrame functions over symbols, relationships and edges.

Lists of ids and paths are DataFrames and meet the tables in semi and anti joins, never in ``isin`` lists; Spark
broadcasts a side by its measured size. Nothing here collects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.identity import bare_target
from codeloom.schemas import EMBEDDABLE_KINDS

DOCSTRING_CHARS = 500
CALLS_SHOWN = 20
METHODS_SHOWN = 30


def embeddable(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*EMBEDDABLE_KINDS))


def resolved(relationships: DataFrame) -> DataFrame:
    return relationships.where(F.col("is_resolved") & F.col("target_id").isNotNull())


def link_methods(methods: DataFrame, types: DataFrame) -> DataFrame:
    """methods with ``enclosing_class_id``: where it is null, the last type (by ``ord``) whose qualified name is the
    method's without its last part. Names of fewer than three parts stay unlinked."""
    owner = F.when(F.size(F.split("qualified_name", r"\.")) >= 3, F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    last = types.groupBy(F.col("qualified_name").alias("_owner")).agg(F.max_by("id", "ord").alias("_type"))
    wanted = methods.withColumn("_owner", F.when(F.col("enclosing_class_id").isNull(), owner))
    joined = wanted.join(last, "_owner", "left")
    return joined.withColumn("enclosing_class_id", F.coalesce("enclosing_class_id", "_type")).drop("_owner", "_type")


def class_methods(classes: DataFrame, methods: DataFrame, rendered: Column | str, shown: int = METHODS_SHOWN) -> DataFrame:
    """id, methods (first ``shown`` in emission order) and how many more each class has. Ranks are cut inside tasks
    before the shuffle, so a class of any size costs ``shown`` rows."""
    text = F.col(rendered) if isinstance(rendered, str) else rendered
    own = methods.where("enclosing_class_id is not null").select(F.col("enclosing_class_id").alias("id"), "ord", text.alias("_text"))
    counts = own.groupBy("id").agg(F.count("*").alias("n"))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("ord", "_text"))).where(F.col("_r") <= shown)
    lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_text"))), lambda x: x["_text"]).alias("methods"))
    joined = classes.select("id").join(counts, "id", "left").join(lists, "id", "left")
    return joined.select("id", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), F.greatest(F.coalesce("n", F.lit(0)) - shown, F.lit(0)).cast("long").alias("more"))


def call_targets(relationships: DataFrame) -> DataFrame:
    """source_id and one distinct call target per row."""
    target = F.coalesce("target_name", F.when(F.col("target_id") != "", bare_target("target_id")))
    return relationships.where(F.col("kind") == "calls").select("source_id", target.alias("target")).where("target is not null and target != ''").distinct()


def call_lists(relationships: DataFrame, shown: int = CALLS_SHOWN) -> DataFrame:
    """source_id, its first ``shown`` call targets in order, and how many more it has."""
    targets = call_targets(relationships)
    counts = targets.groupBy("source_id").agg(F.count("*").alias("n"))
    first = targets.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("target"))).where(F.col("_r") <= shown)
    lists = first.groupBy("source_id").agg(F.array_sort(F.collect_list("target")).alias("calls"))
    return lists.join(counts, "source_id").select("source_id", "calls", F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def write_edges(nodes: DataFrame, relationships: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """src, label, dst: the resolved relationships whose two ends exist, once each, with the edges there are already."""
    wanted = resolved(relationships).select(F.col("source_id").alias("src"), F.upper("kind").alias("label"), F.col("target_id").alias("dst")).distinct()
    known = wanted.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "label", "dst")
    return known if edges is None else edges.select("src", "label", "dst").union(known).distinct()


def skipped_relationships(relationships: DataFrame) -> DataFrame:
    return relationships.agg(F.count_if(~F.col("is_resolved") | F.col("target_id").isNull()).alias("skipped"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_values: bool = True) -> DataFrame:
    """new over old by key. A null in new leaves the old value where ``keep_old_values``, else replaces it."""
    old, new = old.alias("o"), new.alias("n")
    columns = old.columns
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    if keep_old_values:
        return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])
    is_new = F.col(f"n.{key}").isNotNull()
    return joined.select(*[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def without(table: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    return table.join(ids.select(F.col(id_column).alias("_id")), F.col(column) == F.col("_id"), "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the ids, and edges without any that touch them."""
    return without(nodes, ids, "id"), without(without(edges, ids, "src"), ids, "dst")


def replace_repository(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_relationships: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The repository's nodes replaced by the new ones, and all edges with surviving ends plus the new ones."""
    mine = nodes.where(F.col("repo_name") == repo).select("id")
    kept_nodes, kept_edges = detach_delete(nodes, edges, mine)
    now = kept_nodes.unionByName(new_nodes)
    return now, write_edges(now, new_relationships, kept_edges)


def one_hop(nodes: DataFrame, edges: DataFrame, label: str, source: Column) -> DataFrame:
    """src, dst of the edges with a label whose source node fits the predicate."""
    starts = nodes.where(source).select(F.col("id").alias("src"))
    ends = nodes.select(F.col("id").alias("dst"))
    return edges.where(F.col("label") == label).join(starts, "src").join(ends, "dst").select("src", "dst")


def affected(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    return relationships.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("id",), value: str = "body_hash") -> DataFrame:
    """key and status: added, deleted, updated or unchanged. Repeated keys in new count once, the last by ``ord`` if there is one."""
    key = list(key)
    order = [F.desc("ord")] if "ord" in new.columns else [F.desc(value)]
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1")
    o = old.select(*key, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    n = last.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(*key, status.alias("status"))


def diff_counts(statuses: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(count("added").alias("added"), count("updated").alias("updated"), count("deleted").alias("deleted"), count("unchanged").alias("skipped"))


def change_ratio(changed_paths: DataFrame, indexable_files: DataFrame, threshold: float = 0.5, least_files: int = 2) -> DataFrame:
    """changed, indexable, ratio and whether so much has changed that indexing anew is due."""
    changed = changed_paths.agg(F.count("*").alias("changed"))
    files = indexable_files.agg(F.count("*").alias("indexable"))
    both = changed.crossJoin(files)  # one row each
    ratio = F.when(F.col("indexable") > 0, F.col("changed") / F.col("indexable")).otherwise(0.0)
    return both.select("changed", "indexable", ratio.alias("ratio"), ((F.col("indexable") >= least_files) & (ratio > threshold)).alias("full_index"))


def node_properties(symbols: DataFrame) -> DataFrame:
    """Flat node properties: short docstring, joined bases, no empty signature, no lists or byte offsets."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return symbols.select(
        "id", "kind", "name", "qualified_name", "file_path", F.col("location.line_start").alias("line_start"), F.col("location.line_end").alias("line_end"), "body_hash",
        "language", "visibility", "is_exported", text("signature").alias("signature"), "return_type", F.substring("docstring", 1, DOCSTRING_CHARS).alias("docstring"), "is_async", "complexity",
        F.nullif(F.array_join("base_classes", ", "), F.lit("")).alias("base_classes"), "is_abstract", "enclosing_class_id", "is_static", "is_constructor", "receiver_kind",
        "type_annotation", "is_constant", "repo_name",
    )


def property_map(df: DataFrame, columns: Sequence[str]) -> Column:
    """Non-null properties as a map of strings."""
    entries = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
