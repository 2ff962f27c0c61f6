"""Ranking, top-k and dense numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.vectors import cosine_distance


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; ranks are cut inside tasks before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def tail(df: DataFrame, key: Sequence[str], seq: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key; ``seq`` in descending order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*seq))).where(F.col("_r") <= n).drop("_r")


#: Keys sampled to choose the bounds of ranges.
SAMPLE = 4_096


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def range_of(df: DataFrame, order: str, ranges: int) -> Column:
    """Number of the range that a key falls in, in ascending order. The bounds come from a sample of keys by hash, so they are the
    same however often the plan is run; a balanced tree of comparisons finds the range."""
    kind = df.schema[order].dataType
    keys = df.select(order).orderBy(F.xxhash64(order)).limit(SAMPLE).orderBy(order).collect()
    bounds = sorted({len(keys) * k // ranges for k in range(1, ranges)} - {0}) if keys else []
    values = [keys[k][0] for k in bounds]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        below = F.col(order).isNull() | (F.col(order) < _literal(values[mid], kind))
        return F.when(F.coalesce(below, F.lit(False)), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(values))


def dense_ids(df: DataFrame, order: str, name: str = "embedding_id", partitions: int | None = None) -> DataFrame:
    """0, 1, ... in ascending order of a column, without gathering the rows in one task: rows are ranked inside ranges of keys
    and shifted by the ranges' counts (one row each, a bound that the data does not move)."""
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_range", range_of(df, order, ranges))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranked.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_range", "_rank", "_start")


def top_k(vectors: DataFrame, query: DataFrame, k: int = 10, id_column: str = "moniker", vector: str = "embedding", query_vector: str = "q") -> DataFrame:
    """The k nearest rows by cosine distance to the single query row, ties by id; planned as TakeOrderedAndProject, so
    every task sends k rows. query has one row, so the product is no join of two tables."""
    near = vectors.crossJoin(F.broadcast(query.limit(1))).select(F.col(id_column), cosine_distance(vector, query_vector).alias("dist"))
    return near.orderBy("dist", id_column).limit(k)


def _sign_code(vector: Column, planes: Sequence[Sequence[float]]) -> Column:
    bits = [F.when(F.aggregate(F.zip_with(vector, F.expr(f"array({', '.join(f'{float(x)!r}D' for x in p)})"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def top_k_lsh(vectors: DataFrame, query: DataFrame, planes: Sequence[Sequence[Sequence[float]]], k: int = 10, id_column: str = "moniker", vector: str = "embedding", query_vector: str = "q") -> DataFrame:
    """Approximate top k: only rows that share the query's sign code in one of the tables of planes are ranked."""
    q = query.limit(1)
    codes = [_sign_code(F.col(vector), p) for p in planes]
    asked = [_sign_code(F.col(query_vector), p) for p in planes]
    same = codes[0] == asked[0]
    for a, b in zip(codes[1:], asked[1:], strict=True):
        same = same | (a == b)
    near = vectors.crossJoin(F.broadcast(q)).where(same).select(F.col(id_column), cosine_distance(vector, query_vector).alias("dist"))
    return near.orderBy("dist", id_column).limit(k)
