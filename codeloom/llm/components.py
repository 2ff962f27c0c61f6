"""Connected components by alternating large-star and small-star, on DataFrames of links.

Each half step is one grouped minimum, which is combined before its shuffle, and one join on narrow rows. Nodes are counted
in ``CELLS`` cells by a hash, together with the checksum that ends the rounds; nodes of a cell with many more links than
the average, as where one node has a third of all links, are joined under ``SALTS`` salts. Neither half step gives a node
more links than it had, so one count serves both. Every round is stored in the shared folder, and the rounds end
when count and checksum of the links stay the same. What reaches the driver is one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

MAX_ROUNDS = 60
CELLS, SALTS = 4_096, 16
#: A cell is crowded beyond so many links, and beyond so many times the average.
CROWDED, TIMES = 500, 8


def _cell(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(CELLS))


def _survey(links: DataFrame) -> tuple[tuple[int, int], list[int]]:
    """Count and checksum of the links, and the crowded cells."""
    ends = F.array(F.struct(_cell(F.col("u")).alias("cell"), F.xxhash64("u", "v").alias("sum")), F.struct(_cell(F.col("v")).alias("cell"), F.lit(0).cast("long").alias("sum")))
    found = links.select(F.inline(ends)).groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    total = sum(r.n for r in found)
    most = max(CROWDED, TIMES * total // CELLS)
    return (total, int(sum(r["sum"] for r in found))), [r.cell for r in found if r.n > most]


def _with_least(links: DataFrame, least: DataFrame, crowded: list[int]) -> DataFrame:
    """links with the row that ``least`` has for their u."""
    if not crowded:
        return links.join(least, "u")
    many = _cell(F.col("u")).isin(crowded)
    left = links.withColumn("_salt", F.when(many, F.pmod(F.xxhash64("v", F.lit(3)), F.lit(SALTS)).cast("int")).otherwise(0))
    right = least.withColumn("_salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["u", "_salt"]).drop("_salt")


def large_star(edges: DataFrame, crowded: list[int] | None = None) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least, crowded or []).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, crowded: list[int] | None = None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    leaves = _with_least(down, least, crowded or []).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, edges: DataFrame, label: str = "links") -> DataFrame:
    """node, root for every node of edges (u, v of one comparable type); root is the component's least node."""
    links = materialise(spark, edges.where("u != v").select("u", "v").distinct(), f"{label}-0")
    seen, crowded = _survey(links)
    for k in range(1, MAX_ROUNDS):
        links = materialise(spark, small_star(large_star(links, crowded), crowded), f"{label}-{k}")
        now, crowded = _survey(links)
        if now == seen:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(nodes.select("root", "root").distinct())
        seen = now
    raise RuntimeError("components did not settle")
