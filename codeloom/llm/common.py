"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship

_own_dirs: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """A-Z only; ``lower`` would also change letters beyond ASCII."""
    return F.translate(column, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a local master, where all is
    one machine; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="codeloom-shared-")
    return _own_dirs[app]


def materialise(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """A stored, narrow table as a broadcast side where it has at most so many rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(spark: SparkSession, many: DataFrame, one: DataFrame, key: str, spread: Column, rows: int, salts: int = 16, how: str = "inner") -> DataFrame:
    """``many`` joined (inner or left) with a stored, narrow table of one row per key: broadcast where it has at most so many rows, else
    under ``salts`` salts, so that a key that very many rows share is not one task's."""
    if one.limit(rows + 1).count() <= rows:
        return many.join(F.broadcast(one), key, how)
    salted = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def prepare(spark: SparkSession) -> None:
    """To be called by operators that run Python on executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
