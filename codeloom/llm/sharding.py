"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Every shard ``i`` of weight ``w`` scores a key with ``-ln(u) / w``, ``u`` in (0, 1) drawn from an MD5 of key and
shard; the lowest score owns the key. A further shard adds one more score and changes no other, so it can only
take rows into itself. Only the key and narrow measures of a row are shuffled, never its text.

Slots are gapless per shard without a window over a whole shard: a second hash deals each shard into ``fine``
buckets, the buckets' counts (shards x fine rows, a bound that the data does not move) become offsets, and places
are taken inside a bucket. Equal rows are one row with a count, or one for each ``COPIES`` of them, until they have their
slots. The second hash is of all that is carried and of the number of that part, so neither rows without a key nor one
repeated row fill a bucket, and no array of copies is longer than that.

Defined results: a null key is a key of its own; equal keys share a shard and get different slots; a null text
has size 1 and the checksum 0 of no bytes; a very long text is read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

FINE = 512
#: Equal rows that are carried as one.
COPIES = 10_000


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of salt and key."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (0-based) that owns the key; ties, which need equal hashes, go to the lowest shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) == 1:
        return F.lit(0)
    scores = F.array(*[-F.log(_unit(key, f"{salt}:{i}:")) / float(w) for i, w in enumerate(weights)])
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], carry: Sequence[Column] = (), grown: Sequence[float] | None = None, fine: int = FINE) -> DataFrame:
    """key, the carried columns, shard, slot and, with ``grown`` weights, the shard under those."""
    own = F.col(key)
    extra = [rendezvous(own, grown).alias("grown_shard")] if grown else []
    rows = df.select(own.alias(key), *carry)
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("_all"))
    last = F.floor((F.col("_all") - 1) / COPIES)
    equal = equal.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    equal = equal.withColumn("_n", F.least(F.lit(COPIES), F.col("_all") - F.col("_part") * COPIES)).drop("_all")
    fine_of = F.pmod(F.xxhash64(*rows.columns, "_part"), F.lit(fine)).cast("int")
    placed = materialise(df.sparkSession, equal.select("*", rendezvous(F.col(key), weights).alias("shard"), *extra, fine_of.alias("_fine")), "sharding-rows")
    counts = placed.groupBy("shard", "_fine").agg(F.sum("_n").alias("_all"))
    running = Window.partitionBy("shard").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_fine", F.coalesce(F.sum("_all").over(running), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_fine").orderBy(*rows.columns, "_part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), ["shard", "_fine"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return joined.withColumn("_copy", copies).withColumn("slot", F.col("_start") + F.col("_before") + F.col("_copy")).drop("_fine", "_part", "_n", "_before", "_start", "_copy")
