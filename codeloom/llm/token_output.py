"""Token-ID output: wavelet-matrix shards in ascending document order, and reading them back.

Documents are range-partitioned and sorted by id, so shard after shard the tokens are one ascending stream. A task
encodes its documents and closes a shard image whenever ``SHARD_TOKENS`` have gathered, so its memory does not
depend on its partition. Images are stored as rows of a Parquet table in the shared folder, which any store that
Spark reaches can hold; an image by itself is a complete file (see ``wavelet``).

The place of a document in the whole stream is its partition's start, plus the tokens of earlier shards of the
partition, which a shard's row tells, plus its place in the shard; starts are sums over one row per partition.
The number of partitions is ``spark.sql.shuffle.partitions``. Ranges are cut by id, hash of the text and the row's place in
its input, so rows without an id, or of one repeated id, are dealt over as many tasks as they need.

Defined results: a null text is empty and holds the end id alone; a very long text is one document of one shard, read whole;
a null doc_id sorts first; rows that repeat a doc_id, or have none, follow each other in order of a hash of the text; an
empty table has no shard and no rows; other columns are ignored. ``count_tokens`` and ``locate`` answer from rank and select,
without decoding; a token that does not occur has the count 0 and no places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare
from codeloom.llm.tokens import encoder
from codeloom.llm.wavelet import open_shard, pack_shard

SHARD_TOKENS = 1 << 19
LOCATED = 10_000
SHARDS = "part int, seq int, before long, docs long, tokens long, image binary"


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shard images of docs (doc_id, text), stored in the shared folder."""
    prepare(spark)
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.withColumn("_mix", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "_mix", "_row").sortWithinPartitions("doc_id", "_mix", "_row")
    end = np.array([end_id], "<u4").tobytes()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts, held, seq, part, before = [], [], [], 0, None, 0

        def close() -> pd.DataFrame:
            tokens = np.frombuffer(b"".join(held), "<u4")
            image = pack_shard(ids, counts, tokens)
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "docs": [len(ids)], "tokens": [len(tokens)], "image": [image]})

        gathered = 0
        for batch in batches:
            encoded = encoder(tokenizer).encode(batch["text"])
            for part, doc_id, own in zip(batch["part"], batch["doc_id"], encoded, strict=True):
                own += end
                ids.append(None if doc_id is None else int(doc_id))
                counts.append(len(own) // 4)
                held.append(own)
                gathered += counts[-1]
                if gathered >= shard_tokens:
                    yield close()
                    ids, counts, held, seq, before, gathered = [], [], [], seq + 1, before + gathered, 0
        if ids:
            yield close()

    return materialise(spark, ordered.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string"), "text").mapInPandas(build, SHARDS), "token-shards")


def read_documents(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the images."""
    prepare(spark)
    starts, at = {}, 0
    for r in shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect():
        starts[r.part] = at
        at += r.tokens

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, before, image in zip(batch["part"], batch["before"], batch["image"], strict=True):
                doc_ids, ends, matrix = open_shard(image)
                tokens = matrix.decode().astype("<u4")
                begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crcs = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": begins + starts[part] + before, "n_tokens": ends - begins, "ids_crc32": crcs})

    return shards.select("part", "before", "image").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(spark: SparkSession, shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """token and n, its occurrences in all shards, for a bounded list of different tokens."""
    prepare(spark)
    wanted = list(dict.fromkeys(int(t) for t in tokens))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch["image"]:
                matrix = open_shard(image)[2]
                yield pd.DataFrame({"token": wanted, "n": [matrix.count(t) for t in wanted]})

    found = shards.select("image").mapInPandas(count, "token long, n long")
    asked = spark.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return found.union(asked).groupBy("token").agg(F.sum("n").alias("n"))


def locate(spark: SparkSession, shards: DataFrame, token: int) -> DataFrame:
    """doc_id and place in the document's ids of every occurrence of a token."""
    prepare(spark)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch["image"]:
                doc_ids, ends, matrix = open_shard(image)
                begins, n = np.concatenate([np.zeros(1, np.int64), ends[:-1]]), matrix.count(token)
                for first in range(0, n, LOCATED):
                    places = np.array([matrix.select(token, k) for k in range(first, min(n, first + LOCATED))])
                    docs = np.searchsorted(ends, places, "right")
                    yield pd.DataFrame({"doc_id": pd.array([doc_ids[d] for d in docs], "Int64"), "place": places - begins[docs]})

    return shards.select("image").mapInPandas(find, "doc_id long, place long")
