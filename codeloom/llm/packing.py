"""Hierarchical residual packing of token pieces into fixed-length sequences.

Documents are encoded and, where longer than ``capacity``, cut so that the first piece holds the remainder. The
pieces are dealt over nodes of about ``NODE_ROWS``, those of each length evenly, so every node has the lengths of the
whole. A round packs each node best-fit, largest first; bins with at most ``slack`` free places are emitted. The underfull
bins are the items of the next round: they are dealt anew by how full they are, over fewer nodes, until one node has
packed them all. Where more than ``NODE_BINS`` are left, so that one node cannot hold them, rounds go on
over as few nodes as can, for as long as a round merges one bin in a thousand; by then nodes, which all have the same
lengths, hold bins of which hardly one fits another, so one node of them all would gain as little.

Rounds move bins only, as narrow rows; a piece is joined with its last bin once, at the end. Memory is bounded by a
node, and each round's result is stored, so a lost executor repeats one node of one round. The ids are encoded once.

Defined results: a null text is empty and holds the end id alone; a null doc_id is carried as it is; repeated rows
are pieces of their own; a very long text is many pieces; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare, small_or_shuffled
from codeloom.llm.tokens import encoder

CAPACITY = 2048
NODE_ROWS, NODE_BINS = 50_000, 500_000
SLACK = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: What a round says of an item: the bin that it is in now, where there, and how full that is.
MOVED = "item long, bin long, base long, used int, emitted boolean"
#: Joined with the pieces as a broadcast side: so many bins (40 bytes each) at most.
SMALL_MOVES = 500_000


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of a document's ids (4 bytes each); the remainder comes first."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        yield piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def encode_pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text)."""
    prepare(spark)
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = encoder(tokenizer).encode(batch["text"])
            rows = [(None if d is None else int(d), *x) for d, i in zip(batch["doc_id"], ids, strict=True) for x in cut(i + end, capacity)]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; sizes in descending order. The free lengths that have an open bin are the bits
    of one integer, so the tightest fit is its lowest bit from the size on."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free_bits, by_free, n = 0, {}, 0
    for i, size in enumerate(sizes.tolist()):
        fits = free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            own = stack.pop()
            if not stack:
                free_bits &= ~(1 << free)
        else:
            own, free, n = n, capacity, n + 1
        bins[i], offsets[i] = own, capacity - free
        left = free - size
        if left:
            stack = by_free.setdefault(left, [])
            if not stack:
                free_bits |= 1 << left
            stack.append(own)
    return bins, offsets


def pack_node(items: pd.DataFrame, level: int, capacity: int, slack: int) -> pd.DataFrame:
    """One round in one node of items (item, size, node)."""
    items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    sizes = items["size"].to_numpy()
    place, base = best_fit(sizes, capacity)
    used = np.bincount(place, sizes).astype(np.int32)[place]
    own = (level << 58) | (int(items["node"].iloc[0]) << 20)
    return pd.DataFrame({"item": items["item"], "bin": own + place, "base": base, "used": used, "emitted": used >= capacity - slack})


def _round(level: int, capacity: int, slack: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda items: pack_node(items, level, capacity, slack)


def dealt(items: DataFrame, nodes: int) -> DataFrame:
    """items (item, size) with a node. The items are numbered by size and dealt in turn, so each node gets its share of every
    size. Numbers are counted within (size, chunk), as very many items may have one size; sizes are few, and a chunk has
    a sixteenth of a node's items."""
    if nodes == 1:
        return items.withColumn("node", F.lit(0).cast("long"))
    chunked = items.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(16 * nodes)))
    counts = chunked.groupBy("size", "chunk").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("size").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("size", before(Window.orderBy("size")).alias("first"))  # at most ``capacity`` rows
    counts = counts.select("size", "chunk", before(Window.partitionBy("size").orderBy("chunk")).alias("start")).join(F.broadcast(sizes), "size")
    numbered = chunked.withColumn("at", F.row_number().over(Window.partitionBy("size", "chunk").orderBy("item")))
    number = F.col("first") + F.col("start") + F.col("at") - 1
    return numbered.join(counts, ["size", "chunk"]).select("item", "size", (number % nodes).alias("node"))


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, node_rows: int = NODE_ROWS, slack: int = SLACK, node_bins: int = NODE_BINS) -> DataFrame:
    """pieces with sequence_id and offset."""
    prepare(spark)
    if not 0 < node_rows <= 1 << 20 or not 0 < node_bins <= 1 << 20:
        raise ValueError("a node holds 1 to 2**20 items")
    stored = materialise(spark, pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items, left, most, rounds = stored.select("item", F.col("length").cast("int").alias("size")), stored.count(), node_rows, []
    while left:
        nodes = -(-left // most)
        moved = dealt(items, nodes).groupBy("node").applyInPandas(_round(len(rounds), capacity, slack), MOVED)
        moved = materialise(spark, moved, f"packed-{len(rounds)}")
        rounds.append(moved)
        items = moved.where("not emitted and base = 0").select(F.col("bin").alias("item"), F.col("used").alias("size"))
        found = moved.agg(F.count_if(F.col("base") == 0).alias("bins"), F.count_if((F.col("base") == 0) & ~F.col("emitted")).alias("left")).first()
        if nodes == 1 or len(rounds) > 1 and found["bins"] >= left - left // 1000:
            break
        left, most = found["left"], node_bins
    if not rounds:
        return stored.select(*[c.split()[0] for c in PIECES.split(", ")], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # The last place of every bin that went on, from the last round back to the first.
    last = None
    for moved in reversed(rounds[1:]):
        step = moved.select(F.col("item").alias("from"), F.col("bin").alias("to"), F.col("base").alias("shift"))
        if last is not None:
            further = last.select(F.col("from").alias("to"), F.col("to").alias("_to"), F.col("shift").alias("_shift"))
            step = step.join(further, "to", "left").select("from", F.coalesce("_to", "to").alias("to"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
        last = step
    placed = stored.join(rounds[0].select("item", "bin", "base"), "item")
    if last is not None:
        last = small_or_shuffled(materialise(spark, last, "moved"), SMALL_MOVES)
        placed = placed.join(last, F.col("bin") == F.col("from"), "left").withColumn("bin", F.coalesce("to", "bin")).withColumn("base", F.col("base") + F.coalesce("shift", F.lit(0)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("base").alias("offset"))
