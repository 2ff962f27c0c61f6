"""MinHash near-duplicate classes with exact confirmation.

1. One pass over the texts gives each document the size and a 128-bit digest of its shingle set, ``BANDS`` band
   keys of ``ROWS`` universal-hash minima each, and one byte of every minimum as its signature. Documents of equal
   digests are one node from here on, however many they are.
2. Nodes that share a band key are candidates. The signatures of a bucket are compared in memory, and only a spanning
   forest of the pairs that may be similar is written.
3. The components of those links hold every true link (a pair of similarity s is missed with probability
   (1 - s^4)^32, under 5e-8 at 0.8, plus under 1e-6 for its signature). The full shingle sets of their members
   are built again from the texts and compared, and again a spanning forest of the confirmed links is written. Its
   components are the classes. Shingles are compared as 64-bit hashes.

Groups (buckets of step 2, components of step 3) that fit a block, ``BLOCK`` nodes or ``SET_BLOCK`` sets of at most
``SET_SHINGLES`` shingles, are one task's. A larger group is dealt over tasks, each of which compares its members with the
group's ``HUBS`` hubs; the members that the largest class of hubs attaches are linked with each other through it. The
rest, and only the rest, is held in blocks against all members, which are dealt over at most ``FAN`` tasks for each block and
read as streams. So every pair is compared but those already in one class. A member is written once for the hubs and
once for every block of the rest, which are at most ``FAN`` up to FAN * SET_SHINGLES shingles (or FAN * BLOCK nodes), and
beyond that one for so many; one of the rest is written at most ``FAN`` times more. Comparisons in a family of which no hub attaches a part may still be the square of that part.

Only nodes with a candidate have their texts read twice. Rows of one band key, root or digest that are many are found by
counts that are combined before the shuffle; they are never ranked or joined in one task.

Words and shingles: A-Z lower-cased, split at white space (space and \\x09-\\x0D); ``width`` consecutive words, or the
whole sequence where there are fewer words. Defined results: texts that are null or without words have
no shingles, are their own component and are linked with nothing; documents without an id join classes but give them no id;
rows that repeat a doc_id each get their result; very long texts are read whole, one at a time; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare, salted_join, small_or_shuffled
from codeloom.llm.components import components

BANDS, ROWS = 32, 4
#: Nodes of one block of signatures; sets and shingles of one block of full sets.
BLOCK = 32_768
SET_BLOCK, SET_SHINGLES = 2_048, 1_000_000
#: Hubs of a group that is larger than a block, and the blocks that its rest is spread over while they are not full.
HUBS, FAN = 64, 8
#: Cells in which band keys are counted to find the few that are hot.
CELLS = 1 << 14
#: A node with more than this share of all documents, and with at least so many, is joined under several salts.
HOT_SHARE, HOT_LEAST, SALTS = 10_000, 1_000, 16
#: Signature agreement below which a pair can't be similar: five standard deviations under the threshold.
MARGIN = 5.0
STORE = 200_000
#: Up to so many ids (16 MB) are broadcast to the scan of the texts; more are joined by a shuffle.
SMALL_IDS = 1_000_000
_C = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _Words(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= STORE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = h[:n].copy()
    for k in range(1, width):
        s = (s ^ (s >> np.uint64(32))) * _C[k % 4] + h[k : k + n]
    s = (s ^ (s >> np.uint64(29))) * _C[0]
    return np.unique(s ^ (s >> np.uint64(32)))


def hash_functions(count: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` universal hashes modulo 2**32."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, count, dtype=np.uint64) | 1).astype(np.uint32), rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(low, (x[at : at + 256, None] * a + b).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    parts = low.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64) * _C[3]
    for k in range(rows):
        key = (key ^ (key >> np.uint64(31))) * _C[k % 3] + parts[:, k]
    key = (key ^ (key >> np.uint64(29))) * _C[3]
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def sketches(spark: SparkSession, docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n, node (digest of the set), keys, signature; the last three null for empty sets."""
    prepare(spark)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = hash_functions(bands * rows)
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                s = shingles(text, width)
                if len(s):
                    low = minima(s, a, b)
                    out.append((doc_id, key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(low, rows), low.astype(np.uint8).tobytes()))
                else:
                    out.append((doc_id, key, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "n", "node", "keys", "signature"])

    source = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_key"), "text")
    made = source.mapInPandas(sketch, "doc_id string, text_key long, n long, node binary, keys array<long>, signature binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def runs(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal keys in turn, from batches that are sorted by them; a run that spans batches comes
    in several pieces."""
    for batch in batches:
        if len(batch):
            new = np.zeros(len(batch) - 1, bool)
            for key in keys:
                own = batch[key].to_numpy()
                new |= own[1:] != own[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1), len(batch)]
            yield from (batch.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


class Held(Protocol):
    """Nodes in memory: ``own(i)`` is what one of them is compared by, ``linked`` tells for each whether it is linked with
    such a one, ``only`` keeps some places."""

    def own(self, i: int) -> np.ndarray: ...

    def linked(self, own: np.ndarray) -> np.ndarray: ...

    def only(self, places: np.ndarray) -> Held: ...


class Signatures:
    def __init__(self, rows: np.ndarray, agree: int):
        self.rows, self.agree = rows, agree

    def own(self, i: int) -> np.ndarray:
        return self.rows[i]

    def linked(self, own: np.ndarray) -> np.ndarray:
        return (self.rows == own).sum(axis=1, dtype=np.int32) >= self.agree

    def only(self, places: np.ndarray) -> Signatures:
        return Signatures(self.rows[places], self.agree)


class Sets:
    """Shingle sets, joined, as places in the sorted list of all their shingles."""

    def __init__(self, values: np.ndarray, places: np.ndarray, sizes: np.ndarray, percent: int):
        self.values, self.places, self.sizes, self.percent = values, places, sizes, percent
        self.starts = np.cumsum(sizes) - sizes
        self.mark = np.zeros(len(values), np.uint8)

    @classmethod
    def of(cls, sets: list[np.ndarray], percent: int) -> Sets:
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(values, places, np.array([len(x) for x in sets]), percent)

    def own(self, i: int) -> np.ndarray:
        return self.values[self.places[self.starts[i] : self.starts[i] + self.sizes[i]]]

    def linked(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, own)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == own]
        self.mark[at] = 1
        both = np.add.reduceat(self.mark[self.places], self.starts, dtype=np.int64)
        self.mark[at] = 0
        return 100 * both >= self.percent * (self.sizes + len(own) - both)

    def only(self, places: np.ndarray) -> Sets:
        sizes = self.sizes[places]
        taken = np.repeat(self.starts[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Sets(self.values, self.places[taken], sizes, self.percent)


def forest(held: Held, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of n nodes. Nodes that were reached are not compared again; they are dropped from
    memory whenever they are half of what is looked at."""
    ids, open_, looked, out, todo = np.arange(n), np.ones(n, bool), held, [], []
    while open_.any():
        if not todo:
            first = int(np.argmax(open_))
            open_[first] = False
            todo.append(int(ids[first]))
        i = todo.pop()
        if open_.any():
            new = np.flatnonzero(looked.linked(held.own(i)) & open_)
            open_[new] = False
            out += [(i, int(j)) for j in ids[new]]
            todo += ids[new].tolist()
            if 2 * open_.sum() < len(ids) and open_.any():
                looked, ids = looked.only(np.flatnonzero(open_)), ids[open_]
                open_ = np.ones(len(ids), bool)
    return out


class _Classes:
    """Classes of n nodes that are merged by links."""

    def __init__(self, n: int, links: list[tuple[int, int]]):
        self.of = np.arange(n)
        for i, j in links:
            self.merge(i, j)

    def merge(self, i: int, j: int) -> None:
        if self.of[i] != self.of[j]:
            self.of[self.of == self.of[j]] = self.of[i]

    def one_of_each(self, places: np.ndarray) -> np.ndarray:
        """The first of the places in every class that they are in."""
        return places[np.unique(self.of[places], return_index=True)[1]]


Make = Callable[[list[bytes]], Held]
Links = list[tuple]


class _Whole:
    """All nodes of a group that fits a block: its spanning forest."""

    def __init__(self, names: list[bytes], held: Held, row: pd.Series):
        self.names, self.held = names, held

    def first(self) -> Links:
        return [(self.names[i], self.names[j]) for i, j in forest(self.held, len(self.names))]


class _Hubs:
    """The hubs of a larger group. Each member is linked with one hub of every class of hubs that it is linked with, and
    is attached if the largest class is among them."""

    def __init__(self, names: list[bytes], held: Held, row: pd.Series):
        self.names, self.held, self.group, self.part = names, held, int(row["group"]), int(row["part"])
        self.links = forest(held, len(names))
        self.classes = _Classes(len(names), self.links)
        counts = np.bincount(self.classes.of, minlength=len(names))
        self.main = self.classes.of == int(counts.argmax())

    def first(self) -> Links:
        return [(self.group, self.names[i], self.names[j], True) for i, j in self.links] if self.part == 0 else []

    def more(self, names: list[bytes], own: list[np.ndarray]) -> Links:
        out: Links = []
        for name, one in zip(names, own, strict=True):
            met = np.flatnonzero(self.held.linked(one))
            attached = bool(self.main[met].any())
            out += [(self.group, name, self.names[i], attached) for i in self.classes.one_of_each(met)] or [(self.group, name, None, False)]
        return out


class _Rest:
    """A block of what no hub of the largest class attaches, against a part of the group's members; the first part links the
    block's own."""

    def __init__(self, names: list[bytes], held: Held, row: pd.Series):
        self.names, self.held = names, held
        self.links = forest(held, len(names)) if int(row["part"]) == 0 else []
        self.classes = _Classes(len(names), self.links)

    def first(self) -> Links:
        return [(self.names[i], self.names[j]) for i, j in self.links]

    def more(self, names: list[bytes], own: list[np.ndarray]) -> Links:
        out: Links = []
        for name, one in zip(names, own, strict=True):
            met = self.classes.one_of_each(np.flatnonzero(self.held.linked(one)))
            out += [(name, self.names[i]) for i in met]
            for i in met[1:]:
                self.classes.merge(int(met[0]), int(i))
        return out


def _streamed(df: DataFrame, make: Make, work: type, schema: str) -> DataFrame:
    """For every cell, the rows of kind 0 in memory as ``work``, and those of kind 1 after them as a stream."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, payloads, row, at_work, out = None, [], [], None, None, []

        def begin() -> tuple[object, Links]:
            made = work(names, make(payloads), row)
            return made, made.first()

        for rows in runs(batches, "cell", "kind"):
            if rows["cell"].iloc[0] != now:
                if names and at_work is None:
                    out += begin()[1]
                now, names, payloads, row, at_work = rows["cell"].iloc[0], [], [], rows.iloc[0], None
            if rows["kind"].iloc[0] == 0:
                names += rows["node"].tolist()
                payloads += rows["payload"].tolist()
            else:
                if at_work is None:
                    at_work, links = begin()
                    out += links
                others = make(rows["payload"].tolist())
                out += at_work.more(rows["node"].tolist(), [others.own(i) for i in range(len(rows))])
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if names and at_work is None:
            out += begin()[1]
        yield pd.DataFrame(out, columns=columns)

    return df.repartition("cell").sortWithinPartitions("cell", "kind").mapInPandas(run, schema)


def _links(spark: SparkSession, rows: DataFrame, any_large: bool, block: int, most: int, make: Make, label: str) -> DataFrame:
    """u, v: spanning forests of the linked pairs inside each group. rows: group (long), node, payload, weight, and the
    number of ``parts`` of groups that are larger than a block (null: not larger)."""
    columns = ["cell", "kind", "node", "payload"]
    if not any_large:
        return _streamed(rows.select(F.col("group").alias("cell"), F.lit(0).alias("kind"), "node", "payload"), make, _Whole, "u binary, v binary")
    rows = materialise(spark, rows, f"{label}-rows")
    found = _links(spark, rows.where("parts is null"), False, block, most, make, label)
    large = rows.where("parts is not null")
    ranked = large.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("node"), "node"))).where(F.col("_r") <= HUBS)
    hubs = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0))
    members = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).withColumn("kind", F.lit(1))
    dealt = hubs.select("group", "part", *columns[1:]).union(members.select("group", "part", *columns[1:]))
    met = _streamed(dealt.withColumn("cell", F.xxhash64("group", "part")), make, _Hubs, "group long, u binary, v binary, attached boolean")
    met = materialise(spark, met, f"{label}-hubs")
    attached = met.groupBy("group", F.col("u").alias("node")).agg(F.max("attached").alias("attached"))
    rest = attached.where("not attached").join(large, ["group", "node"]).select("group", *columns[2:], "weight", "parts")
    rest = materialise(spark, rest, f"{label}-rest")
    needed = F.greatest(F.ceil(F.sum("weight") / most), F.least(F.lit(FAN), F.ceil(F.count("*") / block))).cast("int")
    blocks = small_or_shuffled(materialise(spark, rest.groupBy("group").agg(needed.alias("blocks"), F.first("parts").alias("parts")), f"{label}-blocks"), SMALL_IDS)
    blocks = blocks.select("group", "blocks", F.least("parts", F.lit(FAN)).alias("streams"))
    left = rest.drop("parts").join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")).withColumn("kind", F.lit(0))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)))
    right = large.drop("parts").join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    right = right.withColumn("part", F.pmod(F.xxhash64("node", F.lit(13)), F.col("streams")).cast("int"))
    dealt = left.select("group", "block", "part", *columns[1:]).union(right.select("group", "block", "part", *columns[1:]))
    others = _streamed(dealt.withColumn("cell", F.xxhash64("group", "block", "part")), make, _Rest, "u binary, v binary")
    return found.union(met.where("v is not null").select("u", "v")).union(others.where("u != v"))


def candidates(spark: SparkSession, nodes: DataFrame, similarity: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """u, v: spanning forests, per bucket, of the node pairs whose signatures allow the similarity."""
    total = bands * rows
    least = similarity + (1 - similarity) / 256
    agree = int(np.floor(total * least - MARGIN * np.sqrt(total * least * (1 - least))))
    make = lambda payloads: Signatures(np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), total), agree)

    buckets = nodes.select("node", F.explode("keys").alias("group"))
    cell = F.pmod("group", F.lit(CELLS)).alias("cell")
    crowded = [r.cell for r in buckets.groupBy(cell).count().where(F.col("count") > BLOCK).collect()]
    parts = F.lit(None).cast("int").alias("parts")
    known = buckets.select("node", "group", parts)
    n_large = 0
    if crowded:
        some = F.broadcast(spark.createDataFrame([(c,) for c in crowded], "cell long"))
        counted = buckets.withColumn("cell", cell).join(some, "cell").groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        large = materialise(spark, counted.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "minhash-large-buckets")
        n_large = large.count()
    if n_large:
        known = buckets.join(small_or_shuffled(large, SMALL_IDS), "group", "left").select("node", "group", "parts")
    several = known.where("parts is null").withColumn("size", F.count("*").over(Window.partitionBy("group"))).where("size > 1").drop("size")
    chosen = several.union(known.where("parts is not null")) if n_large else several
    signed = chosen.join(nodes.select("node", F.col("signature").alias("payload")), "node").withColumn("weight", F.lit(1).cast("long"))
    return _links(spark, signed, n_large > 0, BLOCK, BLOCK, make, "minhash-buckets")


def confirmed(spark: SparkSession, docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: spanning forests of the pairs with 100 * intersection >= percent * union, inside each root's members."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingles(text, width).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"node": [hashlib.blake2b(s, digest_size=16).digest() for s in made], "payload": made})

    make = lambda payloads: Sets.of([np.frombuffer(p, np.uint64) for p in payloads], percent)

    members = roots.join(nodes.select("node", "rep", "n"), "node").withColumn("group", F.xxhash64("root"))
    members = materialise(spark, members.select("group", "node", "rep", F.col("n").alias("weight")), "minhash-members")
    sized = members.groupBy("group").agg(F.count("*").alias("k"), F.sum("weight").alias("w")).where((F.col("k") > SET_BLOCK) | (F.col("w") > SET_SHINGLES))
    parts = F.greatest(F.ceil(F.col("k") / SET_BLOCK), F.ceil(F.col("w") / SET_SHINGLES)).cast("int").alias("parts")
    large = materialise(spark, sized.select("group", parts), "minhash-large-roots")
    n_large = large.count()
    wanted = small_or_shuffled(materialise(spark, members.select(F.col("rep").alias("_wanted_doc_id")).distinct(), "minhash-wanted"), SMALL_IDS)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted_doc_id")), "left_semi").select("text")
    # A set may be built from several rows: an id that repeats, rows without an id, or copies under one id.
    full = texts.mapInPandas(sets, "node binary, payload binary").dropDuplicates(["node"]).join(members.drop("rep"), "node")
    full = full.join(small_or_shuffled(large, SMALL_IDS), "group", "left") if n_large else full.withColumn("parts", F.lit(None).cast("int"))
    return _links(spark, full.select("group", "node", "payload", "weight", "parts"), n_large > 0, SET_BLOCK, SET_SHINGLES, make, "minhash-sets")


def _classes(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, node and component_id of every row; the last two null for empty sets."""
    made = materialise(spark, sketches(spark, docs, width), "minhash-sketches")
    known = made.where("n > 0")
    nodes = known.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.count("*").alias("copies")
    )
    nodes = materialise(spark, nodes, "minhash-nodes")
    roots = components(spark, candidates(spark, nodes, percent / 100), "minhash-candidates")
    links = components(spark, confirmed(spark, docs, nodes, roots, width, percent), "minhash-links")
    ids = links.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    named = salted_join(spark, links, materialise(spark, ids, "minhash-ids"), "root", F.xxhash64("node"), SMALL_IDS)
    labels = nodes.select("node", "rep", "copies").join(named.select("node", "least", F.lit(True).alias("linked")), "node", "left")
    labels = labels.select("node", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"), "copies")
    # A digest that many documents share is joined under several salts.
    hot = F.greatest(F.lit(HOT_LEAST).cast("long"), F.floor(F.lit(made.count()) / HOT_SHARE))
    many = F.broadcast(nodes.where(F.col("copies") > hot).select("node", F.lit(True).alias("many")))
    salt = F.when(F.col("many"), F.pmod(F.xxhash64("doc_id", "text_key", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("copies") > hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = made.select("doc_id", "text_key", "n", "node").join(many, "node", "left").withColumn("salt", salt).drop("many")
    right = labels.withColumn("salt", F.explode(salts)).drop("copies")
    return left.join(right, ["node", "salt"], "left").select("doc_id", "text_key", "n", "node", "component_id")


def classes(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id of its class) and kept."""
    out = _classes(spark, docs, width, percent)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of every class, with all their columns. The one with the least doc_id stays, of rows that
    share that id one of those with the text that is in the class; an id that two different texts have is judged for
    each of them. Documents without words are no copies and stay. Rows without an id are copies like others, but such a
    row stays only in a class without any id: one of each text in it."""
    found = materialise(spark, _classes(spark, docs, width, percent), "minhash-classes")
    rows, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        lost = found.where("n > 0 and doc_id != component_id").select(F.col("doc_id").alias("_lost_doc_id"))
        lost = small_or_shuffled(materialise(spark, lost, "minhash-lost"), SMALL_IDS)
        return docs.join(lost, docs["doc_id"] == F.col("_lost_doc_id"), "left_anti")
    # Ids are no key: rows are told apart by id and text, and of rows that repeat both one stays.
    known = found.where("n > 0").groupBy("doc_id", "text_key", "component_id").agg(F.count("*").alias("k"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = F.min(F.when(kept, F.col("text_key"))).over(Window.partitionBy("component_id", "doc_id"))
    some = known.where("doc_id is not null").withColumn("_first", first).union(known.where("doc_id is null").withColumn("_first", F.lit(None).cast("long")))
    decided = some.select(F.col("doc_id").alias("_seen_doc_id"), F.col("text_key").alias("_seen_text_key"), (kept & (F.col("doc_id").isNull() | (F.col("text_key") == F.col("_first")))).alias("_stays"), (F.col("k") > 1).alias("_repeats"))
    decided = small_or_shuffled(materialise(spark, decided.where("not _stays or _repeats"), "minhash-decided"), SMALL_IDS // 2)
    key = F.col("doc_id").eqNullSafe(F.col("_seen_doc_id")) & (F.xxhash64("text") == F.col("_seen_text_key"))
    joined = docs.join(decided, key, "left")
    once = joined.where("_stays and _repeats").dropDuplicates(["_seen_doc_id", "_seen_text_key"])
    return joined.where("_stays is null").select(*docs.columns).union(once.select(*docs.columns))
