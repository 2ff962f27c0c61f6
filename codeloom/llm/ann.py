"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Codes: rotations are learned by iterative quantisation on a bounded sample; the signs of a rotated vector are its
``BITS`` bits, split into substrings of 16, each of which is indexed: an entry has one row for every substring, under
the cell of its table (the substring's number) and the substring's first bits. Search: a query is sent to the cells
whose first bits are within ``reach`` bits of its own, and there probes every bucket whose whole value is. By the
pigeonhole principle that retrieves every code that differs in fewer than substrings x (reach + 1) bits, and many that
differ in more; whole codes are compared, those within ``radius`` are candidates, and candidates are ranked by exact
inner products in double precision. A pair is handed on by the first table in which it meets, so only once. ``reach``
and ``radius`` are fitted on the sample, each to hold the share ``HELD`` of its true neighbours; a query that finds
fewer than ``LEAST`` candidates is asked again with more of both, up to all.

Inner products are ranked, so vectors of unequal length get one more dimension that makes lengths equal. Entries are
put into bands of like length (within a factor of ``BAND``), counted from the longest of all rows; each band has a
length, a reach and a radius of its own, so a few long vectors do not blur the codes of the rest. A band of at most
``WHOLE`` entries, about which a sample tells little, is compared whole.

Rows: N x substrings narrow index rows, and for every query at most the cells of every table, whose number grows with N
(their first bits are chosen so that a cell holds about ``CELL`` entries). A cell of more entries, as where many
vectors are alike, is split by a hash of the entry; a task holds one cell's entries and reads its queries as a stream.
Vectors are joined to candidates only, the queries' by a broadcast where they are few. Equal vectors are one entry of
the index with its smallest ids: no other of its ids can be among a query's nearest ``k``.

What reaches the driver: the sample (``SAMPLE`` vectors and ``BAND_SAMPLE`` of each band), the model and the sizes of the
cells (at most 32 bands x substrings x 256). Texts play no part; long vectors cost their length in the sample and in
ranking. Defined results: vectors that are null, empty, zero, of another length than the most frequent one, or that hold
null or non-finite components take no part, nor do null ids; rows that repeat an id with one vector are one row, with
other vectors are queries and candidates of their own; with fewer candidates than k all are returned; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare, salted_join, small_or_shuffled

SAMPLE, BAND_SAMPLE = 16_384, 256
#: Bits of a code (a multiple of 64) and of a substring.
BITS, SUBSTRING = 384, 16
#: Share of the sample's true neighbours that reach and radius must hold, each by itself.
HELD = 0.985
LEAST = 64
#: Ratio of lengths inside a band, and the number of bands; the last one holds all that is shorter.
BAND, BANDS, WHOLE = 1.25, 32, 64
#: Entries that a cell is meant to hold, and at most holds.
CELL = 1 << 15
#: Bucket look-ups and pairs that are handled together.
TOGETHER = 1 << 18
#: Bytes of query vectors that are broadcast.
QUERY_BYTES = 32 << 20


@cache
def _weights(bits: int = SUBSTRING) -> np.ndarray:
    return np.bitwise_count(np.arange(1 << bits, dtype=np.uint32)).astype(np.uint8)


@cache
def _masks(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of so many bits, those of few bits first, and how many have at most 0, 1, ... bits."""
    weights = _weights(bits)
    return np.argsort(weights, kind="stable"), np.cumsum(np.bincount(weights))


@dataclass
class Model:
    longest: float
    rotations: np.ndarray  # (dimensions + 1) x bits
    #: band -> (radius, reach); ``any_band`` where the sample holds no true neighbour in a band.
    fitted: dict[int, tuple[int, int]] = field(default_factory=dict)
    any_band: tuple[int, int] = (0, 0)

    def bands(self, lengths: np.ndarray) -> np.ndarray:
        steps = np.log(self.longest / np.maximum(lengths, self.longest * 1e-300)) / np.log(BAND)
        return np.clip(np.floor(steps + 1e-6), 0, BANDS - 1).astype(np.int64)

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and bands of entries."""
        lengths = np.sqrt((vectors**2).sum(axis=1))
        bands = self.bands(lengths)
        unit = vectors / (self.longest / BAND ** bands.astype(float))[:, None]
        missing = np.maximum(0.0, 1 - (unit**2).sum(axis=1))
        lifted = np.hstack([unit, np.sqrt(np.where(missing > 1e-5, missing, 0.0))[:, None]])
        return np.packbits(lifted @ self.rotations > 0, axis=1), bands

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Codes of queries, which have nothing in the further dimension, so their products are the plain ones."""
        return np.packbits(queries @ self.rotations[:-1] > 0, axis=1)

    def limits(self, band: int, entries: int, more: int) -> tuple[int, int]:
        """Radius and reach in a band of so many entries, after a query was found short ``more`` times."""
        bits = self.rotations.shape[1]
        if entries <= WHOLE:
            return bits, SUBSTRING
        radius, reach = self.fitted.get(band, self.any_band)
        return min(bits, radius + more * bits // 8), min(SUBSTRING, reach + 2 * more)


def fit(vectors: np.ndarray, k: int, longest: float = 0.0, share: float = 1.0, bits: int = BITS, rounds: int = 12, seed: int = 5) -> Model:
    """Learn rotations, radius and reach from a sample, all on the driver. ``longest`` is the largest length of all rows
    and ``share`` the sample's share of them: of a query's ``k`` nearest rows that share is expected in it."""
    rng = np.random.default_rng(seed)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    model = Model(max(longest, float(lengths.max())), np.zeros((0, 0)))
    unit = np.hstack([vectors / lengths[:, None], np.zeros((len(vectors), 1))])
    dims, learned = unit.shape[1], []
    wide = -(-dims // 8) * 8
    for _ in range(-(-bits // wide)):
        rotation = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dims]
        some = unit[rng.permutation(len(unit))[:4096]]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(some.T @ np.sign(some @ rotation), full_matrices=False)
            rotation = u @ vt
        learned.append(rotation)
    model.rotations = np.hstack(learned)[:, :bits]
    (codes, bands), some = model.codes(vectors), rng.permutation(len(vectors))[:256]
    dots = vectors[some] @ vectors.T
    dots[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-dots, axis=1)[:, : min(max(1, round(k * share)), max(1, len(vectors) - 1))]
    split = np.bitwise_count(model.asked(vectors[some]).view(np.uint16)[:, None, :] ^ codes.view(np.uint16)[near])
    apart, closest, band = split.sum(axis=2, dtype=np.int64).ravel(), split.min(axis=2).ravel(), bands[near].ravel()
    held = lambda of: int(np.quantile(of, HELD, method="higher"))
    model.any_band = held(apart), held(closest)
    model.fitted = {int(b): (held(apart[band == b]), held(closest[band == b])) for b in np.unique(band)}
    return model


class Table:
    """Buckets of one substring: the entries of one cell, which share the substring's first bits."""

    def __init__(self, codes: np.ndarray, number: int, first_bits: int):
        self.number, self.low_bits = number, SUBSTRING - first_bits
        self.parts = codes.view(np.uint16)
        self.words = np.ascontiguousarray(codes.view(np.uint64).T)
        values = self.parts[:, number].astype(np.int64)
        self.first = int(values[0] >> self.low_bits) if len(values) else 0
        low = values & ((1 << self.low_bits) - 1)
        self.order = np.argsort(low, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=1 << self.low_bits))])

    def _buckets(self, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) places of all pairs whose values differ in at most ``reach`` bits, some at a time."""
        values = queries.view(np.uint16)[:, self.number].astype(np.int64)
        left = reach - np.bitwise_count((values >> self.low_bits) ^ self.first)
        masks, upto = _masks(self.low_bits)
        for rest in np.unique(left[left >= 0]).tolist():
            own = np.flatnonzero(left == rest)
            flips = masks[: upto[min(rest, self.low_bits)]]
            for at in range(0, len(own), max(1, TOGETHER // len(flips))):
                asking = own[at : at + max(1, TOGETHER // len(flips))]
                probed = (values[asking] & ((1 << self.low_bits) - 1))[:, None] ^ flips
                begins, counts = self.starts[probed], self.starts[probed + 1] - self.starts[probed]
                met = np.cumsum(counts.sum(axis=1))
                edge = 0
                while edge < len(asking):
                    done = met[edge - 1] if edge else 0
                    stop = max(edge + 1, int(np.searchsorted(met, done + TOGETHER, side="right")))
                    n = counts[edge:stop].ravel()
                    before = np.cumsum(n) - n
                    members = self.order[np.repeat(begins[edge:stop].ravel() - before, n) + np.arange(n.sum())]
                    yield np.repeat(asking[edge:stop], counts[edge:stop].sum(axis=1)), members
                    edge = stop

    def pairs(self, queries: np.ndarray, radius: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) places of the pairs within radius that meet in this table and in none before it."""
        asked, parts = np.ascontiguousarray(queries.view(np.uint64).T), queries.view(np.uint16)
        for q, e in self._buckets(queries, reach):
            apart = np.zeros(len(q), np.uint16)
            for own, other in zip(self.words, asked, strict=True):
                apart += np.bitwise_count(own[e] ^ other[q])
            near = apart <= radius
            q, e = q[near], e[near]
            if self.number and len(q):
                new = np.bitwise_count(parts[q, : self.number] ^ self.parts[e, : self.number]).min(axis=1) > reach
                q, e = q[new], e[new]
            yield q, e


class Index:
    """All tables over one set of codes in memory: what the cells hold together."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))))
        self.tables = [Table(self.codes, k, 0) for k in range(-(-codes.shape[1] // 2))]

    def _padded(self, query: np.ndarray) -> np.ndarray:
        return np.pad(query, (0, self.codes.shape[1] - len(query)))[None, :]

    def distances(self, query: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes ^ self._padded(query)).sum(axis=1, dtype=np.int64)

    def probe(self, query: np.ndarray, radius: int, within: int | None = None) -> np.ndarray:
        """Rows that pigeonhole probes for ``radius`` meet, of any distance or only those ``within`` one."""
        reach, most = radius // len(self.tables), self.codes.shape[1] * 8 if within is None else within
        return np.unique(np.concatenate([e for t in self.tables for _, e in t.pairs(self._padded(query), most, reach)]))

    def search(self, query: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All rows within the radius, or within the next larger one that holds ``least`` rows."""
        while True:
            rows = self.probe(query, radius, radius)
            if len(rows) >= min(least, len(self.codes)):
                return rows
            radius += len(self.tables)


def _coded(spark: SparkSession, vectors: DataFrame, model: Model, asked: bool) -> DataFrame:
    """entry, band, keys (the substrings) and code of entries, or of queries (band null)."""
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                some = _matrix(batch.column("vector"), batch.num_rows)
                codes, bands = (own.asked(some), np.full(len(some), -1)) if asked else own.codes(some)
                keys = pa.array(codes.view(np.uint16).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(bands.astype(np.int32)), keys, pa.array([c.tobytes() for c in codes], pa.binary())], names=["entry", "band", "keys", "code"])

    return vectors.select("entry", "vector").mapInArrow(code, "entry long, band int, keys array<int>, code binary")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _runs(frame: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame]]:
    cells, kinds = frame["cell"].to_numpy(), frame["kind"].to_numpy()
    cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(frame)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(cells[a]), int(kinds[a]), frame.iloc[a:b]


def _unpacked(codes: list[pd.Series]) -> np.ndarray:
    rows = [bytes(c) for s in codes for c in s]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def candidates(coded: DataFrame, asked: DataFrame, model: Model, sizes: dict[int, int], more: int = 0) -> DataFrame:
    """query, entry: all pairs that the probes meet and that are within the radius, each once. ``sizes``: entries by band."""
    spark = coded.sparkSession
    total = sum(sizes.values())
    first = min(8, max(0, int(np.ceil(np.log2(max(1, total) / CELL)))))
    low = SUBSTRING - first
    limits = {band: model.limits(band, n, more) for band, n in sizes.items()}
    spread = coded.select("entry", "band", "code", F.posexplode("keys").alias("number", "value")).withColumn("first", F.shiftright("value", low))
    counted = spread.groupBy("band", "number", "first").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts")).collect()
    schema = "band int, number int, first int, parts int, radius int, reach int"
    cells = F.broadcast(spark.createDataFrame([(*c, *limits[c.band]) for c in counted], schema))
    cell = F.xxhash64("band", "number", "first", "part").alias("cell")
    columns = [cell, "kind", "number", "radius", "reach", "name", "code"]
    left = spread.join(cells, ["band", "number", "first"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    left = left.select(*columns[:1], F.lit(0).alias("kind"), "number", "radius", "reach", F.col("entry").alias("name"), "code")
    own = asked.select("entry", "code", F.posexplode("keys").alias("number", "value"))
    right = own.join(cells, "number").where(F.bit_count(F.shiftright("value", low).bitwiseXOR(F.col("first"))) <= F.col("reach"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(*columns[:1], F.lit(1).alias("kind"), "number", "radius", "reach", F.col("entry").alias("name"), "code")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, table, names, codes = None, None, [], []
        for batch in batches:
            for cell, kind, rows in _runs(batch):
                if cell != now:
                    now, table, names, codes = cell, None, [], []
                if kind == 0:
                    names.append(rows["name"].to_numpy())
                    codes.append(rows["code"])
                    continue
                number, radius, reach = (int(rows[c].iloc[0]) for c in ("number", "radius", "reach"))
                if table is None:
                    table, held = Table(_unpacked(codes), number, first), np.concatenate(names)
                    codes = []
                asking = rows["name"].to_numpy()
                for q, e in table.pairs(_unpacked([rows["code"]]), radius, reach):
                    if len(q):
                        yield pd.DataFrame({"query": asking[q], "entry": held[e]})

    dealt = left.union(right).repartition("cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInPandas(probe, "query long, entry long")


def _ranked(spark: SparkSession, pairs: DataFrame, entries: DataFrame, asking: DataFrame, dims: int, k: int) -> DataFrame:
    """query and its best (k + 1) rows of ids, as an array of (minus, id, own) in order."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dots = (_matrix(batch.column("vector"), batch.num_rows) * _matrix(batch.column("wanted"), batch.num_rows)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("entry"), batch.column("ids"), pa.array(dots)], names=["query", "entry", "ids", "score"])

    queries = small_or_shuffled(asking.select(F.col("entry").alias("query"), F.col("vector").alias("wanted")), QUERY_BYTES // (8 * dims))
    joined = pairs.join(entries.select("entry", "vector", "ids"), "entry").join(queries, "query")
    scored = joined.select("query", "entry", "ids", "vector", "wanted").mapInArrow(score, "query long, entry long, ids array<long>, score double")
    rows = scored.select("query", "score", (F.col("entry") == F.col("query")).alias("own"), F.explode("ids").alias("id"))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k + 1)
    return best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "own"))).alias("best"))


def nearest(spark: SparkSession, vectors: DataFrame, id_column: str, vector_column: str, queries: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, id_column and score: the k nearest rows found of every row for which ``queries`` holds."""
    prepare(spark)
    vec = F.col(vector_column)
    sound = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull()).where(sound).select(F.col(id_column).cast("long").alias("id"), vec.alias("vector"), queries.alias("asked"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    rows = rows.where(F.size("vector") == sizes.n).withColumn("entry", F.xxhash64("vector"))
    # The k + 1 smallest ids of every distinct vector; Spark cuts the ranks down inside each task first.
    ranked = rows.dropDuplicates(["id", "vector"]).withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    entries = ranked.where(F.col("_r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("entry").alias("entry"))
    entries = materialise(spark, entries.withColumn("length", length), "ann-entries")

    total, longest = entries.agg(F.count("*"), F.max("length")).first()
    place = [F.xxhash64("entry"), F.col("entry")]
    chosen = entries.select("vector", "length", "entry").orderBy(*place).limit(SAMPLE)
    band = F.least(F.floor(F.log(F.lit(longest) / F.col("length")) / float(np.log(BAND)) + 1e-6), F.lit(BANDS - 1))
    of_band = entries.select("vector", "length", "entry", F.row_number().over(Window.partitionBy(band).orderBy(*place)).alias("_r")).where(F.col("_r") <= BAND_SAMPLE)
    sample = chosen.union(of_band.drop("_r")).dropDuplicates(["entry"]).orderBy(*place).toPandas()["vector"]
    model = fit(np.array(sample.tolist(), dtype=np.float64), k, longest, min(1.0, SAMPLE / total))

    asked = materialise(spark, rows.where("asked").select("id", "entry").distinct(), "ann-asked")
    asking = materialise(spark, entries.join(asked.select("entry").distinct(), "entry", "left_semi"), "ann-asking")
    coded = materialise(spark, _coded(spark, entries, model, asked=False), "ann-codes")
    wanted = materialise(spark, _coded(spark, asking, model, asked=True), "ann-wanted")
    by_band = {r.band: r["count"] for r in coded.groupBy("band").count().collect()}
    pairs, more = asking.select(F.col("entry").alias("query"), "entry"), 0
    while True:
        met = materialise(spark, candidates(coded, wanted, model, by_band, more).where("query != entry"), f"ann-pairs-{more}")
        counts = met.groupBy("query").agg(F.count("*").alias("n")).withColumnRenamed("query", "entry")
        short = wanted.join(counts, "entry", "left").where(F.coalesce("n", F.lit(0)) < min(LEAST, total - 1)).drop("n")
        short = materialise(spark, short, f"ann-short-{more}")
        left = 0 if min(model.limits(b, n, more)[1] for b, n in by_band.items()) == SUBSTRING else short.count()
        pairs = pairs.union(met.join(small_or_shuffled(short.select(F.col("entry").alias("query")), QUERY_BYTES // 16), "query", "left_anti") if left else met)
        if not left:
            break
        wanted, more = short, more + 1
    best = _ranked(spark, pairs, entries, asking, sizes.n, k)
    best = materialise(spark, best, "ann-best")
    joined = salted_join(spark, asked.withColumnRenamed("entry", "query"), best, "query", F.xxhash64("id"), QUERY_BYTES // (32 * k))
    others = F.slice(F.filter("best", lambda b: ~(b["own"] & (b["id"] == F.col("id")))), 1, k)
    found = joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "row"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias(id_column), (-F.col("row.minus")).alias("score"))
