"""Hard negatives by product quantisation with stored residual norms.

Vectors become whole numbers, so every score is exact. Codebooks of ``CENTROIDS`` whole-numbered centroids for each pair of
dimensions are learned on a bounded sample; every row is stored as its codes with the norm of what the codes leave
over. For an anchor, a table of its products with all centroids gives a row's approximate score by look-ups, and by Cauchy
and Schwarz the exact score is within |anchor| x |rest| of it. These two-sided bounds filter rigorously: a row is scored
exactly only if it can lie in the window and its upper bound reaches the lower bound of enough rows that surely
do. So results are exact, whatever the codebooks are; poor ones cost time only.

Rows are dealt over blocks of about ``BLOCK``; a task holds one block and reads the anchors as a stream, a stated query set
against all rows: each anchor is sent once to each block, and of each block only its best few per anchor (and positive)
come back. Two passes: positives first, then, with their scores, the windows of negatives.

What reaches the driver: the sample (``SAMPLE`` vectors) and row counts. The codebooks are sent to the tasks.

Defined results: rows with a null id, label or vector, a null or non-finite component, another length than the most frequent
one, or a component beyond +-sqrt(2**62 / 100 / dimensions) / 256 (10**5 at 64 dimensions; scores would not fit a long) take no part;
rows equal in id, label and whole-numbered vector are one row, other rows of one id are rows of their own, also to each
other; anchors without positives or negatives have no rows; an empty table gives none; texts play no part, long vectors cost their
length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare

SAMPLE, CENTROIDS, WIDTH, ROUNDS = 4_096, 256, 2, 6
BLOCK, TOGETHER = 1 << 14, 1 << 20
LOWEST = np.iinfo(np.int64).min // 4
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


class Quantiser:
    """Codebooks (pair of dimensions x centroid x dimension) of whole numbers."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        parts = self._parts(sample)
        self.books = np.stack([self._learn(parts[:, m], rng) for m in range(parts.shape[1])])

    @staticmethod
    def _parts(vectors: np.ndarray) -> np.ndarray:
        padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % WIDTH)))
        return padded.reshape(len(vectors), -1, WIDTH)

    @staticmethod
    def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
        apart = (book.astype(float) ** 2).sum(axis=1) - 2 * points.astype(float) @ book.T.astype(float)
        return apart.argmin(axis=1)

    def _learn(self, points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        book = points[rng.integers(0, len(points), CENTROIDS)].astype(float)
        for _ in range(ROUNDS):
            own = self._nearest(points, book)
            n = np.bincount(own, minlength=CENTROIDS)
            sums = np.stack([np.bincount(own, points[:, d], CENTROIDS) for d in range(WIDTH)], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        return np.rint(book).astype(np.int64)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x pairs) and the norms, rounded up, of what they leave over."""
        parts = self._parts(vectors)
        codes = np.stack([self._nearest(parts[:, m], book) for m, book in enumerate(self.books)], axis=1)
        rest = parts - np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), raised_norms(rest.reshape(len(vectors), -1))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the exact scores, anchors x rows."""
        tables = np.einsum("amw,mcw->mac", self._parts(anchors), self.books)
        score = np.zeros((len(anchors), len(codes)), np.int64)
        for m, table in enumerate(tables):
            score += table[:, codes[:, m]]
        slack = np.ceil(raised_norms(anchors)[:, None] * norms[None, :]).astype(np.int64) + 1
        return score - slack, score + slack


def raised_norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _sure(lower: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the k-th largest lower bound of the rows that surely count, or the least number where there are fewer."""
    if lower.shape[1] < k:
        return np.full((len(lower), 1), LOWEST)
    held = np.where(sure, lower, LOWEST)
    return -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of every group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


class Block:
    """The rows of one block: what both passes ask of it."""

    def __init__(self, quantiser: Quantiser, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray):
        self.quantiser, self.rows, self.ids, self.labels, self.vectors, self.codes, self.norms = quantiser, rows, ids, labels, vectors, codes, norms

    def _exact(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        step = max(1, TOGETHER // max(1, anchors.shape[1]))
        return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", anchors[a[i : i + step]], self.vectors[r[i : i + step]]) for i in range(0, len(a), step)]])

    def positives(self, own: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor places, row places and scores of the block's k best other rows of each anchor's label."""
        lower, upper = self.quantiser.bounds(anchors, self.codes, self.norms)
        same = (labels[:, None] == self.labels) & (own[:, None] != self.rows)
        a, r = np.nonzero(same & (upper >= _sure(lower, same, k)))
        score = self._exact(anchors, a, r)
        best = _first(a, score, self.ids[r], k)
        return a[best], r[best], score[best]

    def negatives(self, labels: np.ndarray, anchors: np.ndarray, wanted: np.ndarray, held: np.ndarray, k: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each positive's place: anchor places, row places and scores of the block's k best rows in its window.
        ``wanted`` are the positives' scores (anchors x positives), ``held`` says which there are."""
        lower, upper = self.quantiser.bounds(anchors, self.codes, self.norms)
        other = labels[:, None] != self.labels
        for p in range(wanted.shape[1]):
            floor, ceiling = low * wanted[:, p : p + 1], high * wanted[:, p : p + 1]
            there = other & held[:, p : p + 1]
            sure = there & (100 * lower >= floor) & (100 * upper <= ceiling)
            a, r = np.nonzero(there & (100 * upper >= floor) & (100 * lower <= ceiling) & (upper >= _sure(lower, sure, k)))
            score = self._exact(anchors, a, r)
            inside = (100 * score >= floor[a, 0]) & (100 * score <= ceiling[a, 0])
            a, r, score = a[inside], r[inside], score[inside]
            best = _first(a, score, self.ids[r], k)
            yield p, a[best], r[best], score[best]


def index(spark: SparkSession, rows: DataFrame, dims: int, quantiser: Quantiser) -> DataFrame:
    """rows (id, label, vector) with a number, their codes and the norm of the rest, as a stored table."""
    shared = spark.sparkContext.broadcast(quantiser)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = shared.value.encode(_matrix(batch.column("vector"), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=[*batch.schema.names, "codes", "norm"])

    coded = rows.mapInArrow(code, "id long, label long, asked boolean, vector array<int>, codes binary, norm double")
    return materialise(spark, coded.withColumn("row", F.monotonically_increasing_id()), "negatives-index")


def _blocks(index_table: DataFrame, asked: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """``run(block, anchors batch)`` for every block and every batch of the anchors."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("norm", "double"))]
    spread = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    held = index_table.select(spread.alias("block"), F.lit(0).alias("kind"), "row", "id", "label", "vector", "codes", "norm", F.lit(None).cast("array<long>").alias("scores"))
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", F.lit(1).alias("kind"), "row", "id", "label", "vector", *nothing, "scores")
    dealt = held.union(everywhere).repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, schema)


def _streamed(batches: Iterator[pa.RecordBatch], quantiser: Quantiser) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Each batch of anchors with the block that it meets; rows of a block come before its anchors."""
    now, gathered, block = None, [], None
    for batch in batches:
        frame = batch.select(["block", "kind"]).to_pandas()
        runs = (frame != frame.shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(runs, [*runs[1:], len(frame)], strict=True):
            part = batch.slice(a, b - a)
            if frame["block"].iat[a] != now:
                now, gathered, block = frame["block"].iat[a], [], None
            if frame["kind"].iat[a] == 0:
                gathered.append(part)
                continue
            if block is None and gathered:
                rows = pa.Table.from_batches(gathered).combine_chunks()
                column = lambda c, rows=rows: rows.column(c).to_numpy()
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                vectors = np.concatenate([_matrix(x.column("vector"), x.num_rows) for x in gathered])
                block, gathered = Block(quantiser, column("row"), column("id"), column("label"), vectors, codes, column("norm")), []
            if block is not None:
                # As many anchors at once as keep the scores of a block under TOGETHER.
                step = max(1, TOGETHER // len(block.rows))
                for at in range(0, part.num_rows, step):
                    yield block, part.slice(at, step)


def mine(spark: SparkSession, vectors: DataFrame, id_column: str, vector_column: str, label: Column, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_rows: int = BLOCK) -> DataFrame:
    """The first ``k`` rows of another label with low x positive_score <= 100 x score <= high x positive_score for every row for
    which ``anchors`` holds and each of its first ``positives`` other rows of its own label."""
    prepare(spark)
    vec = F.transform(vector_column, lambda x: x.cast("double"))
    sound = F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & sound)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), anchors.alias("asked"), vec.alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    most = int(np.sqrt(2.0**62 / 100 / sizes.n))
    rows = rows.where((F.size("vector") == sizes.n) & F.forall("vector", lambda x: F.abs(x * scale) <= most))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("int"))).dropDuplicates(["id", "label", "vector"])
    rows = materialise(spark, rows, "negatives-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], OUT)
    sample = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["vector"]
    quantiser = Quantiser(np.array(sample.tolist(), dtype=np.int64))
    shared, stored, blocks = spark.sparkContext.broadcast(quantiser), index(spark, rows, sizes.n, quantiser), max(1, -(-total // block_rows))
    asked = stored.where("asked").select("row", "id", "label", "vector")

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _streamed(batches, shared.value):
            own, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
            a, r, score = block.positives(own, labels, _matrix(part.column("vector"), part.num_rows), positives)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"row": own[a], "positive_id": block.ids[r], "score": score}), preserve_index=False)

    near = _blocks(stored, asked.withColumn("scores", F.lit(None).cast("array<long>")), blocks, closest, "row long, positive_id long, score long")
    order = [F.desc("score"), "positive_id"]
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("at") <= positives)
    near = materialise(spark, near, "negatives-positives")
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "score"))), lambda s: s["score"]).alias("scores"))
    armed = materialise(spark, asked.join(scores, "row"), "negatives-anchors")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _streamed(batches, shared.value):
            own, labels, given = part.column("row").to_numpy(), part.column("label").to_numpy(), part.column("scores").to_pylist()
            held = np.array([[p < len(s) for p in range(positives)] for s in given])
            wanted = np.array([[s[p] if p < len(s) else 0 for p in range(positives)] for s in given], np.int64)
            for p, a, r, score in block.negatives(labels, _matrix(part.column("vector"), part.num_rows), wanted, held, k, low, high):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"row": own[a], "at": np.full(len(a), p + 1, np.int32), "negative_id": block.ids[r], "negative_score": score}), preserve_index=False)

    found = _blocks(stored, armed, blocks, windows, "row long, at int, negative_id long, negative_score long")
    best = Window.partitionBy("row", "at").orderBy(F.desc("negative_score"), "negative_id")
    found = materialise(spark, found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "negatives-found")
    joined = found.join(near.withColumnRenamed("score", "positive_score"), ["row", "at"]).join(armed.select("row", F.col("id").alias("anchor_id")), "row")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
