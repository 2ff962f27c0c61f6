"""Filter interaction audit: what each filter removes, under every order of the filters.

A scan of the documents reduces each to a mask of the filters that it fails; the masks are counted by part (``cells``: at
most 2**filters rows a part). All orders of the filters follow from the cells alone. They are visited by adjacent
transpositions: each order comes from the one before by one swap of neighbours, which leaves the set of filters before and
after the two untouched, so only these two steps are computed anew, from the cells. The Shapley sums add up along the
walk. A batch of parts takes the walk together.

Whether a text repeats one of a smaller doc_id is decided by SHA-256 of the text, on narrow rows: digests that more than one
doc_id has are joined back under salts, so a text that a third of all rows share is no task's. Labels meet rows that
are counted by doc_id, part and mask before, so a repeated or missing id is no hot key either.

Rows: a narrow row per document, stored once; then counts. Nothing reaches the driver but row counts.

Defined results: a null text is empty, a null source is the part ''; a document with a null doc_id fails E never, makes no other
fail it and has no labels; rows that repeat a doc_id count each, and do not fail E by each other (their id is not
smaller); of several labels rows of an id, one with quality = 1 (toxic = 1) is enough; texts are read whole, a long one costs its
length; no documents give no parts, no labels give zeros; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare, salted_join, small_or_shuffled

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
FEW_WORDS, SIGNS = 200, "[#$%&*|]"
#: Rows of repeated digests, and of labels, that are broadcast (under 100 bytes each).
SMALL_DIGESTS, SMALL_LABELS = 200_000, 500_000
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: Column, words: Column) -> Column:
    """Mask of the filters A to D, which see one document alone."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < FEW_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike(SIGNS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = read.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACES), "").alias("words"))
    narrow = split.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    narrow = materialise(spark, narrow, "audit-masks")
    repeated = narrow.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = materialise(spark, repeated.select("digest", "first"), "audit-repeated")
    met = salted_join(spark, narrow, repeated, "digest", F.xxhash64("doc_id"), SMALL_DIGESTS, how="left")
    mask = F.col("own") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    counted = met.groupBy("doc_id", "part", mask.alias("mask")).agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]).where("good = 1 or toxic = 1")
    judged = counted.join(small_or_shuffled(materialise(spark, known, "audit-labels"), SMALL_LABELS), "doc_id", "left")
    lost = [F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return judged.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)


def swaps(n: int) -> Iterator[int]:
    """Places i of the swaps of i and i + 1 that lead once through all orders of n things: one thing walks from end to end,
    and each time it has arrived, the others take one step of their own walk."""
    if n < 2:
        return
    inner, outwards = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if outwards else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # At the left end the walker stands before the others, at the right end behind them.
        yield step + 1 if outwards else step
        outwards = not outwards


class Walk:
    """The state of one order for many parts: ``counts`` is measures (n, good, toxic) x parts x masks."""

    def __init__(self, counts: np.ndarray, filters: str):
        self.counts, self.filters, self.order = counts, filters, list(range(len(filters)))
        self.masks = np.arange(counts.shape[2])
        shape = (len(filters), counts.shape[1])
        self.kept, self.removed, self.redundant, self.good, self.toxic = (np.zeros(shape, np.int64) for _ in range(5))
        self.shapley, self.unique = np.zeros(shape, np.int64), np.stack([counts[0][:, 1 << f] for f in self.order])
        for step in self.order:
            self._compute(step)
        self._add()

    def _compute(self, step: int) -> None:
        """One step from the cells: its filter, after the set of filters before it."""
        bit, before = 1 << self.order[step], sum(1 << f for f in self.order[:step])
        fails, gone = self.masks & bit > 0, self.masks & before > 0
        self.removed[step], self.good[step], self.toxic[step] = self.counts[:, :, fails & ~gone].sum(axis=2)
        self.redundant[step] = self.counts[0][:, fails & gone].sum(axis=1)
        self.kept[step] = self.counts[0][:, ~fails & ~gone].sum(axis=1)

    def _add(self) -> None:
        for step, f in enumerate(self.order):
            self.shapley[f] += self.removed[step]

    def swap(self, at: int) -> None:
        self.order[at : at + 2] = self.order[at + 1], self.order[at]
        self._compute(at)
        self._compute(at + 1)
        self._add()

    def rows(self) -> tuple[str, np.ndarray]:
        """The order, and steps x parts x (kept, removed, redundant, unique_fails, good_lost, toxic_lost)."""
        return "".join(self.filters[f] for f in self.order), np.stack([self.kept, self.removed, self.redundant, self.unique[self.order], self.good, self.toxic], axis=2)


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from ``cells``."""
    prepare(counted.sparkSession)
    size, names = 1 << len(filters), [x.split()[0] for x in OUT.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            counts = np.zeros((3, len(batch), size), np.int64)
            for k, found in enumerate(batch["cells"]):
                for c in found:
                    counts[:, k, c["mask"]] += (c["n"], c["good"], c["toxic"])
            state = Walk(counts, filters)
            visited = [state.rows()]
            for at in swaps(len(filters)):
                state.swap(at)
                visited.append(state.rows())
            for order, numbers in visited:
                for step in range(len(filters)):
                    values = dict(zip(names[3:-1], numbers[step].T, strict=True))
                    yield pd.DataFrame({"part": batch["part"].to_numpy(), "filter_order": order, "step": np.int32(step + 1), **values, "shapley": state.shapley[filters.index(order[step])]})

    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInPandas(walk, OUT)
