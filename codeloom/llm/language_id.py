"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the 4-grams of words (letters only, lower-cased, one boundary mark at either end) per language on a
bounded sample of labelled documents, and keeps each language's ``GRAMS`` most frequent. All filters share one
table of masks, one bit per language in as many 64-bit words as the sample's languages need: adding an n-gram sets its
language's bit in ``HASHES`` slots, and the AND of those slots is the set of all languages that hold the n-gram. A document's score for a language is the share of
its n-grams with that bit, less the share that the filter's own fill explains:

    (hits / n - fp) / (1 - fp),   fp = fill ** HASHES

The largest score decides; ties go to the language with more training documents, then the smaller name.

The table (8 MB for every 64 languages) and the sample (``SAMPLE`` documents, chosen by a hash of the id) are the only things that
reach the driver or every executor. Defined results: a null text or one without letters is ``und`` with score 0; letters without
any known n-gram give the most frequent language with score 0; a language is known if the sample holds it; a null doc_id is not held out and not learned from;
with nothing to learn from every document is ``und``; a very long text is read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import prepare

UND = "und"
SAMPLE = 20_000
GRAMS = 20_000
#: Score under which ``keep`` rejects a document.
LEAST = 0.2
SLOTS = 1 << 20
HASHES = 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, bool]:
    """64-bit codes of the text's n-grams, and whether it has a letter at all."""
    if not text:
        return np.zeros(0, np.uint64), False
    points = np.frombuffer(f" {text.lower()} \0 ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points * letters()[points]
    inside = (points[1:-2] != 0) & (points[2:-1] != 0)
    at = np.flatnonzero(inside)
    wide = points.astype(np.uint64)
    code = wide[at]
    for k in (1, 2, 3):
        code = (code ^ (code >> np.uint64(29))) * _MIX[0] + wide[at + k]
    return code, bool(points.any())


def slots(codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in range(HASHES):
        h = (codes ^ (codes >> np.uint64(32))) * _MIX[1 + k]
        out.append((h >> np.uint64(44)).astype(np.int64))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x words, or slots where there is one word
    false_positive: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        first, *rest = slots(codes)
        mask = self.table[first]
        for more in rest:
            mask = mask & self.table[more]
        n = len(self.languages)
        if n <= 12:
            counts = np.bincount(mask.astype(np.int64), minlength=1 << n)
            bits = np.arange(1 << n)[:, None] >> np.arange(n) & 1
            hits = counts @ bits
        else:
            hits = np.unpackbits(mask.view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")[:, :n].sum(axis=0, dtype=np.int64)
        return np.clip((hits / len(codes) - self.false_positive) / (1 - self.false_positive), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, any_letter = grams(text)
        if not any_letter or not self.languages:
            return UND, 0.0
        if not len(codes):
            return self.languages[0], 0.0
        scores = self.scores(codes)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, grams_each: int = GRAMS) -> Model:
    """A model of documents (doc_id, text, lang) that are not held out and have a language."""
    prepare(spark)
    usable = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                made = [grams(t)[0] for t in own["text"]]
                codes, n = np.unique(np.concatenate(made), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": n, "docs": np.where(np.arange(len(n)) == 0, len(own), 0)})

    counted = rows.mapInPandas(count, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).withColumn("docs", F.sum("docs").over(Window.partitionBy("lang")))
    top = counted.where(F.col("rank") <= grams_each).select("lang", "docs", "gram").toPandas()
    order = top[["lang", "docs"]].drop_duplicates().sort_values(["docs", "lang"], ascending=[False, True])
    languages = order["lang"].tolist()
    table, fill = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages))
    own = {lang: grams.to_numpy(np.int64).view(np.uint64) for lang, grams in top.groupby("lang")["gram"]}
    for k, lang in enumerate(languages):
        word, bit = table[:, k // 64], np.uint64(1 << k % 64)
        for at in slots(own[lang]):
            word[at] |= bit
        fill[k] = np.count_nonzero(word & bit) / SLOTS
    table = table[:, 0] if table.shape[1] == 1 else table
    return Model(languages, table, fill**HASHES)


def _labelled(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score"])

    label.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("_labelled", F.pandas_udf(label, "lang_pred string, score double")("text"))


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score."""
    return _labelled(spark, docs.select("doc_id", "text"), model).select("doc_id", "_labelled.lang_pred", "_labelled.score")


def keep(spark: SparkSession, docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents with a language of score ``least`` or more, with all their columns."""
    found = _labelled(spark, docs, model)
    return found.where((F.col("_labelled.lang_pred") != UND) & (F.col("_labelled.score") >= least)).select(*docs.columns)
