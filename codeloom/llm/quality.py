"""Quality and toxicity from weak labels: EM over overlapping labellers, posteriors train a hashed linear scorer.

Labellers vote bad, good or nothing on a document; two tasks (junk and toxic) have their own. For each task an
expectation-maximisation over the votes of a bounded sample estimates the prior and every labeller's table of
P(vote | class), and so its accuracy, without trusting any of them. Junk has one labeller for every measure of a text and one
for prose. Toxic has a lexicon of insults, a labeller of texts that heap them, and a vocabulary: tokens that documents with a
bad label hold far more often than others, learned on one half of the sample and voting on the other, so that it never
sees the label that it is compared with. The table of human labels, which covers some documents, is one more labeller,
asked only in training. The posteriors are the soft targets of a linear scorer over hashed tokens: the words of the text,
their first four, five and seven bytes, and the bucket that each measure of the text falls into. Tokens whose share among
bad and good documents differs beyond ``Z`` standard errors, the ``TOKENS`` most telling ones, get weights by Newton's
method with a quadratic penalty. Only text decides a document's score.

The sample is ``SAMPLE`` documents chosen by a hash of the id, labelled ones first up to ``LABELLED`` of them. What
reaches the driver is the sample's hashed tokens, what is broadcast is two vectors of ``SLOTS`` weights.

Defined results: a null text or one without words is junk (probability 1, not toxic) and not kept; a null doc_id is
scored and never sampled; several labels of a document vote by their means (ties: nothing); very long texts are read
whole; without anything to learn from, nothing but word-less texts is rejected; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import prepare

SAMPLE, LABELLED = 9_000, 7_500
SLOTS = 1 << 20
TOKENS = 512
Z = 4.5
#: Probabilities from which a document is rejected. Few of the toxic have a vote at all, so their posteriors run low.
THRESHOLDS = (0.5, 0.25)
STORE = 150_000
#: Documents counted together while learning.
CHUNK = 500
TASKS = ("junk", "toxic")
ABSTAIN, GOOD, BAD = 0, 1, 2
#: The vocabulary labeller: how much more often a token must be among bad than among other documents, and how many of them
#: make a vote.
FAR_MORE, SEVERAL = 20.0, 3

#: Insults in English that the lexicon labellers look for.
INSULTS = frozenset(b"clown disgusting dumb idiot idiots imbecile loser losers moron morons pathetic scum stupid trash worthless".split())
_SYMBOLS = b"#$%&*@^~=+<>\\{}[]_"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
#: Edges of the buckets of each measure.
EDGES = {
    "symbols": (0.01, 0.03, 0.08, 0.15, 0.3),
    "capitals": (0.1, 0.2, 0.3, 0.5, 0.7),
    "shouts": (0.01, 0.05, 0.2, 0.5),
    "bars": (0.02, 0.1, 0.25),
    "repeats": (0.02, 0.1, 0.3, 0.6),
    "distinct": (0.05, 0.15, 0.3, 0.5),
}


def measures(text: str) -> tuple[dict[str, float], set[bytes]]:
    """Shares that describe the text, and its distinct words (lower-cased, ASCII marks as spaces)."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    pieces = raw.split()
    upper = n - len(raw.translate(None, _UPPER))
    lower = n - len(raw.translate(None, _LOWER))
    m = max(1, len(pieces))
    found = {
        "symbols": (n - len(raw.translate(None, _SYMBOLS))) / n,
        "capitals": upper / max(1, upper + lower),
        "shouts": raw.count(b"!!") / m,
        "bars": raw.count(b"|") / m,
        "repeats": sum(a == b for a, b in zip(pieces, pieces[1:], strict=False)) / m,
        "distinct": len(set(pieces)) / m if m >= 50 else 1.0,
    }
    return found, set(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


#: For each measure, from where its labeller calls a text junk, and up to where it looks like prose.
BOUNDS = {"symbols": (0.08, 0.03), "capitals": (0.3, 0.15), "shouts": (0.15, 0.03), "bars": (0.1, 0.03), "repeats": (0.2, 0.05), "distinct": (0.15, 0.35)}


def votes(found: dict[str, float], words: set[bytes]) -> tuple[list[int], list[int]]:
    """The heuristic labellers' votes for junk and for toxic. A labeller that looks for one fault says nothing about
    texts without it; whether a text is free of all of them is a labeller of its own."""
    junk, prose = [], True
    for name, (bad, good) in BOUNDS.items():
        value = found[name]
        low = bad < good  # a low value is the fault
        junk.append(BAD if (value <= bad if low else value >= bad) else ABSTAIN)
        prose &= value >= good if low else value <= good
    junk.append(GOOD if prose and words else ABSTAIN)
    insults = len(INSULTS & words)
    return junk, [BAD if insults else ABSTAIN, BAD if insults > 1 and insults > 0.02 * len(words) else ABSTAIN]


def vocabulary_votes(rows: list[np.ndarray], human: np.ndarray) -> np.ndarray:
    """BAD where a document holds several of the tokens that the human BAD votes of the sample's other half point to."""
    out, half = np.zeros(len(rows), np.uint8), np.arange(len(rows)) % 2
    for own in (0, 1):
        bad, rest = (np.flatnonzero((half != own) & cond) for cond in (human == BAD, human == GOOD))
        if not len(bad) or not len(rest):
            continue
        p, q = (_share(rows, at) for at in (bad, rest))
        pooled = (p * len(bad) + q * len(rest) + 1) / (len(bad) + len(rest) + 2)
        z = (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / len(bad) + 1 / len(rest)))
        telling = (z >= Z) & (p >= FAR_MORE * q) & (p * len(bad) >= 3)
        for i in np.flatnonzero(half == own):
            out[i] = BAD if np.count_nonzero(telling[rows[i]]) >= SEVERAL else ABSTAIN
    return out


def _share(rows: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """For each slot, the share of some documents that hold it."""
    found = np.zeros(SLOTS)
    for k in range(0, len(at), CHUNK):
        found += np.bincount(np.concatenate([rows[i] for i in at[k : k + CHUNK]]), minlength=SLOTS)
    return found / len(at)


def buckets(found: dict[str, float]) -> list[bytes]:
    return [f"\x00{name}:{np.searchsorted(EDGES[name], value, side='right')}".encode() for name, value in found.items()]


def slot(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) & (SLOTS - 1)


class _Slots(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= STORE:
            self.clear()
        value = self[token] = slot(token)
        return value


_slots = _Slots()


def tokens(text: str) -> tuple[np.ndarray, dict[str, float], set[bytes]]:
    found, words = measures(text)
    every = [*words, *{b"\x01" + w[:5] for w in words}, *{b"\x02" + w[:4] for w in words}, *{b"\x03" + w[:7] for w in words}, *buckets(found)]
    return np.unique(np.fromiter(map(_slots.__getitem__, every), np.int32, len(every))), found, words


def expect(vote: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over votes (documents x labellers): posterior of bad, P(vote | class) as labellers x 2 x 3, and the prior.
    Starts from the share of bad among the votes given, so that class 1 is the one that labellers call bad."""
    n, m = vote.shape
    bad, n_votes = (vote == BAD).sum(axis=1), (vote != ABSTAIN).sum(axis=1)
    posterior = np.where(n_votes > 0, np.where(bad > 0, 0.5 + 0.49 * bad / np.maximum(1, n_votes), 0.02), 0.1)
    one_hot = (vote[:, :, None] == np.arange(3)).astype(float)
    tables, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior], axis=1)
        tables = np.einsum("nc,nmv->mcv", weight, one_hot) + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        prior = float(np.clip(posterior.mean(), 1e-4, 1 - 1e-4))
        logs = np.einsum("nmv,mcv->nc", one_hot, np.log(tables)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, tables, prior


def learn(rows: list[np.ndarray], target: np.ndarray, most: int = TOKENS, z: float = Z, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by slot and the bias, from hashed tokens and soft targets."""
    n = len(rows)
    weights = np.zeros(SLOTS, np.float32)
    total, bad = np.zeros(SLOTS), np.zeros(SLOTS)
    for at in range(0, n, CHUNK):
        some = rows[at : at + CHUNK]
        flat = np.concatenate(some)
        total += np.bincount(flat, minlength=SLOTS)
        bad += np.bincount(flat, weights=np.repeat(target[at : at + CHUNK], [len(r) for r in some]), minlength=SLOTS)
    n_bad = max(target.sum(), 1e-9)
    n_good = max(n - n_bad, 1e-9)
    p, q = bad / n_bad, (total - bad) / n_good
    pooled = (total + 1) / (n + 2)
    score = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / n_bad + 1 / n_good))
    score[(score < z) | (total < 3)] = 0
    chosen = np.argsort(-score, kind="stable")[:most]
    chosen = chosen[score[chosen] > 0]
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for i, row in enumerate(rows):
        own = place[row]
        x[i, own[own >= 0]] = 1
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        gradient = x.T @ (guess - target).astype(np.float32) + ridge * w
        hessian = (x * (guess * (1 - guess)).astype(np.float32)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    weights[chosen] = w[:-1]
    return weights, float(w[-1])


@dataclass
class Model:
    weights: np.ndarray  # tasks x slots
    bias: np.ndarray
    accuracy: dict[str, list[float]]

    def probabilities(self, text: str | None) -> tuple[float, float]:
        """Of junk and of toxic."""
        return Scorer(self).probabilities(text)


class Scorer:
    """A model's probabilities of many texts. Few tokens have weights, so words are kept by what they add: those that add
    nothing, with any of their prefixes, are dropped from a text's words at once."""

    def __init__(self, model: Model):
        self.model, self.idle, self.slots = model, set(), {}
        self.weighted = model.weights.any(axis=0)

    def _of(self, word: bytes) -> tuple[int, ...]:
        if len(self.idle) + len(self.slots) >= STORE:
            self.idle.clear()
            self.slots.clear()
        own = tuple(k for t in (word, b"\x01" + word[:5], b"\x02" + word[:4], b"\x03" + word[:7]) if self.weighted[k := slot(t)])
        if own:
            self.slots[word] = own
        else:
            self.idle.add(word)
        return own

    def probabilities(self, text: str | None) -> tuple[float, float]:
        if not text or not text.split():
            return 1.0, 0.0
        found, words = measures(text)
        held = {k for t in buckets(found) if self.weighted[k := _slots[t]]}
        for word in words - self.idle:
            held.update(self.slots.get(word) or self._of(word))
        z = self.model.weights[:, sorted(held)].sum(axis=1, dtype=np.float64) + self.model.bias
        junk, toxic = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return float(junk), float(toxic)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, labelled: int = LABELLED) -> Model:
    """A model from documents (doc_id, text) and, where given, labels (doc_id, quality, toxic)."""
    prepare(spark)
    order = F.xxhash64("doc_id")
    ids = docs.where("doc_id is not null").select("doc_id")
    if labels is None:
        known = ids.limit(0).withColumn("human_junk", F.lit(0)).withColumn("human_toxic", F.lit(0))
    else:
        vote = lambda c: F.coalesce(F.when(F.avg(c) > 0.5, BAD).when(F.avg(c) < 0.5, GOOD), F.lit(ABSTAIN)).cast("int")
        means = labels.where("doc_id is not null").groupBy("doc_id").agg(vote(1 - F.col("quality")).alias("human_junk"), vote(F.col("toxic")).alias("human_toxic"))
        known = means.orderBy(order, "doc_id").limit(labelled)
    rest = ids.distinct().orderBy(order, "doc_id").limit(sample - labelled)
    chosen = rest.join(known, "doc_id", "full").fillna(0)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, text, junk, toxic in zip(batch["place"], batch["text"], batch["human_junk"], batch["human_toxic"], strict=True):
                if text and text.split():
                    slots_, found, words = tokens(text)
                    mine = votes(found, words)
                    out.append((place, slots_.tobytes(), bytes([*mine[0], junk]), bytes([*mine[1], toxic])))
            yield pd.DataFrame(out, columns=["place", "slots", "junk", "toxic"])

    # One text of each id, so the rows are no more than the ids; in an order that no partitioning changes.
    picked = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "human_junk", "human_toxic")
    picked = picked.agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("place", order)
    rows = picked.mapInPandas(hashed, "place long, slots binary, junk binary, toxic binary").toPandas().sort_values("place", ignore_index=True)
    if not len(rows):
        return Model(np.zeros((2, SLOTS), np.float32), np.array([-9.0, -9.0]), {})
    slots_ = [np.frombuffer(s, np.int32) for s in rows.pop("slots")]
    weights, bias, accuracy = [], [], {}
    for task in TASKS:
        vote = np.frombuffer(b"".join(rows[task]), np.uint8).reshape(len(rows), -1)
        if task == "toxic":
            vote = np.insert(vote, -1, vocabulary_votes(slots_, vote[:, -1]), axis=1)
        posterior, tables, prior = expect(vote)
        right = (1 - prior) * tables[:, 0, GOOD] + prior * tables[:, 1, BAD]
        accuracy[task] = (right / np.maximum(1e-9, 1 - (1 - prior) * tables[:, 0, ABSTAIN] - prior * tables[:, 1, ABSTAIN])).tolist()
        w, b = learn(slots_, posterior)
        weights.append(w)
        bias.append(b)
    return Model(np.stack(weights), np.array(bias), accuracy)


def _judged(spark: SparkSession, docs: DataFrame, model: Model, thresholds: tuple[float, float]) -> tuple[DataFrame, F.Column]:
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame([own.probabilities(t) for t in batch], columns=["p_junk", "p_toxic"])

    judge.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = docs.withColumn("_judged", F.pandas_udf(judge, "p_junk double, p_toxic double")("text"))
    return found, (F.col("_judged.p_junk") < thresholds[0]) & (F.col("_judged.p_toxic") < thresholds[1])


def score(spark: SparkSession, docs: DataFrame, model: Model, thresholds: tuple[float, float] = THRESHOLDS) -> DataFrame:
    """doc_id, p_junk, p_toxic and kept."""
    found, kept = _judged(spark, docs.select("doc_id", "text"), model, thresholds)
    return found.select("doc_id", "_judged.p_junk", "_judged.p_toxic", kept.alias("kept"))


def keep(spark: SparkSession, docs: DataFrame, model: Model, thresholds: tuple[float, float] = THRESHOLDS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    found, kept = _judged(spark, docs, model, thresholds)
    return found.where(kept).select(*docs.columns)
