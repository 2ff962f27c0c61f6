"""Vector expressions, and the embedders that plug into the pipeline."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, in double precision; a zero vector gives NaN, which sorts last."""
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(a, b) / length)


#: US dollars per million tokens.
RATES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13}
DEFAULT_RATE = 0.02
#: Where the remote provider answers unless the configuration names another place (``base_url``).
DEFAULT_URL = "https://api.openai.com/v1"


def rate(model: Column | str, override: float | None = None) -> Column:
    """Price of a model per million tokens; an override wins, unknown models have the default."""
    if override is not None:
        return F.lit(float(override))
    known = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.col(model) if isinstance(model, str) else model), F.lit(DEFAULT_RATE))


def token_cost(tokens: Column | str, per_million: Column) -> Column:
    return F.round((F.col(tokens) if isinstance(tokens, str) else tokens).cast("double") / 1e6 * per_million, 8)


class ConfigError(ValueError):
    """A configuration that can't be used."""


class Embedder(ABC):
    """Texts to float32 vectors. Instances are shipped to executors, so what is heavy is made there, once per task."""

    #: A name under which vectors are kept by the digest of their text, for embedders that are paid; None keeps none.
    identity: str | None = None

    @property
    @abstractmethod
    def dimensions(self) -> int: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """(len(texts), dimensions) float32; no texts give (0, dimensions)."""

    def usage_stats(self) -> dict | None:
        return None

    def usage_of(self, tokens: int, requests: int) -> dict | None:
        """What ``usage_stats`` says of so many tokens and requests, wherever they were made."""
        return None

    def measured(self, text: Column | str) -> Column:
        """As ``column``, with what it used: a struct of embedding, tokens and requests, the last two on the first row of a batch.
        Executors have copies of the embedder, so its own counters stay where the work is done."""
        embedder = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                before = embedder.usage_stats() or {}
                vectors = list(embedder.embed(batch.fillna("").tolist()))
                after = embedder.usage_stats() or {}
                used = [after.get(k, 0) - before.get(k, 0) for k in ("total_tokens", "requests")]
                first = np.arange(len(batch)) == 0
                yield pd.DataFrame({"embedding": vectors, "tokens": first * used[0], "requests": first * used[1]})

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "embedding array<float>, tokens long, requests long")(text)

    def column(self, text: Column | str) -> Column:
        """The vectors of a text column, a batch at a time."""
        embedder = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(embedder.embed(batch.fillna("").tolist())))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")(text)


class FixtureEmbedder(Embedder):
    """Vectors that depend on the text alone: uniform draws from a generator seeded by its hash."""

    def __init__(self, dimensions: int = 384):
        self._dimensions = dimensions

    @property
    def dimensions(self) -> int:
        return self._dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self._dimensions), np.float32)
        for row, text in enumerate(texts):
            digest = int(hashlib.sha256(text.encode("utf-8")).hexdigest(), 16)
            out[row] = np.random.default_rng(digest % 2**32).random(self._dimensions).astype(np.float32)
        return out


class Busy(OSError):
    """The provider could not answer now; ``wait`` is the seconds that it asks for, if it does."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class HttpTransport:
    """Batches of texts to an endpoint that answers as the embedding API of the usual providers does: POST of ``model`` and ``input``,
    a list of ``index`` and ``embedding`` back, in any order, and the tokens used."""

    def __init__(self, url: str, model: str, key: str, timeout: float = 60):
        self.url, self.model, self.key, self.timeout = url.rstrip("/") + "/embeddings", model, key, timeout

    def __call__(self, texts: list[str]) -> tuple[list[list[float]], int]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            said = e.read(2000).decode("utf-8", "replace")
            if e.code == 429 or e.code >= 500:
                after = e.headers.get("Retry-After", "")
                raise Busy(f"{e.code}: {said}", float(after) if after.replace(".", "", 1).isdigit() else None) from None
            raise ConfigError(f"the provider refused the request with {e.code}: {said}") from None
        rows = sorted(found["data"], key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise ValueError(f"{len(texts)} texts sent, vectors of {[r['index'] for r in rows]} received")
        return [r["embedding"] for r in rows], int(found.get("usage", {}).get("total_tokens", 0))


class RemoteEmbedder(Embedder):
    """A provider over HTTP. ``send`` (such as ``HttpTransport``) takes a batch of texts and returns their vectors in order and the
    tokens used. At most ``parallel`` batches are on their way at once; one that fails is sent again, after a pause that doubles."""

    def __init__(self, send, model: str = "text-embedding-3-small", dimensions: int = 1536, batch: int = 100, retries: int = 3, parallel: int = 1, pause: float = 0.5):
        self.send, self.model, self._dimensions, self.batch, self.retries = send, model, dimensions, batch, retries
        self.parallel, self.pause, self.identity = parallel, pause, f"{model}-{dimensions}"
        self.tokens = self.requests = 0

    @property
    def dimensions(self) -> int:
        return self._dimensions

    def _sent(self, texts: list[str]) -> tuple[list[list[float]], int]:
        for attempt in range(self.retries + 1):
            try:
                vectors, used = self.send(texts)
                break
            except OSError as e:
                if attempt == self.retries:
                    raise
                time.sleep(getattr(e, "wait", None) or self.pause * 2**attempt)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts sent, {len(vectors)} vectors received")
        return vectors, used

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self._dimensions), np.float32)
        batches = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(max(1, min(self.parallel, len(batches)))) as pool:
            at = 0
            for vectors, used in pool.map(self._sent, batches):
                out[at : at + len(vectors)] = vectors
                at, self.tokens, self.requests = at + len(vectors), self.tokens + used, self.requests + 1
        return out

    def usage_stats(self) -> dict:
        return self.usage_of(self.tokens, self.requests)

    def usage_of(self, tokens: int, requests: int) -> dict:
        per_million = float(os.environ.get("EMBEDDING_USD_PER_1M_TOKENS") or RATES.get(self.model, DEFAULT_RATE))
        return {"model": self.model, "total_tokens": tokens, "requests": requests, "estimated_cost_usd": round(tokens / 1e6 * per_million, 8)}


class LocalEmbedder(Embedder):
    """A sentence-transformers model, where that package is installed."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", dimensions: int = 384, batch: int = 32):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ConfigError("the local provider needs the sentence-transformers package") from e
        self._model, self.batch = SentenceTransformer(model), batch
        if self._model.get_sentence_embedding_dimension() != dimensions:
            raise ConfigError(f"{model} has {self._model.get_sentence_embedding_dimension()} dimensions, not {dimensions}")
        self._dimensions = dimensions

    @property
    def dimensions(self) -> int:
        return self._dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self._dimensions), np.float32)
        return np.asarray(self._model.encode(texts, batch_size=self.batch), np.float32)


def from_config(path: str | Path | None, send=None) -> Embedder:
    """The embedder a YAML file names under ``embedder``; without a file the fixture."""
    if path is None or not Path(path).exists():
        return FixtureEmbedder()
    import yaml

    settings = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("embedder") or {}
    provider = settings.get("provider", "fixture")
    own = settings
    if provider == "fixture":
        return FixtureEmbedder(int(own.get("dimensions", 384)))
    if provider == "openai":
        key, model = os.environ.get(own.get("api_key_env", "OPENAI_API_KEY")), own.get("model", "text-embedding-3-small")
        if not key:
            raise ConfigError("the remote provider needs an API key in the environment")
        if send is None:
            send = HttpTransport(own.get("base_url") or DEFAULT_URL, model, key, float(own.get("timeout", 60)))
        return RemoteEmbedder(send, model, int(own.get("dimensions", 1536)), int(own.get("batch_size", 100)), int(own.get("retries", 3)), int(own.get("parallel", 4)), float(own.get("pause", 0.5)))
    if provider == "local":
        return LocalEmbedder(own.get("model", "all-MiniLM-L6-v2"), int(own.get("dimensions", 384)), int(own.get("batch_size", 32)))
    raise ConfigError(f"unknown embedder provider {provider!r}")
