"""A stored index of the vector table: cells, codes and vectors laid out by cell.

Centroids of the cells are learned from a bounded sample. Every vector has the cell of its nearest centroid and a code of
``LEVELS`` levels a dimension (Parquet keeps those in four bits), an eighth of the vector. A search ranks the codes of the cells
nearest to the query (as many as held ``HELD`` of the sample's true neighbours), takes the ``WIDER`` x k best, reads the
files of only the cells that these lie in, and ranks by exact cosine distance.

The index is made of segments, each of which says which layers of which parts (see ``snapshot``) it covers. What a commit adds
on top of them is searched as it is, and keys that it removes are left out, so searches see every commit at once.
``refresh`` makes a segment of all parts that have such layers, with the centroids there are; after a replaced or compacted part
its rows in older segments count no more. All of it is named by the manifest, so a reader of an older one has its index.

The driver sees the sample (``SAMPLE`` vectors) while centroids are learned, and ``WIDER`` x k names in a search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.vectors import cosine_distance, dot
from codeloom.storage.snapshot import INDEXES, layers_of

if TYPE_CHECKING:
    from codeloom.storage.snapshot import SnapshotStore

SAMPLE, ROUNDS, ASKED, NEAR = 16_384, 8, 256, 10
#: Vectors that a cell is to hold, and cells at most.
CELL_ROWS, CELLS = 4_096, 4_096
LEVELS, HELD, WIDER = 16, 0.99, 4
#: Segments above which a refresh makes the index anew.
SEGMENTS = 8
TABLE = "embeddings"
CENTROIDS = "cell int, centroid array<float>"
CODES = "moniker string, repo_name string, cell int, code array<tinyint>"
VECTORS = "moniker string, repo_name string, embedding array<float>, cell int"


def unit_of(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)


def learn(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, unit_of(sums), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, seed: int = 4) -> int:
    """How many of the nearest cells hold ``HELD`` of the true neighbours of sampled queries."""
    asked = np.random.default_rng(seed).permutation(len(sample))[:ASKED]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-near, axis=1)[:, : min(NEAR, max(1, len(sample) - 1))]
    own = (sample @ centroids.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, own[true], axis=1), HELD, method="higher")) + 1


class VectorIndex:
    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark

    def record(self, manifest: dict | None = None) -> dict | None:
        return (manifest or self.store.manifest()).get("indexes", {}).get(TABLE)

    def _folder(self, kind: str) -> str:
        return f"{INDEXES}/v={self.store.manifest()['version'] + 1}/{kind}-{uuid.uuid4().hex}"

    def _held(self, manifest: dict) -> dict[str, list[dict]]:
        return {part: layers_of(at) for part, at in manifest["tables"].get(TABLE, {}).items()}

    def build(self, cell_rows: int = CELL_ROWS) -> None:
        """Learn centroids and index the whole table. A table without vectors has no index."""
        held = self._held(self.store.manifest())
        rows = self.store.merged(TABLE, held).where("size(embedding) > 0")
        total = rows.count()
        if not total:
            self.store.amend(lambda m: m.setdefault("indexes", {}).pop(TABLE, None))
            return
        chosen = rows.select("embedding").orderBy(F.xxhash64("moniker"), "moniker").limit(SAMPLE).toPandas()["embedding"]
        sample = unit_of(np.array(chosen.tolist(), dtype=np.float64))
        centroids = learn(sample, min(CELLS, len(sample), max(1, total // cell_rows)))
        record = {"cells": len(centroids), "cell_rows": cell_rows, "probes": probes_for(sample, centroids), "reach": float(np.quantile(np.abs(sample), 0.9995)) or 1.0, "segments": [], "folders": {}}
        at = self._folder("centroids")
        frame = self.spark.createDataFrame([(k, c.astype(np.float32).tolist()) for k, c in enumerate(centroids)], CENTROIDS)
        frame.coalesce(1).write.parquet(f"{self.store.root}/{at}")
        record["folders"]["centroids"] = at
        self._publish(record, self._segment(rows, centroids, record["reach"], held))

    def _segment(self, rows: DataFrame, centroids: np.ndarray, reach: float, covers: dict[str, list[dict]]) -> dict:
        shared = self.spark.sparkContext.broadcast(centroids)
        step = 2 * reach / (LEVELS - 1)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    unit = unit_of(flat.astype(np.float64).reshape(batch.num_rows, -1))
                    cells = (unit @ shared.value.T).argmax(axis=1).astype(np.int32)
                    levels = np.clip(np.rint((unit + reach) / step), 0, LEVELS - 1).astype(np.int8)
                    offsets = np.arange(0, levels.size + 1, unit.shape[1], dtype=np.int32)
                    code = pa.ListArray.from_arrays(pa.array(offsets), pa.array(levels.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("moniker"), batch.column("repo_name"), batch.column("embedding"), pa.array(cells), code], names=["moniker", "repo_name", "embedding", "cell", "code"])

        made = rows.select("moniker", "repo_name", "embedding").mapInArrow(assign, f"{VECTORS}, code array<tinyint>")
        kept = self.store.staged(made)
        codes, vectors = self._folder("codes"), self._folder("vectors")
        kept.select("moniker", "repo_name", "cell", "code").repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{self.store.root}/{codes}")
        kept.select("moniker", "repo_name", "embedding", "cell").repartition("cell").write.partitionBy("cell").parquet(f"{self.store.root}/{vectors}")
        return {"covers": covers, "dropped": [], "codes": codes, "vectors": vectors}

    def _publish(self, record: dict, segment: dict) -> None:
        """Put a segment into the record; of older ones its parts are dropped."""
        for old in record["segments"]:
            old["dropped"] = sorted({*old["dropped"], *segment["covers"]})
        record["segments"] = [s for s in record["segments"] if set(s["covers"]) - set(s["dropped"])] + [segment]
        record["folders"] = {"centroids": record["folders"]["centroids"]} | {f"{kind}-{n}": s[kind] for n, s in enumerate(record["segments"]) for kind in ("codes", "vectors")}
        self.store.amend(lambda m: m.setdefault("indexes", {}).update({TABLE: record}))

    def _standing(self, manifest: dict, record: dict) -> tuple[list[tuple[dict, list[str], dict[str, list[dict]]]], dict[str, list[dict]]]:
        """Of each segment the parts in it that count no more, and the layers over those that do; and all layers that no
        segment covers."""
        held, found, covered = self._held(manifest), [], set()
        for segment in record["segments"]:
            alive = {p for p, layers in segment["covers"].items() if p not in segment["dropped"] and held.get(p, [])[: len(layers)] == layers and p in held}
            covered |= alive
            over = {p: held[p][len(segment["covers"][p]) :] for p in alive}
            found.append((segment, sorted(set(segment["covers"]) - alive), {p: layers for p, layers in over.items() if layers}))
        rest = {p: layers for p, layers in held.items() if p not in covered}
        for _, _, over in found:
            rest |= over
        return found, {p: layers for p, layers in rest.items() if layers}

    def refresh(self) -> bool:
        """Index the parts that have layers which no segment covers. Whether there was an index and anything to do."""
        manifest = self.store.manifest()
        record = self.record(manifest)
        if record is None:
            return False
        stale = set(self._standing(manifest, record)[1])
        if not stale:
            return False
        if len(record["segments"]) >= SEGMENTS:
            self.build(record["cell_rows"])
            return True
        covers = {p: layers for p, layers in self._held(manifest).items() if p in stale}
        frame = self.spark.read.schema(CENTROIDS).parquet(f"{self.store.root}/{record['folders']['centroids']}").orderBy("cell").toPandas()
        centroids = np.array(frame["centroid"].tolist(), dtype=np.float64)
        rows = self.store.merged(TABLE, covers).where("size(embedding) > 0")
        self._publish(record, self._segment(rows, centroids, record["reach"], covers))
        return True

    def shortlist(self, query: Sequence[float], k: int, repo: str | None = None, wider: int = WIDER) -> list[tuple[dict, str, int]]:
        """Segment, moniker and cell of the ``wider`` x k best codes in the cells that are probed."""
        manifest = self.store.manifest()
        record = self.record(manifest)
        asked = self.spark.range(1).select(F.array(*[F.lit(float(x)) for x in unit_of(np.array([query], dtype=np.float64))[0]]).alias("q"))
        centroids = self.spark.read.schema(CENTROIDS).parquet(f"{self.store.root}/{record['folders']['centroids']}")
        nearest = centroids.crossJoin(F.broadcast(asked)).orderBy(F.desc(dot("centroid", "q")), "cell").limit(record["probes"])
        cells = [r["cell"] for r in nearest.select("cell").collect()]
        found = None
        for n, (segment, dead, over) in enumerate(self._standing(manifest, record)[0]):
            codes = self.spark.read.schema(CODES).parquet(f"{self.store.root}/{segment['codes']}")
            if len(cells) < record["cells"]:
                codes = codes.where(F.col("cell").isin(cells))
            if repo is not None:
                codes = codes.where(F.col("repo_name") == repo)
            if dead:
                codes = codes.where(~F.col("repo_name").isin(dead))
            gone = self.store.gone(TABLE, over)
            if gone is not None:
                codes = codes.join(gone, (F.col("repo_name") == F.col("_part")) & (F.col("moniker") == F.col("_moniker")), "left_anti")
            scored = codes.crossJoin(F.broadcast(asked)).select(F.lit(n).alias("segment"), "moniker", "cell", dot("code", "q").alias("score"))
            found = scored if found is None else found.union(scored)
        best = found.orderBy(F.desc("score"), "moniker").limit(wider * k).collect()
        return [(record["segments"][r["segment"]], r["moniker"], r["cell"]) for r in best]

    def near(self, query: Sequence[float], k: int = 10, repo: str | None = None) -> tuple[DataFrame | None, DataFrame]:
        """moniker and embedding of the shortlist, read from the files of its cells; and all rows that no segment covers."""
        manifest = self.store.manifest()
        rest = self._standing(manifest, self.record(manifest))[1]
        uncovered = self.store.merged(TABLE, {p: layers for p, layers in rest.items() if repo in (None, p)})
        by_segment: dict[str, tuple[set[str], set[int]]] = {}
        for segment, moniker, cell in self.shortlist(query, k, repo):
            names, cells = by_segment.setdefault(segment["vectors"], (set(), set()))
            names.add(moniker)
            cells.add(cell)
        out = None
        for at, (names, cells) in by_segment.items():
            rows = self.spark.read.schema(VECTORS).parquet(f"{self.store.root}/{at}").where(F.col("cell").isin(sorted(cells)) & F.col("moniker").isin(sorted(names)))
            rows = rows.select("moniker", "embedding")
            out = rows if out is None else out.union(rows)
        return out, uncovered.select("moniker", "embedding")

    def search(self, query: Sequence[float], k: int = 10, repo: str | None = None) -> DataFrame:
        """moniker and dist of the k nearest vectors found."""
        listed, uncovered = self.near(query, k, repo)
        rows = uncovered if listed is None else listed.union(uncovered)
        asked = self.spark.range(1).select(F.array(*[F.lit(float(x)) for x in query]).alias("q"))
        return rows.crossJoin(F.broadcast(asked)).select("moniker", cosine_distance("embedding", "q").alias("dist")).orderBy("dist", "moniker").limit(k)
