import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import queries, suffix_dedup
from tests.llm.helpers import edge_documents, write

SCHEMA = "doc_id long, text string, spans string, kept long"


def brute(rows, width):
    """doc_id, bytes, spans and remaining bytes of every row, by comparing every window with every other."""
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - width + 1):
            if i is not None:
                first[t[p : p + width]] = min(i, first.get(t[p : p + width], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if i is not None and first[t[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        edges = [p for p in range(len(t) + 1) if (0 < p and gone[p - 1]) != (p < len(t) and gone[p])]
        out.append((str(i), len(t), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in df.collect())


def made(seed, n=60, letters="abc é"):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(letters, k=rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters + "xyz", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 8)))
        rows.append((rng.choice([None, i, i, i, i // 2]), text))
    return rows + [(3, rows[5][1]), (90, "a" * 400), (91, "b" + "a" * 399), (92, ""), (93, None)]


@pytest.mark.parametrize("width", [1, 2, 7, 12, 50])
def test_same_as_brute_force_with_small_blocks_and_parts(spark, monkeypatch, width):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 64)
    monkeypatch.setattr(suffix_dedup, "PART_ANCHORS", 200)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "PASSAGE", 9)
    rows = made(width)
    assert result(suffix_dedup.dedup(spark, spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), width)) == brute(rows, width)


def test_hot_anchors_and_joined_answers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1_000)
    rows = made(77, 120)
    assert result(suffix_dedup.dedup(spark, spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 12)) == brute(rows, 12)


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_two_stage_sorting_orders_all_suffixes(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 40, 700):
        text = rng.integers(0, letters, n).astype(np.uint8)
        order = suffix_dedup.suffix_order(text, np.ones(n, bool), suffix_dedup.words(text), 50)
        raw = text.tobytes()
        assert [raw[p : p + 50] for p in order] == sorted(raw[p : p + 50] for p in range(n)) and sorted(order) == list(range(n))
        shared = suffix_dedup.common_prefixes(order, suffix_dedup.words(text), 50)
        for k in range(1, n):
            a, b = raw[order[k - 1] :][:50], raw[order[k] :][:50]
            wanted = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert shared[k] == wanted or len(a) < 50 and shared[k] >= wanted  # zeros follow the end
        some = rng.random(n) < 0.3
        part = suffix_dedup.suffix_order(text, some, suffix_dedup.words(text), 50)
        assert sorted(part) == np.flatnonzero(some).tolist()
        assert [raw[p : p + 50] for p in part] == sorted(raw[p : p + 50] for p in part)


def test_query_on_edge_documents_and_empty_tables(spark, tmp_path):
    df = edge_documents(spark)
    write(df, tmp_path, "documents")
    got = queries.op11_suffix_array_dedup(spark, str(tmp_path)).collect()
    wanted = brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(
        (i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in wanted
    )
    assert suffix_dedup.dedup(spark, df.where("false")).count() == 0
