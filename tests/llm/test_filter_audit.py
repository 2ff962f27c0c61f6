import random
import re
from itertools import permutations
from math import factorial

import numpy as np
import pytest

from codeloom.llm import filter_audit as f
from codeloom.llm import queries
from tests.llm.helpers import DOCS, edge_documents, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string"


def failures(rows):
    """Sets of failed filters of rows (doc_id, text), by the contract."""
    least = {}
    for i, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        out.append({k for k, v in fails.items() if v})
    return out


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = [(part or "", i, fails) for (i, _, part), fails in zip(docs, failures([d[:2] for d in docs]), strict=True)]
    out = {}
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, name in enumerate(order):
                lost = [r for r in left if name in r[2]]
                left = [r for r in left if name not in r[2]]
                total[name] += len(lost)
                out[part, "".join(order), step + 1] = [len(left), len(lost), sum(name in r[2] for r in gone), sum(r[2] == {name} for r in own), sum(r[1] in good for r in lost), sum(r[1] in toxic for r in lost), name]
                gone = gone + lost
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = total.get(v[-1], v[-1])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("small", [True, False])
def test_same_as_brute_force(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr(f, "SMALL_DIGESTS", 0)
        monkeypatch.setattr(f, "SMALL_LABELS", 0)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["Upper", "CASE", "a#b", "é x"]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary[: rng.choice([20, 304])], k=rng.choice([3, 199, 200, 260]))) for _ in range(25)]
    docs = [(rng.choice([k, k, k, 5, None]), rng.choice([*texts, None, ""]), rng.choice(["s", "s", "s", "t", None, ""])) for k in range(150)]
    labels = [(rng.choice([k, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(150) for _ in range(2)]
    write(spark.createDataFrame([(i, t, "x", s, 1, "k", 1, "s") for i, t, s in docs], DOCS), tmp_path, "documents")
    write(spark.createDataFrame([(*x, "clash") for x in labels], LABELS), tmp_path, "labels")
    got = rows_of(queries.op13_filter_audit(spark, str(tmp_path)))
    assert got == brute(docs, labels) and len(got) == 3 * 600


def test_edge_documents_and_empty_tables(spark, tmp_path):
    docs, none = edge_documents(spark), spark.createDataFrame([], LABELS)
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [])
    assert rows_of(f.audit(f.cells(docs, none))) == want
    assert f.audit(f.cells(docs.limit(0), none)).count() == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 8):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for at in f.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == factorial(n) == 1 + sum(1 for _ in f.swaps(n))


def test_a_swap_computes_two_steps(monkeypatch):
    counts, steps = np.random.default_rng(1).integers(0, 9, (3, 4, 32)), []
    walk = f.Walk(counts, "ABCDE")
    monkeypatch.setattr(walk, "_compute", lambda step, own=walk._compute: steps.append(step) or own(step))
    for at in f.swaps(5):
        walk.swap(at)
    assert len(steps) == 2 * 119
    masks = np.arange(32)
    for k in range(5):
        before, total = [m for m in range(32) if not m >> k & 1], 0
        for s in before:
            weight = factorial(bin(s).count("1")) * factorial(4 - bin(s).count("1"))
            total = total + weight * counts[0][:, (masks >> k & 1 > 0) & (masks & s == 0)].sum(axis=1)
        assert np.array_equal(walk.shapley[k], total)
