import random

import pytest

from codeloom.llm import minhash
from codeloom.llm.components import components
from tests.llm.helpers import DOCS, EDGE, edge_documents


def brute(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return [(r[0], len(s), (ids.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def family(rng, base, edits, n):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width,block,set_block", [(4, 1024, 256), (5, 7, 5)])
def test_same_as_brute_force(spark, monkeypatch, width, block, set_block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", set_block)
    rng = random.Random(width)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 90, 150]))]
        texts += family(rng, base, rng.choice([1, 3, 6, 9]), rng.randint(2, 18))
    rng.shuffle(texts)
    rows = [(100 + i, t, *EDGE[0][2:]) for i, t in enumerate(texts)] + EDGE
    got = minhash.classes(spark, spark.createDataFrame(rows, DOCS), width, 80).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute(rows, width, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_of_each_class(spark):
    kept = minhash.keep_one(spark, edge_documents(spark))
    assert kept.columns == edge_documents(spark).columns
    assert order((r.doc_id,) for r in kept.collect()) == order((i,) for i in (None, 1, 2, 3, 4, 5, 7, 8))
    assert minhash.keep_one(spark, edge_documents(spark).limit(0)).count() == 0


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("hubs,edits", [(2, 9), (64, 4)])
def test_large_families_are_compared_whole_in_rows_in_proportion(spark, monkeypatch, hubs, edits):
    """Different near copies of one text, of which hubs attach a part only; every step's rows stay a few times the nodes."""
    for name, value in (("BLOCK", 50), ("SET_BLOCK", 40), ("HUBS", hubs), ("HOT_LEAST", 5)):
        monkeypatch.setattr(minhash, name, value)
    written, made = [], minhash._streamed
    monkeypatch.setattr(minhash, "_streamed", lambda df, make, work, schema: written.append((work.__name__, df.groupBy("kind").count().collect())) or made(df, make, work, schema))
    rng = random.Random(hubs)
    base = [f"w{k}" for k in range(60)]
    texts = family(rng, base, edits, 400) + family(rng, [f"v{k}" for k in range(50)], 2, 60) + [" ".join(base)] * 30
    rows = [(i, t, *EDGE[0][2:]) for i, t in enumerate(texts)]
    got = minhash.classes(spark, spark.createDataFrame(rows, DOCS), 4, 80).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute(rows, 4, 80))
    # The buckets come first: a node is in at most BANDS of them; then the sets, where it is in one group.
    steps = [(name, {r.kind: r["count"] for r in counts}) for name, counts in written]
    for groups, own in ((minhash.BANDS, steps[:3]), (1, steps[3:])):
        assert [name for name, _ in own] == ["_Whole", "_Hubs", "_Rest"]
        assert all(n.get(1, 0) <= groups * len(texts) * (minhash.FAN if name == "_Rest" else 1) for name, n in own)
        assert own[0][1].get(0, 0) <= groups * len(texts) and own[2][1].get(0, 0) <= minhash.FAN * groups * len(texts)


def test_ids_that_are_no_key(spark):
    near = " ".join(f"w{k}" for k in range(100))
    texts = [(1, near), (2, near + " x"), (2, "something else entirely with more than five words"), (2, "something else entirely with more than five words"), (1, near), (None, near + " y"), (None, "a lonely text without any id in its class"), (None, "a lonely text without any id in its class"), (3, None), (3, None), (4, "few words"), (1, near + " z")]
    rows = [(i, t, *EDGE[0][2:]) for i, t in texts]
    kept = minhash.keep_one(spark, spark.createDataFrame(rows, DOCS))
    left = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    first = [x for x in left if x[1] == 1]
    assert len(first) == 1 and first[0][2].startswith(near)
    assert [x for x in left if x[1] != 1] == [(False, 0, texts[6][1]), (True, 2, texts[2][1]), (True, 3, ""), (True, 3, ""), (True, 4, "few words")]
    assert kept.columns == spark.createDataFrame(rows, DOCS).columns


def test_crowded_nodes_are_salted(spark, monkeypatch):
    from codeloom.llm import components as c

    monkeypatch.setattr(c, "CROWDED", 20)
    monkeypatch.setattr(c, "TIMES", 0)
    rng = random.Random(3)
    edges = [(500, k) for k in range(400)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(2000 + k, 2001 + k) for k in range(40)]
    assert c._survey(spark.createDataFrame(edges, "u long, v long"))[1]
    found = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for u, v in edges if u != v for x in (u, v)}
