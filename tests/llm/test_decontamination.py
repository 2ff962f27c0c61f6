import hashlib
import random
import re

from codeloom.llm import decontamination as d
from tests.llm.helpers import DOCS, EDGE, edge_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UP))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if v and item_id is not None else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_same_as_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "ß9", "zz"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n)), "x") for k, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 27, 40, 40])]
    items += [(3, "Another, row OF three!", "x"), (None, "no id", "x"), (50, None, "x"), (51, "...", "x"), (60, items[9][1], "x")]
    docs = []
    for k in range(60):
        text = some(rng.choice([0, 4, 30, 200]))
        for _ in range(rng.randint(0, 3)):
            piece = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(piece) - 14))
            at = rng.randint(0, len(text))
            text[at:at] = piece[a : a + rng.randint(10, 40)]
        docs.append((200 + k, rng.choice([" ", ", ", "\n"]).join(text).upper(), *EDGE[0][2:]))
    docs += EDGE
    for limit in (1 << 25, 400):
        bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
        out = d.scan(spark.createDataFrame(docs, DOCS), bench, broadcast_bytes=limit)
        got = {(r.doc_id, r.text_key): r for r in out.collect()}
        for doc_id, text, *_ in docs:
            r = got[doc_id, hashlib.md5((text or "").encode()).hexdigest()]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(text, [i[:2] for i in items])
    assert d.judge(spark.createDataFrame(docs, DOCS), bench).count() == len(docs)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = edge_documents(spark).union(spark.createDataFrame([(90, f"Before, {item}. After", *EDGE[0][2:])], DOCS))
    left = d.remove_documents(docs, bench)
    assert left.columns == docs.columns and left.count() == len(EDGE) and left.where("doc_id = 90").count() == 0
    cut = d.remove_spans(docs, bench)
    assert cut.count() == len(EDGE) + 1 and cut.where("doc_id = 90").first()["text"] == "before after"
    assert cut.where("doc_id = 5").count() == 2
    assert d.judge(docs, bench.limit(0)).where("contaminated").count() == 0
    assert d.judge(docs.limit(0), bench).count() == 0


def test_a_very_long_item_stays_linear(spark):
    rng = random.Random(1)
    item = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[500:520]))], "item_id long, text string")
    table = d.blocks(bench)
    most, rows = table.selectExpr("max(size(part))", "count(*)").first()
    assert most <= 2 * d.WINDOW and rows <= len(item) // 7 + 10
    docs = spark.createDataFrame([(1, "before " + " ".join(item) + " after"), (2, " ".join(item[700:712])), (3, " ".join(item[40_000:40_013]))], "doc_id long, text string")
    got = {r.doc_id: r for r in d.scan(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].spans) == (100_002, 100_000, 2, [(1, 100_001)])
    assert (got[2].n_hit, got[3].n_hit, got[3]["items"]) == (0, 13, ["1"])


def test_blocks_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "SMALL_BLOCKS", 0)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item), (2, item + " and more"), (3, "seven eight"), (4, "nine")], "item_id long, text string")
    docs = [(k, f"x {item} y") for k in range(30)] + [(99, "seven nine"), (100, None)]
    got = {r.doc_id: r for r in d.judge(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {k: brute(t, [(1, item), (2, item + " and more"), (3, "seven eight"), (4, "nine")]) for k, t in docs}
    assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == want


def test_one_word_again_and_again_costs_its_length(spark, monkeypatch):
    stored, made = {}, d.materialise
    monkeypatch.setattr(d, "materialise", lambda s, df, label: stored.setdefault(label, made(s, df, label)))
    n = 70_000
    bench = spark.createDataFrame([(k, "again " * n) for k in (7, 8)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + "again " * n + "y"), (2, "again " * 12), (3, "again " * 13)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.spans) for r in d.scan(docs, bench).collect()}
    assert got == {1: (n + 2, n, ["7", "8"], [(1, n + 1)]), 2: (12, 0, [], []), 3: (13, 13, ["7", "8"], [(0, 13)])}
    assert stored["decontamination-blocks"].count() == 3 and stored["decontamination-items"].count() == 6
    assert stored["decontamination-hits"].count() <= n + 30 and stored["decontamination-spans"].count() <= 3 * n
