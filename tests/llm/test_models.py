import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, language_id, queries, quality
from tests.llm.helpers import DOCS, EDGE, edge_documents, write

WORDS = {
    "en": "the of and to that in is was he for it with as his on be at by this had not are but from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne".split(),
}


def documents(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((1000 + i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "s", 1, "x", 1, "y"))
    return rows


def test_language_accuracy_and_edge_cases(spark, tmp_path):
    rows = documents(400) + EDGE
    write(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    got = queries.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] >= 1000}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 7):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[None].held_out is False and by[8].lang_pred in WORDS
    kept = language_id.keep(spark, edge_documents(spark), language_id.train(spark, spark.createDataFrame(rows, DOCS)))
    assert kept.columns == edge_documents(spark).columns and {1, 2, 3, 7}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_with_nothing_to_learn(spark):
    docs = edge_documents(spark)
    model = language_id.train(spark, docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(spark, docs, model).collect()} == {"und"}
    assert language_id.predict(spark, docs.limit(0), model).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    rng, rows = random.Random(12), []
    for k in range(150):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8))) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(40)), f"l{k:03}") for i in range(6 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(spark, docs)
    assert len(model.languages) == 150
    got = {r.doc_id: r for r in language_id.predict(spark, docs, model).collect()}
    right = [(lang, got[i].lang_pred == lang and got[i].score > 0.5) for i, _, lang in rows]
    assert np.mean([ok for _, ok in right]) > 0.99 and {lang for lang, ok in right if ok} == set(model.languages)
    assert language_id.keep(spark, docs, model).count() > 0.99 * len(rows)


def test_false_positives_are_corrected():
    table = np.zeros(language_id.SLOTS, np.uint64)
    codes = np.arange(1, 2000, dtype=np.uint64)
    for at in language_id.slots(codes[:1000]):
        table[at] |= np.uint64(1)
    fill = float((table > 0).mean())
    model = language_id.Model(["a"], table, np.array([fill**2]))
    assert model.scores(codes[:1000])[0] == pytest.approx(1.0)
    assert model.scores(codes[1000:])[0] < 0.01


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.3
    accuracy, cover = [0.95, 0.8, 0.7, 0.6], [0.9, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(6000) < c, np.where((rng.random(6000) < a) == truth, quality.BAD, quality.GOOD), quality.ABSTAIN) for a, c in zip(accuracy, cover, strict=True)], axis=1)
    posterior, tables, prior = quality.expect(votes)
    assert abs(prior - 0.3) < 0.05
    given = tables / (1 - tables[:, :, :1])
    assert np.allclose(given[:, 1, quality.BAD], accuracy, atol=0.06)
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_quality_rejects_junk_and_insults(spark, tmp_path):
    rng = random.Random(2)
    clean = documents(300, 5)
    junk = [(5000 + i, " ".join(w.upper() + "!!" for w in t.split()), *rest) for i, (_, t, *rest) in enumerate(documents(60, 6))]
    junk += [(6000 + i, " ".join(w + "$$$ %%%" for w in t.split()), *rest) for i, (_, t, *rest) in enumerate(documents(60, 7))]
    rude = [(7000 + i, t + " you " + rng.choice(["stupid idiot", "pathetic loser"]) + " gruntzel" * (i % 2), *rest) for i, (_, t, *rest) in enumerate(documents(60, 8))]
    foreign = [(8000 + i, t + " zornwort schimpfel", *rest) for i, (_, t, *rest) in enumerate(documents(80, 9))]
    rows = clean + junk + rude + foreign + EDGE
    write(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    labels = [(r[0], int(r[0] < 5000 or r[0] >= 7000), int(r[0] >= 7000)) for r in clean[:150] + junk[::2] + rude[::2] + [f for i, f in enumerate(foreign) if i % 4]]
    labels += [(clean[0][0], None, None), (None, 1, 0), (clean[1][0], 1, 0)]
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = queries.op7_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert np.mean([kept[r[0]] for r in clean]) > 0.99
    assert np.mean([kept[r[0]] for r in junk + rude + foreign]) < 0.02
    assert not any(kept[i] for i in (1, 2, 3))
    docs = spark.createDataFrame(rows, DOCS)
    blank = quality.train(spark, docs.limit(0), None)
    assert quality.score(spark, docs.limit(0), blank).count() == 0
    assert {r.doc_id for r in quality.score(spark, edge_documents(spark), blank).where("not kept").collect()} == {1, 2, 3}


def brute_nearest(rows, query_id, vector, k):
    scored = [(-float((np.float64(v) * np.float64(vector)).sum()), i) for i, v in rows if i != query_id]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_nearest_matches_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(150, 12)).astype(np.float32).round(2)
    vectors[40:80] = vectors[0]  # ties
    vectors[100] *= 5  # lengths differ
    good = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    bad = [(900, None), (920, []), (940, [0.0] * 12), (960, [float("nan")] * 12), (980, [None] * 12), (1000, [1.0] * 3), (None, [1.0] * 12), (1020, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(good + bad + good[:1], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1))
    got = ann.nearest(spark, df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect()
    assert {r.query_id for r in got} == set(range(0, 150, 20))
    for q in range(0, 150, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in own] == list(range(1, 21))
        want = brute_nearest(good, q, vectors[q], 20)
        assert [(r.vec_id, r.score) for r in own] == [(i, pytest.approx(s)) for i, s in want]
    few = ann.nearest(spark, df.where("vec_id < 5"), "vec_id", "embedding", F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest(spark, df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0


def test_probing_and_scanning_retrieve_the_same_codes():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (3000, 9), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(rng.random((200, 72)) < 0.05, axis=1)
    index = ann.Index(codes)
    apart = np.bitwise_count(codes ^ codes[0]).sum(axis=1, dtype=int)
    for radius in (0, 5, 11, 30):
        probed = index.probe(codes[0], radius)
        assert set(np.flatnonzero(apart <= radius)) <= set(probed.tolist())
        assert np.array_equal(index.distances(codes[0]), apart)
        assert set(index.search(codes[0], radius, 1).tolist()) == set(np.flatnonzero(apart <= radius))
    assert len(index.search(codes[0], 0, 50)) >= 50


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.nearest(spark, df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    true = {(q, int(i)) for q in range(0, 3000, 20) for i in np.argsort(-np.where(np.arange(3000) == q, -9, v @ v[q]))[:20]}
    assert len(found) == len(true) and len(found & true) / len(true) >= 0.9


@pytest.mark.parametrize("times", [3, 10])
def test_recall_with_a_long_vector_outside_the_sample(spark, monkeypatch, times):
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(6000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    schema = "vec_id long, embedding array<float>"
    place = F.xxhash64(F.xxhash64("embedding"))
    last = spark.createDataFrame([(i, (times * x).tolist()) for i, x in enumerate(v)], schema).orderBy(place.desc()).first().vec_id
    v[last] *= times
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], schema)
    assert last not in {r.vec_id for r in df.orderBy(place).limit(ann.SAMPLE).collect()}
    got = ann.nearest(spark, df, "vec_id", "embedding", F.col("vec_id") % 60 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    true = {(q, int(i)) for q in range(0, 6000, 60) for i in np.argsort(-np.where(np.arange(6000) == q, -9, v @ v[q]))[:20]}
    assert len(found) == len(true) and len(found & true) / len(true) >= 0.95


def test_scores_are_those_of_all_tokens(spark, tmp_path):
    """Brute force over the query's rows: every token's weight, looked up one by one; also where the stores are emptied."""
    rng = random.Random(21)
    rows = documents(120, 22) + [(3000 + i, t + rng.choice([" you idiot", " STUPID moron!!", " $$$ ###"]), *rest) for i, (_, t, *rest) in enumerate(documents(60, 23))] + EDGE
    write(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    labels = spark.createDataFrame([(r[0], int("$" not in r[1]), int(r[0] >= 3000 and "$" not in r[1])) for r in rows[:180]], "doc_id long, quality int, toxic int")
    write(labels, tmp_path, "labels")
    model = quality.train(spark, spark.createDataFrame(rows, DOCS), labels)
    assert model.weights.any(axis=1).all()

    def plain(text):
        if not text or not text.split():
            return (1.0, 0.0)
        found, words = quality.measures(text)
        every = {quality.slot(t) for w in words for t in (w, b"\x01" + w[:5], b"\x02" + w[:4], b"\x03" + w[:7])} | {quality.slot(t) for t in quality.buckets(found)}
        return tuple(1 / (1 + np.exp(-(sum(float(model.weights[k, s]) for s in sorted(every)) + model.bias[k]))) for k in (0, 1))

    want = sorted((str(r[0]), *np.round(plain(r[1]), 6), bool(plain(r[1])[0] < 0.5 and plain(r[1])[1] < 0.25)) for r in rows)
    got = queries.op7_quality_classifier(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *np.round((r.p_junk, r.p_toxic), 6), r.kept) for r in got) == want
    scorer = quality.Scorer(model)
    for limit in (5, quality.STORE):
        quality.STORE, kept = limit, quality.STORE
        assert all(np.allclose(scorer.probabilities(r[1]), plain(r[1])) for r in rows)
        quality.STORE = kept


def test_the_vocabulary_votes_on_the_half_that_it_did_not_see():
    rng = np.random.default_rng(2)
    human = np.where(np.arange(400) < 80, quality.BAD, np.where(np.arange(400) < 300, quality.GOOD, quality.ABSTAIN)).astype(np.uint8)
    order = rng.permutation(400)
    human = human[order]
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 30), rng.choice(np.arange(1000, 1010), 5, replace=False) if order[i] < 80 or order[i] >= 380 else []])).astype(np.int64) for i in range(400)]
    vote = quality.vocabulary_votes(rows, human)
    assert set(np.flatnonzero(vote == quality.BAD)) == {i for i in range(400) if order[i] < 80 or order[i] >= 380}
    assert not quality.vocabulary_votes(rows, np.zeros(400, np.uint8)).any()


def test_languages_by_brute_force(spark, tmp_path):
    """Plain sets of n-grams per language in place of the sliced filters; their false positives are rarer than the scores' lead."""
    rows = documents(300, 31) + EDGE
    docs = spark.createDataFrame(rows, DOCS)
    write(docs, tmp_path, "documents")
    held = {r.doc_id: r.held_out for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out")).collect()}
    known, counts = {}, {}
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and lang is not None and not held[doc_id]:
            known.setdefault(lang, set()).update(language_id.grams(text)[0].tolist())
            counts[lang] = counts.get(lang, 0) + 1
    got = queries.op3_language_id(spark, str(tmp_path)).collect()
    by = {(r.doc_id, r.lang_pred): r for r in got}
    for doc_id, text, *_ in rows:
        codes, any_letter = language_id.grams(text)
        if not any_letter:
            assert (doc_id, "und") in by
            continue
        share = {lang: np.mean([c in own for c in codes.tolist()]) if len(codes) else 0.0 for lang, own in known.items()}
        best = max(share, key=lambda lang: (share[lang], counts[lang]))
        rows_ = [r for r in got if r.doc_id == doc_id]
        assert any(r.lang_pred == best and abs(r.score - share[best]) < 0.01 for r in rows_)


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda s, p, own=quality.learn: seen.append(len(s)) or own(s, p))
    rows = documents(60) + [(7, f"text number {k} of one id", "en", "s", 1, "x", 1, "y") for k in range(3000)]
    labels = spark.createDataFrame([(7, 1, 0), (1000, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(spark, spark.createDataFrame(rows, DOCS), labels, sample=80, labelled=40)
    assert len(seen) == 2 and 40 <= min(seen) and max(seen) <= 42
    again = quality.train(spark, spark.createDataFrame(rows[::-1], DOCS).repartition(7), labels, sample=80, labelled=40)
    assert np.array_equal(model.weights, again.weights)
