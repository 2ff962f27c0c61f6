import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing, token_output, tokens, wavelet
from tests.llm.helpers import EDGE, edge_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_parts_give_the_ids_of_whole_texts(plain):
    rng = random.Random(4)
    marks = "ab éß.,'!?\n\t\u00a0\u2003\u3000\x1c\x85 12日本 I'm we'll \u200d😀“”"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "  ", "a  b", " a", "a ", "<|endoftext|> x", "don't they're", "x" * 3000]
    small = tokens.Encoder(PATH, slots=1024, limit=700)
    for _ in range(2):
        for text, ids in zip(texts, small.encode(texts), strict=True):
            assert ids == plain(text).tobytes()


def test_added_tokens_are_ids_of_their_own(spark):
    library = Tokenizer.from_file(PATH)
    whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    assert whole("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    rng, end = random.Random(5), "<|endoftext|>"
    texts = [end, end * 2, f"a {end} b", f"in{end}side", f"{end} x", f"x {end}", f"x  {end}", f"{end}\n y", f"'{end}s it", f"é {end}日", "<|endoftext| >", f"<{end}>"]
    texts += ["".join(rng.choice([end, "a", "b", " ", " ", "\n", "é", "'s", "word", "<|", "|>"]) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    small = tokens.Encoder(PATH, slots=1024, limit=700, added_tokens=True)
    for encode in (small.encode, small.encode, tokens.encoder(PATH).encode):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids == whole(text).tobytes(), text
    docs = spark.createDataFrame(list(enumerate(texts[:12])), "doc_id long, text string")
    crc = lambda text, last: zlib.crc32(np.append(whole(text), last).astype("<u4").tobytes())
    written = token_output.read_documents(spark, token_output.write_shards(spark, docs, PATH, end_id=2)).collect()
    packed = packing.encode_pieces(spark, docs, PATH, end_id=0).collect()
    assert {r.doc_id: r.ids_crc32 for r in written} == {i: crc(t, 2) for i, t in enumerate(texts[:12])}
    assert {r.doc_id: r.ids_crc32 for r in packed} == {i: crc(t, 0) for i, t in enumerate(texts[:12])}


@pytest.mark.parametrize("n,width", [(0, 1), (1, 1), (5000, 3), (5000, 700), (70_000, 5)])
def test_wavelet_matrix(n, width):
    ids = np.random.default_rng(n + width).zipf(1.5, n).clip(max=width).astype(np.uint32) * 7
    image = wavelet.pack_shard([3, None], [n // 2, n - n // 2], ids)
    doc_ids, ends, m = wavelet.open_shard(image)
    assert doc_ids == [3, None] and ends.tolist() == [n // 2, n]
    assert np.array_equal(m.decode(), ids)
    for i in range(0, n, max(1, n // 40)):
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for token in (7, 7 * width, 1):
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places)
        for k in range(0, len(places), max(1, len(places) // 10)):
            assert m.select(token, k) == places[k]
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(ValueError):
        wavelet.open_shard(b"something else")


def test_shards_round_trip(spark, plain):
    shards = token_output.write_shards(spark, edge_documents(spark), PATH, end_id=2, shard_tokens=40)
    rows = token_output.read_documents(spark, shards).collect()
    assert shards.count() > 1 and len(rows) == len(EDGE)
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for want, got in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = np.append(plain(want[1]), 2).astype("<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (want[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = token_output.write_shards(spark, edge_documents(spark).limit(0), PATH, 2)
    assert token_output.read_documents(spark, empty).count() == 0


def test_packing_covers_every_piece_once(spark, plain):
    pieces = packing.encode_pieces(spark, edge_documents(spark), PATH, capacity=64)
    rows = packing.pack(spark, pieces, capacity=64, node_rows=100, slack=2).collect()
    expected = []
    for doc_id, text, *_ in EDGE:
        ids = np.append(plain(text), 0).astype("<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    check_sequences(rows, 64)
    assert packing.pack(spark, pieces.limit(0)).count() == 0


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_rounds_merge_residues(spark):
    lengths = np.random.default_rng(1).integers(1, 900, 4000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(spark, pieces, capacity=1000, node_rows=1000, slack=0).collect()
    assert len(rows) == 4000
    sequences = check_sequences(rows, 1000)
    bins, _ = packing.best_fit(np.sort(lengths)[::-1], 1000)
    assert sequences <= 1.02 * (bins.max() + 1)


@pytest.mark.parametrize("nodes", [4, 16])
def test_nodes_have_the_lengths_of_the_whole(spark, nodes):
    """Alternating lengths, of which only two different ones fit together: as many sequences as in one node."""
    pieces = spark.createDataFrame([(i, 0, 0, 900 + 200 * (i % 2), 0) for i in range(400)], packing.PIECES)
    assert check_sequences(packing.pack(spark, pieces, node_rows=-(-400 // nodes)).collect(), 2048) == 200


@pytest.mark.parametrize(("low", "high", "node_bins"), [(700, 1500, 500_000), (50, 1500, 500_000), (700, 1500, 400)])
def test_many_nodes_pack_like_one(spark, low, high, node_bins):
    lengths = np.random.default_rng(low).integers(low, high, 3000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(spark, pieces, node_rows=100, node_bins=node_bins).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(lengths))
    bins, _ = packing.best_fit(np.sort(lengths)[::-1], 2048)
    assert check_sequences(rows, 2048) <= 1.01 * (bins.max() + 1)


def test_lengths_that_fit_no_other_end_in_a_few_rounds(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1100, 0) for i in range(300)], packing.PIECES)
    assert check_sequences(packing.pack(spark, pieces, node_rows=50, node_bins=40).collect(), 2048) == 300


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([7, 6, 4, 3, 3]), 10)
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 6, 7, 0]


def _thue_morse(doublings):
    """Two texts whose polynomial hashes modulo 2 ** 64 are equal whatever the base."""
    one, two = "a", "b"
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


def test_texts_of_equal_hashes_and_long_words_keep_their_own_ids(spark):
    library = Tokenizer.from_file(PATH)
    whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    one, two = _thue_morse(10)
    texts = [one, two, "x" * 8 + one + "y" * 8, "x" * 8 + two + "y" * 8, f"in {one} and {two} it", "q" * 100_000, " ".join(["z" * 63, "z" * 64, "z" * 65, "ß" * 32, "ß" * 33])]
    rng = random.Random(8)
    texts += ["".join(rng.choice("abcdefghij.-é") for _ in range(n)) for n in (17, 64, 65, 5000, 100_000)] + ["日本語" * 9000]
    for encode in (tokens.Encoder(PATH, slots=1024, limit=700, added_tokens=True).encode, tokens.encoder(PATH).encode):
        for group in (texts, texts[::-1], texts[1:2], texts[:1]):
            for text, ids in zip(group, encode(group), strict=True):
                assert ids == whole(text).tobytes()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crc = lambda text, last: zlib.crc32(np.append(whole(text), last).astype("<u4").tobytes())
    written = token_output.read_documents(spark, token_output.write_shards(spark, docs, PATH, end_id=2)).collect()
    assert {r.doc_id: r.ids_crc32 for r in written} == {i: crc(t, 2) for i, t in enumerate(texts)}
    pieces = packing.encode_pieces(spark, docs, PATH, end_id=0).collect()
    lengths = {i: sum(p.length for p in pieces if p.doc_id == i) for i in range(len(texts))}
    assert lengths == {i: len(whole(t)) + 1 for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        ids = np.append(whole(text), 0).astype("<u4")
        for p in (p for p in pieces if p.doc_id == i):
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_a_clash_of_keys_is_encoded_afresh(plain, monkeypatch):
    """Every part gets one of four keys, so nearly every hit is another part's."""
    encoder = tokens.Encoder(PATH, slots=1024, limit=700)
    spans = encoder.hasher.spans
    monkeypatch.setattr(encoder.hasher, "spans", lambda *a: (spans(*a) & np.uint64(3)) + np.uint64(1))
    texts = ["the quick brown fox jumps over the lazy dog", "", "another day another word", "extraordinarily-long-hyphenated-words here extraordinarily-long-hyphenated-worde"] * 2
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == plain(text).tobytes()


def test_counts_and_places_of_tokens_in_all_shards(spark, plain):
    docs = edge_documents(spark)
    shards = token_output.write_shards(spark, docs, PATH, 2, shard_tokens=40)
    assert shards.count() > 1
    own = [(i, [*plain(text), 2]) for i, text, *_ in EDGE]
    tokens = [2, int(own[0][1][0]), 50000]
    assert {r.token: r.n for r in token_output.count_tokens(spark, shards, tokens).collect()} == {t: sum(ids.count(t) for _, ids in own) for t in tokens}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for t in tokens:
        want = [(i, k) for i, ids in own for k, x in enumerate(ids) if x == t]
        assert sorted(((r.doc_id, r.place) for r in token_output.locate(spark, shards, t).collect()), key=key) == sorted(want, key=key)
    empty = shards.limit(0)
    assert [(r.token, r.n) for r in token_output.count_tokens(spark, empty, [2]).collect()] == [(2, 0)]
    assert token_output.locate(spark, empty, 2).count() == 0
