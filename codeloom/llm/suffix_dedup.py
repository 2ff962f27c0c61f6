"""Removal of long repeated byte strings with suffix arrays that two-stage sorting builds.

A byte goes if it lies in a string of ``WIDTH`` bytes (a window) that also starts in a document with a smaller doc_id.

Only parts of texts that can repeat are sorted, each where its like are. Every window has an anchor: the least hash of its
byte strings of about half its length. Equal windows have equal anchors, so (1) blocks of documents send the anchors' hashes,
distinct within the block, to parts of the hash space, and learn which occur in several documents; (2) the passages around
those, distinct within the block and with the smallest doc_id that holds them, go to the part of their anchor; (3) a part
sorts the suffixes of its passages, compares neighbours, and of each run of suffixes that share ``WIDTH`` bytes takes the
smallest doc_id; (4) each block learns which of its windows another document holds first, and cuts the bytes.

Sorting (``suffix_order``): suffixes smaller than their successors are sorted directly; the others follow by one scan over the
buckets of first bytes, from the smallest on: what precedes a suffix goes, in the order of the scan, to the end of the
bucket of its own first byte. A scan of a bucket is a few array operations. Then ``common_prefixes`` of neighbours.

An anchor that occurs very often (``HOT`` times) with ever other surroundings could fill a part; its windows are sent one by
one, each to the part of its own hash, so what is equal still meets and the rest is spread. A passage that very many
documents share is one row of each block. Parts and blocks have a bounded size; their number grows with the input.

Rows: one per block and part in (1) and (2), with all of the pair's hashes or passages in it. Texts are not shuffled as long as a
block's answers are few enough to broadcast (``BROADCAST_BYTES``, measured); beyond that compressed blocks are joined with them.
Nothing but sums reaches the driver; stored tables cut the lineage after (1), (3) and the packing of blocks.

Defined results: a null text is empty; texts shorter than ``WIDTH`` bytes stay whole; a document with a null doc_id stays whole
and removes nothing; rows that share a doc_id do not remove each other's bytes, and each gets its row; a very long text is a block of its
own, hashed piece by piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, prepare

WIDTH = 50
BLOCK_BYTES, PIECE_BYTES = 4 << 20, 1 << 17
#: Anchors of a part of the hash space in (1), and bytes of passages of a part in (2).
PART_ANCHORS, PART_BYTES = 1 << 20, 8 << 20
#: Windows of a passage at most; occurrences that make an anchor a hot one.
PASSAGE, HOT = 256, 100_000
BROADCAST_BYTES = 64 << 20
BASE, MIX = 0xD6E8FEB86659FD93, np.uint64(0x9FB21C651E98DF25)
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
BLOCKS = "ids binary, known binary, lengths binary, payload binary, n_bytes long, anchors long"
HASHES = "part int, block long, rest binary, marks binary"
SHARED = "block long, part int, shared binary, hot binary, n long"
SENT = "part int, block long, windows binary, ids binary, texts binary, n long"
TAKEN = "block long, part int, taken binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, ARROW[kind]) for v, (_, kind) in zip(values, columns, strict=True)], names=[name for name, _ in columns])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def rolled(text: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes, by doubling."""
    have, n, out, done = (text.astype(np.uint64) + np.uint64(1)) * MIX, 1, None, 0
    while True:
        if size & n:
            if out is None:
                out = have
            else:
                m = len(text) - done - n + 1
                out = out[:m] * np.uint64(pow(BASE, n, 1 << 64)) + have[done : done + m]
            done += n
        if done == size:
            return mixed(out)
        have = have[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + have[n:]
        n *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    rest = width - n
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(text: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and hashes of all runs of windows of one document with one anchor."""
    gram = max(1, width // 2 - 1)
    ends = np.cumsum(lengths)
    begins, counts, hashes = [], [], []
    for at in range(0, len(text) - width + 1, PIECE_BYTES):
        piece = text[at : at + PIECE_BYTES + width - 1]
        own = least(rolled(piece, gram), width - gram + 1)
        change = np.r_[True, own[1:] != own[:-1]]
        # No window reaches over the end of a document: those that would are runs of their own, left out below.
        some = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + len(own) + width, side="left")] - at
        over = np.zeros(len(own) + 1, np.int32)
        np.add.at(over, np.clip(some - width + 1, 0, len(own)), 1)
        np.add.at(over, np.clip(some, 0, len(own)), -1)
        inside = np.cumsum(over[:-1]) == 0
        change |= np.r_[True, inside[1:] != inside[:-1]]
        change[some[some < len(own)]] = True
        starts = np.flatnonzero(change)
        n = np.diff(np.r_[starts, len(own)])
        good = inside[starts]
        begins.append(starts[good] + at)
        counts.append(n[good])
        hashes.append(own[starts[good]])
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Least hashes are small numbers; mixed again they are spread evenly.
    return np.concatenate(begins), np.concatenate(counts), mixed(np.concatenate(hashes) * MIX)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_successors(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; equal bytes decide by the first byte after them that differs."""
    step = np.diff(text.astype(np.int16), append=-1)
    place = np.where(step != 0, np.arange(len(text)), len(text))
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    out = np.zeros(len(text) + 56, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """The places where ``wanted`` holds, in the order of their suffixes as far as ``depth`` bytes tell them apart, by two-stage
    sorting."""
    if not len(text):
        return np.zeros(0, np.int64)
    small = by_successors(text)
    # A wanted suffix that is larger than its successor needs that one's place, and so on up to one sorted directly.
    last = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])
    place = np.where(small, np.arange(len(text)), len(text) - 1)
    upto = np.minimum.accumulate(place[::-1])[::-1][last]
    need = np.cumsum(np.bincount(last, minlength=len(text) + 1) - np.bincount(upto, minlength=len(text) + 1))[:-1] > 0
    need = need | wanted
    need[upto] = True
    direct = np.flatnonzero(need & small)
    keys = [word[np.minimum(direct + 8 * k, len(word) - 1)] for k in range(-(-depth // 8))]
    direct = direct[np.lexsort(keys[::-1])]
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[-1] and not small[-1]:  # the last suffix follows from the empty one
        induced[text[-1]].append(np.array([len(text) - 1]))
    large, out = need & ~small, [direct[:0]]

    def before(places: np.ndarray) -> np.ndarray:
        earlier = places[places > 0] - 1
        return earlier[large[earlier]]

    for c in range(256):
        bucket, now = [], np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(now):  # runs of the byte itself grow inside the bucket
            bucket.append(now)
            earlier = before(now)
            now = earlier[text[earlier] == c]
        bucket.append(direct[edges[c] : edges[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        out.append(full)
        earlier = before(full)
        firsts = text[earlier]
        earlier, firsts = earlier[firsts > c], firsts[firsts > c]
        order = np.argsort(firsts, kind="stable")
        cuts = np.searchsorted(firsts[order], np.arange(257))
        for b in np.unique(firsts).tolist():
            induced[b].append(earlier[order[cuts[b] : cuts[b + 1]]])
    found = np.concatenate(out)
    return found[wanted[found]]


def common_prefixes(order: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    """Bytes, up to ``width``, that each suffix shares with the one before it (0 for the first)."""
    shared, alive = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(-(-width // 8)):
        a, b = np.minimum(order[alive - 1] + 8 * k, len(word) - 1), np.minimum(order[alive] + 8 * k, len(word) - 1)
        differ = word[a] ^ word[b]
        ended = differ != 0
        equal = np.zeros(ended.sum(), np.int64)
        for n in range(1, 8):
            equal += differ[ended] < np.uint64(1 << (64 - 8 * n))
        shared[alive[ended]] = 8 * k + equal
        alive = alive[~ended]
    shared[alive] = width
    return np.minimum(shared, width)


def first_owners(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """For every window of passages of these lengths, in order, the smallest id of a passage that holds the same bytes."""
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    wanted = np.arange(len(text)) + width <= ends[owner]
    word = words(text)
    order = suffix_order(text, wanted, word, width)
    starts = np.flatnonzero(common_prefixes(order, word, width) < width)
    best = np.minimum.reduceat(ids[owner[order]], starts) if len(order) else ids[:0]
    out = np.zeros(len(text), np.int64)
    out[order] = np.repeat(best, np.diff(np.r_[starts, len(order)]))
    return out[wanted]


class Documents:
    """One row of the table of blocks."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.payload = zstandard.decompress(row["payload"], max_output_size=row["n_bytes"]) if row["n_bytes"] else b""
        self.text = np.frombuffer(self.payload, np.uint8)
        self.ends = np.cumsum(self.lengths)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First windows, counts, hashes and documents of the runs in documents with an id."""
        begin, count, h = anchors(self.text, self.lengths, width)
        doc = np.searchsorted(self.ends, begin, side="right")
        has = self.known[doc]
        return begin[has], count[has], h[has], doc[has]


class Passages:
    """The passages of a block around anchors that other documents hold too: ``begin``, ``count`` and ``doc`` of every
    occurrence by ascending doc_id, ``which`` distinct passage it is, and of each of those the bytes, smallest id, part."""

    def __init__(self, block: Documents, answers: list[dict], parts: int, deal: int, width: int):
        begin, count, h, doc = block.anchors(width)
        distinct, inverse = np.unique(h, return_inverse=True)
        level, edges = np.zeros(len(distinct), np.uint8), np.searchsorted(part_of(distinct, parts), np.arange(parts + 1))
        for a in answers:
            p = a["part"]
            n = edges[p + 1] - edges[p]
            level[edges[p] : edges[p + 1]] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=n)
            if a["hot"] is not None:
                level[edges[p] : edges[p + 1]] += np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=n)
        level = level[inverse]
        most = np.where(level == 2, 1, PASSAGE)
        pieces = np.where(level > 0, -(-count // most), 0)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        most, whole = np.repeat(most, pieces), np.repeat(count, pieces)
        begin, doc, h, level = (np.repeat(x, pieces) for x in (begin, doc, h, level))
        begin, count = begin + nth * most, np.minimum(most, whole - nth * most)
        order = np.argsort(block.ids[doc], kind="stable")
        self.begin, self.count, self.doc, h, level = begin[order], count[order], doc[order], h[order], level[order]
        if (hot := level == 2).any():
            h = h.copy()
            h[hot] = self._own_hashes(block.text, self.begin[hot], width)
        known: dict[bytes, int] = {}
        payload, which = block.payload, []
        for a, b in zip(self.begin.tolist(), (self.begin + self.count + width - 1).tolist(), strict=True):
            which.append(known.setdefault(payload[a:b], len(known)))
        self.which, self.texts = np.array(which, np.int64), list(known)
        first = np.unique(self.which, return_index=True)[1]
        self.ids, self.parts, self.windows = block.ids[self.doc[first]], part_of(h[first], deal), self.count[first]
        self.first_id = self.ids[self.which] if len(self.which) else self.ids

    @staticmethod
    def _own_hashes(text: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        order = np.argsort(begin, kind="stable")
        place = begin[order]
        for at in range(0, len(text), PIECE_BYTES):
            a, b = np.searchsorted(place, [at, at + PIECE_BYTES])
            if b > a:
                out[order[a:b]] = rolled(text[at : at + PIECE_BYTES + width - 1], width)[place[a:b] - at]
        return mixed(out * MIX)


def pack_blocks(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """docs as stored blocks of whole documents."""

    def packed(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.array([0 if i is None else i for i, _ in rows], np.int64)
        known, lengths = np.array([i is not None for i, _ in rows]), np.array([len(t) for _, t in rows], np.int64)
        payload = b"".join(t for _, t in rows)
        n = max(1, len(payload) // 14)
        values = [ids.tobytes(), known.tobytes(), lengths.tobytes(), zstandard.compress(payload, 1), len(payload), n]
        return batch_of([tuple(values)], BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if rows and size + len(t) > BLOCK_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
                rows.append((i, t))
                size += len(t)
        if rows:
            yield packed(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialise(spark, texts.mapInArrow(pack, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "suffix-blocks")


def shared_anchors(blocks: DataFrame, parts: int, width: int) -> DataFrame:
    """block, part, shared and hot: bits for the block's distinct anchors of the part, in order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, h, doc = Documents(row).anchors(width)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
                times = np.diff(np.r_[starts, len(h)])
                several = doc[starts] != doc[np.r_[starts[1:], len(h)] - 1] if len(h) else np.zeros(0, bool)
                h, marks = h[starts], np.minimum(times, 0x7FFF).astype(np.uint16) | (several.astype(np.uint16) << 15)
                edges, rest = np.searchsorted(part_of(h, parts), np.arange(parts + 1)), h.astype(np.uint32)
                rows = [(p, row["block"], rest[a:b].tobytes(), marks[a:b].tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                yield batch_of(rows, HASHES)

    def meet(table: pa.Table) -> pa.Table:
        lengths = [len(x) // 4 for x in table.column("rest").to_pylist()]
        rest = np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint32)
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint16)
        order = np.argsort(rest, kind="stable")
        starts = np.flatnonzero(np.r_[True, rest[order][1:] != rest[order][:-1]])
        n = np.diff(np.r_[starts, len(order)])
        shared = (n > 1) | (np.maximum.reduceat(marks[order], starts) >> 15 > 0)
        hot = shared & (np.add.reduceat((marks[order] & 0x7FFF).astype(np.int64), starts) > HOT)
        back = np.empty((2, len(order)), bool)
        back[:, order] = np.repeat(np.stack([shared, hot]), n, axis=1)
        rows, at = [], 0
        for part, block, size in zip(table.column("part").to_pylist(), table.column("block").to_pylist(), lengths, strict=True):
            own = back[:, at : at + size]
            at += size
            if own[0].any():
                rows.append((block, part, np.packbits(own[0]).tobytes(), np.packbits(own[1]).tobytes() if own[1].any() else None, int(own[0].sum())))
        return pa.Table.from_batches([batch_of(rows, SHARED)])

    sent = blocks.select("block", "ids", "known", "lengths", "payload", "n_bytes").mapInArrow(send, HASHES)
    return sent.groupBy("part").applyInArrow(meet, SHARED)


def _answered(blocks: DataFrame, answers: DataFrame, size: int, columns: list[str], name: str, how: str) -> DataFrame:
    """blocks with their answers as an array; broadcast where all of them have at most ``BROADCAST_BYTES``."""
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))
    return blocks.join(F.broadcast(by_block) if size <= BROADCAST_BYTES else by_block, "block", how)


def first_windows(armed: DataFrame, parts: int, deal: int, width: int) -> DataFrame:
    """block, part, taken: bits for the windows of the block's distinct passages of the part, whether a document with a
    smaller id than the block's first one with the passage holds the window."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Passages(Documents(row), row["answers"], parts, deal, width)
                order = np.argsort(own.parts, kind="stable")
                edges, rows = np.searchsorted(own.parts[order], np.arange(deal + 1)), []
                for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    if b > a:
                        some = order[a:b]
                        text = b"".join([own.texts[k] for k in some.tolist()])
                        rows.append((p, row["block"], own.windows[some].astype(np.int32).tobytes(), own.ids[some].tobytes(), zstandard.compress(text, 1), len(text)))
                yield batch_of(rows, SENT)

    def sort(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows, smallest = [], []
        for row in table.to_pylist():
            windows, ids = np.frombuffer(row["windows"], np.int32), np.frombuffer(row["ids"], np.int64)
            texts, at, which = zstandard.decompress(row["texts"], max_output_size=row["n"]), 0, []
            for n, i in zip((windows + width - 1).tolist(), ids.tolist(), strict=True):
                k = known.setdefault(texts[at : at + n], len(known))
                at += n
                if k == len(smallest):
                    smallest.append(i)
                elif i < smallest[k]:
                    smallest[k] = i
                which.append(k)
            rows.append((row["block"], row["part"], np.array(which), windows, ids))
        lengths = np.array([len(t) for t in known], np.int64)
        owners = first_owners(np.frombuffer(b"".join(known), np.uint8), lengths, np.array(smallest, np.int64), width)
        starts, out = np.cumsum(lengths - width + 1) - (lengths - width + 1), []
        for block, part, which, windows, ids in rows:
            places = np.repeat(starts[which] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            taken = owners[places] < np.repeat(ids, windows)
            if taken.any():
                out.append((block, part, np.packbits(taken).tobytes()))
        return pa.Table.from_batches([batch_of(out, TAKEN)])

    sent = armed.mapInArrow(send, SENT)
    return sent.groupBy("part").applyInArrow(sort, TAKEN)


def removed_bytes(block: Documents, own: Passages, taken: list[dict], width: int) -> np.ndarray:
    """Which bytes of the block go."""
    first = np.zeros(int(own.windows.sum()), bool)  # of the distinct passages' windows, in the order of the passages
    starts = np.cumsum(own.windows) - own.windows
    order = np.argsort(own.parts, kind="stable")
    edges = np.searchsorted(own.parts[order], np.arange(own.parts.max() + 2 if len(own.parts) else 1))
    for t in taken:
        some = order[edges[t["part"]] : edges[t["part"] + 1]]
        n = own.windows[some]
        places = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first[places] = np.unpackbits(np.frombuffer(t["taken"], np.uint8), count=n.sum())
    at = np.repeat(starts[own.which] - (np.cumsum(own.count) - own.count), own.count) + np.arange(own.count.sum())
    gone = first[at] | np.repeat(block.ids[own.doc] > own.first_id, own.count)
    window = (np.repeat(own.begin - (np.cumsum(own.count) - own.count), own.count) + np.arange(own.count.sum()))[gone]
    size = len(block.text) + 1
    edge = np.bincount(window, minlength=size) - np.bincount(window + width, minlength=size)
    return np.cumsum(edge)[:-1] > 0


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of [start, stop) bytes that go, maximal, in order) and kept (the remaining bytes) of
    every row of docs (doc_id, text)."""
    prepare(spark)
    blocks = pack_blocks(spark, docs, width)
    total = blocks.agg(F.sum("anchors")).first()[0] or 0
    parts = max(1, -(-total // PART_ANCHORS))
    shared = materialise(spark, shared_anchors(blocks, parts, width), "suffix-anchors")
    size, n = shared.agg(F.sum(F.octet_length("shared") + F.coalesce(F.octet_length("hot"), F.lit(0)) + 64), F.sum("n")).first()
    deal = max(1, -(-(n or 0) * (3 * width // 2) // PART_BYTES))
    armed = _answered(blocks, shared, size or 0, ["part", "shared", "hot"], "answers", "inner")
    taken = materialise(spark, first_windows(armed, parts, deal, width), "suffix-taken")
    more = taken.agg(F.sum(F.octet_length("taken") + 64)).first()[0] or 0
    told = _answered(_answered(blocks, shared, size or 0, ["part", "shared", "hot"], "answers", "left"), taken, more, ["part", "taken"], "gone", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                block = Documents(row)
                gone = removed_bytes(block, Passages(block, row["answers"] or [], parts, deal, width), row["gone"] or [], width) if row["gone"] or row["answers"] else np.zeros(len(block.text), bool)
                rows, at = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}, 0
                for i, known, end in zip(block.ids.tolist(), block.known.tolist(), block.ends.tolist(), strict=True):
                    own = gone[at:end]
                    edge = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                    rows["doc_id"].append(i if known else None)
                    rows["n_bytes"].append(end - at)
                    rows["spans"].append([{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    rows["kept"].append(block.text[at:end][~own].tobytes() if edge else block.payload[at:end])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["spans"], kind), pa.array(rows["kept"], pa.binary())], names=list(rows))

    return told.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
