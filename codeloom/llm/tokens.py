"""Whole-text encoding with a tokenizers file, fast enough for corpora.

A byte-level BPE splits a text into pieces before any merge, and no piece crosses a single space between two
characters that are not white space. So texts are cut before such spaces, each part is encoded once by the
tokenizers library, and its ids are kept under a 64-bit hash of its bytes; joined, they are the ids of the whole text.
The hash only finds a part: all bytes of a hit are compared, and a part whose hash belongs to another one is encoded
afresh, as are parts of more than ``PART`` bytes, which are never kept. The tokenizer's added token, where a text holds
it, is one id as in a plain call of the library; it holds no space, so no cut falls inside it. Cutting, hashing,
comparing and looking up run over whole batches at once. The store of parts is emptied when it is full, which costs
time and changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

#: Slots of the store, and the parts at which it is emptied; about 70 MB per worker.
SLOTS, LIMIT = 1 << 21, 1_300_000
#: Bytes of text handled together (a longer text is handled alone), and parts encoded as one text.
BATCH, GROUP = 1 << 19, 64
#: Bytes of the longest part that is kept.
PART = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_encoders: dict[str, Encoder] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class Hasher:
    """Hashes of byte spans from running sums of byte * base ** place, modulo 2 ** 64."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.zeros(0, np.uint64)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = _powers(self.base, 2 * len(data) + 1), _powers(self.back, 2 * len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _MIX
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(30)) | np.uint64(1)


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_NO_BYTES = np.zeros(9, np.uint8)
#: What ``find`` answers for a part that is not in the store, and for one whose hash another part holds.
UNKNOWN, CLASH = -1, -2


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` (which ends with eight bytes to spare) as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Store:
    """Open addressing over 64-bit keys, with the bytes of every part; a hit is a part of the very same bytes."""

    def __init__(self, slots: int, limit: int):
        self.slots, self.limit = slots, limit
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.start, self.count, self.byte, self.size = (np.zeros(self.limit, t) for t in (np.int64, np.int32, np.int64, np.int32))
        self.ids, self.n, self.used = np.zeros(4 * self.limit, np.uint32), 0, 0
        self.bytes, self.filled = np.zeros(8 * self.limit, np.uint8), 0

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Row of each part, given by its key and its place in ``data`` (with eight bytes to spare), or one of the codes above."""
        out, at = np.full(len(keys), UNKNOWN, np.int64), np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        while len(at):
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.row[slot[hit]]
            on = ~hit & (held != 0)
            at, slot = at[on], (slot[on] + 1) & (self.slots - 1)
        known = np.flatnonzero(out >= 0)
        rows = out[known]
        same = self.size[rows] == sizes[known]
        out[known[~same]] = CLASH
        known, rows = known[same], rows[same]
        asked, kept, done = _words_at(data), _words_at(self.bytes), 0
        while len(known):
            left = sizes[known] - done
            differ = (asked[starts[known] + done] ^ kept[self.byte[rows] + done]) & _FIRST[np.minimum(left, 8)] != 0
            out[known[differ]] = CLASH
            on = ~differ & (left > 8)
            known, rows, done = known[on], rows[on], done + 8
        return out

    def add(self, keys: np.ndarray, parts: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        """New and distinct keys, the part of each, its number of ids, and all ids in turn."""
        rows = np.arange(self.n, self.n + len(keys))
        need = self.used + int(counts.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, np.uint32)])
        self.ids[self.used : need] = ids
        self.count[rows], self.start[rows] = counts, self.used + np.cumsum(counts) - counts
        joined, sizes = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
        full = self.filled + len(joined)
        if full + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(full + 8, np.uint8)])
        self.bytes[self.filled : full] = joined
        self.size[rows], self.byte[rows] = sizes, self.filled + np.cumsum(sizes) - sizes
        self.n, self.used, self.filled = self.n + len(keys), need, full
        at, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[at[free]]
            placed = self.keys[slot] == keys[at]
            self.row[slot[placed]] = rows[at[placed]]
            at, slot = at[~placed], (slot[~placed] + 1) & (self.slots - 1)


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where parts start in joined UTF-8 texts that begin at ``begins``: at every text, and at every single space whose
    neighbours can't be white space (of characters beyond ASCII, all that share lead bytes with white space
    are taken for it)."""
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    first[-1] = True
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[(data[at - 1] > 0x20) & (data[at + 1] > 0x20) & ~first[at] & ~first[at + 1]]
    if (data >= 0xC2).any():
        padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
        wide = lambda lead, second: np.isin(padded[lead], (0xE1, 0xE2, 0xE3)) & np.isin(padded[second], (0x80, 0x81, 0x9A))
        at = at[~((padded[at + 1] == 0xC2) | wide(at, at + 1) | (padded[at + 4] == 0xC2) | wide(at + 4, at + 5))]
    first[at] = True
    return np.flatnonzero(first[:-1])


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. ``added_tokens`` reads added tokens in texts
    as such, which is the library's default and what ``encoder`` gives the operators; else they are ordinary text."""

    def __init__(self, path: str, slots: int = SLOTS, limit: int = LIMIT, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(1 + max(vocabulary.values()), bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.store = Store(slots, limit)
        self.hasher = Hasher(_BASE)

    def _plain(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the parts, and in it the number of ids of each and all ids in turn. Parts that are a space and a word go
        many to a text; every such part, and nothing else there, starts with an id in ``starts``. The others are
        encoded one by one."""
        words = [i for i, p in enumerate(parts) if p[0] == " " and (w := p[1:]) and w == w.strip() and " " not in w]
        others = sorted(set(range(len(parts))) - set(words))
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        order, counts, flat = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for group, ids in zip(groups, self._plain(["".join([parts[i] for i in g]) for g in groups]), strict=True):
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(group):
                order += group
                counts.append(np.diff(at, append=len(ids)))
                flat.append(ids)
            else:
                others += group
        alone = self._plain([parts[i] for i in others])
        counts.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        return np.array(order + others, np.int64), np.concatenate(counts), np.concatenate([*flat, *alone])

    def _batch(self, texts: list[bytes]) -> Iterator[bytes]:
        joined = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not joined:
            yield from (b"" for _ in texts)
            return
        data = np.frombuffer(joined, np.uint8)
        starts = cuts(data, (ends - sizes)[sizes > 0])
        stops = np.append(starts[1:], len(data))
        spare, lengths = np.concatenate([data, _NO_BYTES]), stops - starts
        rows = np.full(len(starts), CLASH, np.int64)
        short = np.flatnonzero(lengths <= PART)
        keys = self.hasher.spans(data, starts[short], stops[short])
        rows[short] = self.store.find(keys, spare, starts[short], lengths[short])
        unknown = rows[short] == UNKNOWN
        if unknown.any():
            new, first = np.unique(keys[unknown], return_index=True)
            if self.store.n + len(new) > self.store.limit:
                self.store.clear()
                rows[short], unknown = UNKNOWN, np.ones(len(short), bool)
                new, first = np.unique(keys, return_index=True)
                if len(new) > self.store.limit:
                    yield from (i.tobytes() for i in self._plain([t.decode("utf-8") for t in texts]))
                    return
            first = short[unknown][first]
            parts = [joined[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            order, counts, ids = self._encode_parts([p.decode("utf-8") for p in parts])
            self.store.add(new[order], [parts[i] for i in order.tolist()], counts, ids)
            again = short[unknown]
            rows[again] = self.store.find(keys[unknown], spare, starts[again], lengths[again])
        kept, apart = rows >= 0, np.flatnonzero(rows == CLASH)
        places = [joined[a:b] for a, b in zip(starts[apart].tolist(), stops[apart].tolist(), strict=True)]
        distinct = list(dict.fromkeys(places))
        afresh = dict(zip(distinct, self._plain([p.decode("utf-8") for p in distinct]), strict=True))
        counts = np.zeros(len(rows), np.int64)
        counts[kept] = self.store.count[rows[kept]]
        counts[apart] = [len(afresh[p]) for p in places]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(np.where(kept, self.store.start[np.maximum(rows, 0)], 0) - before[:-1], counts) + np.arange(before[-1])
        flat = self.store.ids[np.minimum(at, len(self.store.ids) - 1)] if len(apart) else self.store.ids[at]
        for i, part in zip(apart.tolist(), places, strict=True):
            flat[before[i] : before[i + 1]] = afresh[part]
        packed = flat.astype("<u4").tobytes()
        edges = (4 * before[np.searchsorted(starts, np.concatenate([[0], ends]))]).tolist()
        yield from (packed[a:b] for a, b in zip(edges, edges[1:], strict=False))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.encode("utf-8"))
            size += len(held[-1])
            if size >= BATCH:
                out += self._batch(held)
                held, size = [], 0
        out += self._batch(held)
        return out


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added_tokens=True)
    return _encoders[path]
