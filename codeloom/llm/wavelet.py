"""Token shards as wavelet matrices: bit-planes with rank and select, one file image per shard.

A shard's ids are replaced by their places in its alphabet, most frequent first, so high planes are nearly empty. Plane by plane, from the highest bit, the bits
are packed and the sequence is stably parted into zeros and ones. With a count of ones before every block,
``access``, ``rank``, ``select`` and ``count`` touch one place per plane, without decoding the sequence.

File image: magic, a JSON header with lengths, then zstd-compressed sections: doc ids, doc ends, alphabet, and per
plane its bits and block counts.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"CLWM0001"
BLOCK = 2048  # bits


class Plane:
    def __init__(self, bits: np.ndarray, n: int, ones_before: np.ndarray | None = None):
        self.bits, self.n = bits, n
        if ones_before is None:
            counts = np.bitwise_count(bits)
            counts = np.add.reduceat(counts.astype(np.uint32), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint32)
            ones_before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
        self.ones_before = ones_before
        self.zeros = n - int(ones_before[-1])

    def get(self, i: int) -> int:
        return (int(self.bits[i >> 3]) >> (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place i."""
        block, byte = i // BLOCK, i >> 3
        found = int(self.ones_before[block]) + int(np.bitwise_count(self.bits[block * (BLOCK // 8) : byte]).sum(dtype=np.int64))
        return found + (int(self.bits[byte] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit: search over blocks, then inside one."""
        low, high = 0, len(self.ones_before) - 1
        before = lambda b: int(self.ones_before[b]) if bit else min(b * BLOCK, self.n) - int(self.ones_before[b])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        inside = np.unpackbits(self.bits[low * (BLOCK // 8) : (low + 1) * (BLOCK // 8)], bitorder="little")[: self.n - low * BLOCK]
        return low * BLOCK + int(np.flatnonzero(inside == bit)[k - before(low)])


class WaveletMatrix:
    def __init__(self, alphabet: np.ndarray, planes: list[Plane], n: int):
        self.alphabet, self.planes, self.n = alphabet, planes, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, dtype=np.uint32)
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
        places = np.zeros(len(counts), np.uint32)
        places[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        wide = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        rest = places[ids].astype(np.uint16 if wide <= 16 else np.uint32) if len(ids) else ids
        planes = []
        for k in range(wide - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << k)) != 0
            planes.append(Plane(np.packbits(bit, bitorder="little"), len(rest)))
            if k:  # the order below the last plane is not needed
                parted = np.empty_like(rest)
                zeros = planes[-1].zeros
                parted[:zeros] = rest[np.flatnonzero(~bit)]
                parted[zeros:] = rest[np.flatnonzero(bit)]
                rest = parted
        return cls(alphabet, planes, len(ids))

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        rest = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane.bits, count=self.n, bitorder="little").view(bool)
            whole = np.empty_like(rest)
            whole[np.flatnonzero(~bit)] = rest[: plane.zeros]  # places are faster than masks here
            whole[np.flatnonzero(bit)] = rest[plane.zeros :] | rest.dtype.type(1 << level)
            rest = whole
        return self.alphabet[rest] if self.n else np.zeros(0, np.uint32)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = 0
        for plane in self.planes:
            bit = plane.get(i)
            place = place << 1 | bit
            i = plane.zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return int(self.alphabet[place])

    def _place(self, token: int) -> int | None:
        at = np.flatnonzero(self.alphabet == token)
        return int(at[0]) if len(at) else None

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        place = self._place(token)
        if place is None:
            return 0
        start, end = 0, i
        for level, plane in enumerate(self.planes):
            bit = place >> (len(self.planes) - 1 - level) & 1
            start, end = ((plane.zeros if bit else 0) + plane.rank(bit, x) for x in (start, end))
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place, start, path = self._place(token), 0, []
        for level, plane in enumerate(self.planes):
            bit = place >> (len(self.planes) - 1 - level) & 1
            start = (plane.zeros if bit else 0) + plane.rank(bit, start)
            path.append((plane, bit))
        at = start + k
        for plane, bit in reversed(path):
            at = plane.select(bit, at - (plane.zeros if bit else 0))
        return at


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The file image of documents in their order, with each one's number of ids."""
    matrix = WaveletMatrix.build(ids)
    known = np.array([i is not None for i in doc_ids], bool)
    sections = [
        np.packbits(known).tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.cumsum(np.array(counts, "<i8"), dtype="<i8").tobytes(),
        matrix.alphabet.astype("<u4").tobytes(),
    ]
    for plane in matrix.planes:
        sections += [plane.bits.tobytes(), plane.ones_before.astype("<u4").tobytes()]
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(x) for x in sections]
    header = json.dumps({"docs": len(doc_ids), "tokens": int(matrix.n), "planes": len(matrix.planes), "sections": [len(x) for x in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])


def open_shard(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc ids, the end of each document in the shard, and the matrix."""
    if image[:8] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack_from("<I", image, 8)
    header = json.loads(image[12 : 12 + size])
    at, sections, unpacker = 12 + size, [], zstandard.ZstdDecompressor()
    for length in header["sections"]:
        sections.append(unpacker.decompress(image[at : at + length]))
        at += length
    known = np.unpackbits(np.frombuffer(sections[0], np.uint8), count=header["docs"]).astype(bool)
    doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(sections[1], "<i8"), known, strict=True)]
    n = header["tokens"]
    planes = [Plane(np.frombuffer(sections[4 + 2 * k], np.uint8), n, np.frombuffer(sections[5 + 2 * k], "<u4")) for k in range(header["planes"])]
    return doc_ids, np.frombuffer(sections[2], "<i8"), WaveletMatrix(np.frombuffer(sections[3], "<u4"), planes, n)
