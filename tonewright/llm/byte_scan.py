"""Vectorised scanning of the bytes behind an Arrow column of texts: classes of bytes, runs of them, and their strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tonewright.llm.shared import byte_blocks

BLOCK_BYTES = 4_000_000
#: Bytes that are worked on at once where a byte takes eight: what is held does not grow with a text.
CHUNK_BYTES = 1 << 18
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = 0x9E3779B97F4A7C15


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 truth values."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


WORD_BYTES = ~byte_class(SPACE_BYTES)
CAPITALS = byte_class(bytes(range(0x41, 0x5B)))
#: Every byte of UTF-8 but those that continue a code point.
POINT_STARTS = ~byte_class(bytes(range(0x80, 0xC0)))
LOWERED = np.arange(256, dtype=np.uint8) + np.uint8(32) * CAPITALS


def text_bytes(texts: pa.Array, limit: int = BLOCK_BYTES):
    """Blocks of a column (null: empty): first and last row, the block's bytes, and where each text begins and the last ends."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if texts.type == pa.large_string() else np.int32
    for start, end in byte_blocks(texts, limit):
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset + start : texts.offset + end + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield start, end, data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a text: begins, ends, and how many runs lie before each text (and in all)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, offsets)


def run_strings(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as an Arrow array of strings."""
    offsets = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=offsets[1:])
    wide = offsets[-1] >= 2**31
    kind = pa.LargeStringArray if wide else pa.StringArray
    return kind.from_buffers(len(begins), pa.py_buffer(offsets if wide else offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[inside])))


def run_codes(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each run, equal for equal runs and no others, and the runs by number."""
    coded = run_strings(data, inside, begins, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums_by_text(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How many bytes of each class (three at most) a text has, a row a class: differences of one prefix sum with 21 bits a class."""
    packed = sum((t.astype(np.uint64) << np.uint64(21 * i) for i, t in enumerate(tables)), np.zeros(256, np.uint64))
    found = np.zeros((len(tables), len(offsets) - 1), np.int64)
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(data))
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(packed[data[a:b]], out=prefix[1:])
        lo, hi = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
        at = np.clip(offsets[lo : hi + 1], a, b) - a
        gone = prefix[at[1:]] - prefix[at[:-1]]
        for i in range(len(tables)):
            found[i, lo:hi] += (gone >> np.uint64(21 * i) & np.uint64((1 << 21) - 1)).astype(np.int64)
    return found


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    table = np.full(n, base & (2**64 - 1), np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def held_powers(base: int, n: int) -> np.ndarray:
    if (base, n) not in _POWERS:
        _POWERS[base, n] = powers(base, n)
    return _POWERS[base, n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A polynomial of its bytes for each run, modulo 2^64: a difference of prefix sums, carried back to power 0.

    Runs of over CHUNK_BYTES get a digest of their bytes instead.
    """
    found = np.zeros(len(begins), np.uint64)
    raised, lowered = held_powers(base, CHUNK_BYTES), held_powers(inverse(base), CHUNK_BYTES)
    at = 0
    while at < len(begins):
        start = int(begins[at])
        upto = int(np.searchsorted(ends, start + CHUNK_BYTES, side="right"))
        if upto == at:
            digest = hashlib.blake2b(data[start : int(ends[at])].tobytes(), digest_size=8).digest()
            found[at], at = int.from_bytes(digest, "little"), at + 1
            continue
        stop = int(ends[upto - 1])
        prefix = np.zeros(stop - start + 1, np.uint64)
        np.cumsum((data[start:stop].astype(np.uint64) + np.uint64(1)) * raised[: stop - start], out=prefix[1:])
        b, e = begins[at:upto] - start, ends[at:upto] - start
        found[at:upto] = (prefix[e] - prefix[b]) * lowered[b]
        at = upto
    return found


def same_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Are the bytes of runs `one` and `other` (numbers of runs) equal, pair by pair?"""
    lengths = ends[one] - begins[one]
    equal = lengths == ends[other] - begins[other]
    todo = np.flatnonzero(equal)
    done = np.cumsum(lengths[todo])
    at = 0
    while at < len(todo):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        part = todo[at:upto]
        if len(part) == 1:
            a, b, n = begins[one[part[0]]], begins[other[part[0]]], lengths[part[0]]
            equal[part[0]] = np.array_equal(data[a : a + n], data[b : b + n])
        else:
            sizes = lengths[part]
            first = np.zeros(len(part), np.int64)
            np.cumsum(sizes[:-1], out=first[1:])
            inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            unlike = data[np.repeat(begins[one[part]], sizes) + inner] != data[np.repeat(begins[other[part]], sizes) + inner]
            equal[part] = np.add.reduceat(unlike, first, dtype=np.int64) == 0
        at = upto
    return equal
