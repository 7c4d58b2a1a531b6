"""Vectorised text over Arrow buffers: words of many documents at once, as byte ranges and 64-bit hashes."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALL = (1 << 64) - 1
#: Masks that keep the first 0 to 8 bytes of a lane.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Byte ranges longer than this are hashed one by one.
LONG = 64


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    hash: np.ndarray  # uint64
    ptr: np.ndarray  # words of document d are ptr[d]:ptr[d + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(values: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; null counts as empty."""
    values = pc.fill_null(values, "")
    if lower:
        values = pc.utf8_lower(values)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number (little-endian); beyond the end they are 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes, equal hashes, wherever they stand, and another seed gives independent ones.

    Eight bytes at a time go through a bijection of 64 bits, so ranges of one length of up to 8 bytes never collide, and no
    structure of longer ones survives; ranges beyond LONG bytes are hashed by BLAKE2b."""
    x, size = lanes(data), (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0x9E3779B97F4A7C15 & ALL))
    out = mix(out ^ (x[start] & MASKS[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        out[live] = mix(out[live] ^ (x[start[live] + at] & MASKS[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=salt).digest(), "little")
    return out


def word_bytes(data: np.ndarray) -> np.ndarray:
    """True for bytes of words: ASCII letters, digits, underscore, and non-ASCII characters but for
    Latin-1 signs (U+0080 to U+00BF), general punctuation (U+2000 to U+207F) and CJK punctuation (U+3000 to U+303F)."""
    table = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
        table[lo:hi] = True
    out = table[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        lead = lead[lead + 2 < len(data) + (data[lead] == 0xC2)]
        first, second = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
        two = lead[first == 0xC2]
        three = lead[((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))]
        out[two] = out[two + 1] = False
        out[three] = out[three + 1] = out[three + 2] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of each document."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e.astype(np.uint64), np.zeros(len(offsets), np.int64))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_bytes(data)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    return Words(start, end, range_hash(data, start, end), np.searchsorted(start, offsets))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of counts[i] elements each, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each document, and their offsets by document. A document of 1 to k - 1 words has one shingle: all of them."""
    n = np.diff(w.ptr)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = ragged(w.ptr[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = size > j
        term = w.hash[np.minimum(at + j, len(w.hash) - 1)] if len(w.hash) else out
        out += np.where(here, term, np.uint64(7)) * np.uint64((0xA0761D6478BD642F * (2 * j + 1)) & ((1 << 64) - 1))
        out = np.bitwise_xor(out, out >> np.uint64(29)) if j % 2 else out
    return mix(out), np.concatenate([[0], np.cumsum(count)])
