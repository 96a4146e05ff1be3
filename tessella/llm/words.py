"""Words of texts as numpy arrays: positions, identities, 64-bit hashes and n-gram hashes, without a Python object per word.

A word's identity has 128 bits. Up to 15 bytes it is the word itself with its length; longer words have a keyed BLAKE2b digest. So no
text can be made whose different words are taken for one another; what compares identities compares words. The 64-bit
hash mixes both halves: it deals rows out and finds candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are taken at once; longer texts are cut between words.
BLOCK = 1 << 18
#: Bytes of a word that is its own identity.
SHORT = 15
_SEED = np.random.default_rng(20240229)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], U)
#: Odd factors of the words of an n-gram, two for each.
FACTORS = _SEED.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
FACTORS_2 = _SEED.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def _table(separators: list[tuple[int, int]], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    for lo, hi in separators:
        word[lo:hi + 1] = False
    code = np.arange(256)
    if lower:
        code[65:91] += 32
    return word, code.astype(np.uint8)


#: Words are runs without white space; A-Z count as a-z.
LOWER = _table([(0x20, 0x20), (0x09, 0x0D)], True)
#: The same with letters unchanged.
EXACT = _table([(0x20, 0x20), (0x09, 0x0D)], False)
#: Words are runs of ASCII letters, digits and all other characters beyond ASCII; A-Z count as a-z (its separators hold A-Z, which are lower-cased first).
LETTERS = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], True)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some documents, one after another. ``first[i]:first[i + 1]`` are those of document ``i``; start and end are bytes in its text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    #: Hash of each word's first bytes, if asked for.
    head: np.ndarray | None = None
    #: Both halves of each word's identity, if asked for.
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Words from each to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def identities(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the identities of the words ``code[start:start + size]``; sizes are 1 at least. The highest byte is the length up to ``SHORT``, or 255."""
    padded = np.concatenate([code, np.zeros(16, np.uint8)])
    lanes = np.ndarray(len(code) + 8, "<u8", padded, 0, (1,))
    low = lanes[start] & _MASK[np.minimum(size, 8)]
    high = np.minimum(size, SHORT).astype(U) << U(56)
    more = np.flatnonzero(size > 8)
    if len(more):
        high[more] |= lanes[start[more] + 8] & _MASK[np.minimum(size[more] - 8, 7)]
    for i in np.flatnonzero(size > SHORT).tolist():
        d = hashlib.blake2b(padded[start[i]:start[i] + size[i]].tobytes(), digest_size=16, key=b"words").digest()
        low[i], high[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 255 << 56
    return low, high


def hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(mix(low + U(0x9E3779B97F4A7C15)) ^ (high * U(0xD6E8FEB86659FD93)))


def _block(b: np.ndarray, cuts: np.ndarray, table, head: int, identity: bool) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes, hashes of the heads and identities of the words of ``b``; no word goes across an offset in ``cuts``."""
    word, code = table
    mask = word[b]
    st, en = mask.copy(), mask.copy()
    st[1:] &= ~mask[:-1]
    en[:-1] &= ~mask[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    st[cuts] = mask[cuts]
    en[cuts - 1] = mask[cuts - 1]
    start, end = np.flatnonzero(st), np.flatnonzero(en) + 1
    if not len(start):
        return start, end, *[np.empty(0, U)] * 4
    low, high = identities(code[b], start, end - start)
    heads = np.empty(0, U)
    if head:
        n = np.minimum(end - start, head)
        first = identities(code[b], start, n) if head > 8 else (np.ndarray(len(b), "<u8", np.concatenate([code[b], np.zeros(8, np.uint8)]), 0, (1,))[start] & _MASK[n], n.astype(U))
        heads = mix(hashed(*first) ^ U(0xA5A5A5A5A5A5A5A5))
    return start, end, hashed(low, high), heads, *((low, high) if identity else [np.empty(0, U)] * 2)


def words_of(data: np.ndarray, offsets: np.ndarray, table, head: int = 0, identity: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes); with ``head``, their first so many bytes hashed too; with ``identity``, their identities as well."""
    word = table[0]
    at, stop_at = int(offsets[0]), int(offsets[-1])
    parts = []
    while at < stop_at:
        to = min(at + BLOCK, stop_at)
        if to < stop_at and word[data[to - 1]] and word[data[to]] and to not in offsets[np.searchsorted(offsets, to):][:1]:
            back = np.flatnonzero(~word[data[at:to]])
            low = offsets[np.searchsorted(offsets, to, "left") - 1]  # a document's begin is a boundary as well
            if len(back) or low > at:
                to = max(at + int(back[-1]) + 1 if len(back) else at, int(low))
            else:
                ahead, span = to, BLOCK
                while ahead < stop_at and word[data[ahead]]:
                    stop = np.flatnonzero(~word[data[ahead:ahead + span]])
                    ahead = ahead + int(stop[0]) if len(stop) else min(stop_at, ahead + span)
                to = ahead
                nxt = offsets[np.searchsorted(offsets, at, "right")]
                to = min(to, int(nxt)) if nxt > at else to
        lo, hi = np.searchsorted(offsets, at, "left"), np.searchsorted(offsets, to, "right")
        s, e, *rest = _block(data[at:to], np.asarray(offsets[lo:hi]) - at, table, head, identity)
        parts.append((s + at, e + at, *rest))
        at = to
    if not parts:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, U)] * 4)]
    start, end, h, heads, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    first = np.searchsorted(start, offsets, "left")
    base = np.repeat(offsets[:-1], np.diff(first))
    return Words(h, start - base, end - base, first, heads if head else None, *((low, high) if identity else ()))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1] if off and n else np.zeros(n + 1, np.int64)
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)), offsets


def spans(offsets: np.ndarray, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def ngrams(h: np.ndarray, n: int, factors: np.ndarray = FACTORS) -> np.ndarray:
    """Hashes of the n-grams that begin at each word, over document ends too: take those with ``left() >= n``."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U)
    for j in range(n):
        out += h[j:j + m] * factors[j]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column whose row ``i`` is ``values[first[i]:first[i + 1]]``."""
    values = np.ascontiguousarray(values)
    k = values.dtype.itemsize
    if first[-1] * k > 2**31 - 1:
        raise ValueError("more than 2 GB in a batch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * k).astype(np.int32)), pa.py_buffer(values)])


def bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]]).astype(np.int64)
