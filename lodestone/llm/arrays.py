"""Vectorised text primitives shared by the Arrow-batched operators.

Texts arrive as Arrow string columns. Everything here works on their UTF-8 (or UTF-32) buffers with
numpy, a bounded piece at a time, so that no per-word Python object is ever made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 20  # bytes of text handled by one numpy pass
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 steps), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_power = np.ones(1, U64)
_inverse = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        out = []
        for base in (_BASE, _INV):
            p = np.full(max(n, PIECE + 4096), base, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _power, _inverse = out
    return _power[:n], _inverse[:n]


def byte_class(separators: Iterable[int], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, hash value) for every byte; fold hashes A-Z as a-z."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    value = _BYTE.copy()
    if fold:
        value[65:91] = value[97:123]
    return word, value


#: words [^\x20\x09-\x0D]+ and words of letters, digits and everything beyond ASCII
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def bounded(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Sub-batches of at most ``most`` bytes of text and ``rows`` rows; a longer single text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            before = total[at - 1] if at else 0
            to = int(np.searchsorted(total, before + most, side="right"))
            to = min(max(to, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def regrouped(batches: Iterable[pa.RecordBatch], text: str, most: int, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, joined from smaller ones and cut from larger ones."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in bounded(batches, text, most, rows):
        own = int(pc.sum(pc.binary_length(batch.column(text))).as_py() or 0)
        if held and (size + own > most or count + batch.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, count = [], 0, 0
        held.append(batch)
        size, count = size + own, count + batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls being empty."""
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(large), b"" if large == pa.large_binary() else "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of every word and (len(offsets),) word offsets by document."""
    is_word, value = kind
    starts, ends, hashes = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not edge[to] and is_word[data[to - 1]] and is_word[data[to]]:
            gap = np.flatnonzero(~is_word[data[to : to + PIECE]] | edge[to : min(to + PIECE, len(data))])
            to = to + int(gap[0]) if len(gap) else min(len(data), to + PIECE)
        part = data[at:to]
        inside = is_word[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[at + 1 : to]
        last[:-1] &= ~inside[1:] | edge[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(value[part] * power[:-1], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position on (document edges are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, 0x632BE59BD9B4E019 + k & (1 << 64) - 1, U64)
    for j in range(k):
        out += hashes[j : j + n]
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; sorts in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values ascending, first index of each, number of each item's value)."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def owner(offsets: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, ascending, as 52-bit hashes, with their offsets.

    A document of fewer than k words has its whole sequence as one shingle; one without words has none.
    At most 4096 documents a call: their number fills the upper 12 bits while sorting.
    """
    count, n = np.diff(offsets), len(offsets) - 1
    assert n <= 4096
    gram = grams(hashes, k)
    doc = owner(offsets)
    whole = np.zeros(len(doc), bool)
    if len(gram):
        whole[: len(gram)] = doc[: len(gram)] == doc[k - 1 :]
    keys = [doc[whole].astype(U64) << U64(52) | gram[whole[: len(gram)]] >> U64(12)]
    for d in np.flatnonzero((count > 0) & (count < k)):
        own = hashes[offsets[d] : offsets[d + 1]]
        keys.append(U64(d) << U64(52) | grams(own, len(own)) >> U64(12))
    key = distinct(np.concatenate(keys))
    return key & U64((1 << 52) - 1), np.searchsorted(key >> U64(52), np.arange(n + 1, dtype=U64))


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of given lengths: (run of each item, index of each item in its run)."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - begin[run]


def crc_bucket(ids: pa.Array, n: int) -> np.ndarray:
    """crc32 of each id's decimal text mod n (null ids: crc32 of the empty text)."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % n for i in ids.to_pylist()], np.int64)
