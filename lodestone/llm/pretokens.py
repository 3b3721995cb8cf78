"""Byte-level BPE pre-tokens of whole batches, found with numpy instead of a regular expression engine.

The pattern is the public one of the byte-level BPE tokenizers: English contractions, then runs of
letters, of numbers and of other signs, each with one space before it, then white space of which the
last sign is left to what follows. A special token's string is a pre-token of its own that ends the
text before it, as the tokenizers library treats it by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .arrays import U64, _powers, buffers, mix

LETTER, NUMBER, SPACE, OTHER = range(4)
#: White space by the Unicode property of that name, and the pattern's contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@cache
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.load(open(path))["added_tokens"]}


@cache
def letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; edge marks the first of each text."""
    n = len(points)
    kind = classes()[points]
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:]
    begin = change.copy()
    at = np.flatnonzero(change)
    to = np.append(at[1:], n)
    ends_text = np.append(edge[to[:-1]], True)
    white = (kind[at] == SPACE) & ~ends_text
    last = to[white] - 1
    begin[last] = True
    joins = points[last] == 0x20
    begin[to[white][joins]] = False
    alone = (kind[at] == OTHER) & (to - at == 1) & ~ends_text
    mark = at[alone & begin[at]]
    mark = mark[points[mark] == ord("'")]
    if len(mark):
        def char(i):
            out = np.where(i < n, points[np.minimum(i, n - 1)], 0)
            for step in range(1, 3):
                out = np.where((i - step >= mark) & (i - step + 1 < n) & edge[np.minimum(i - step + 1, n - 1)], 0, out)
            return out

        one, two = char(mark + 1), char(mark + 2)
        for c in CONTRACTIONS:
            hit = one == ord(c[1])
            if len(c) == 3:
                hit &= two == ord(c[2])
            where = mark[hit]
            begin[where + 1] = False
            after = where + len(c)
            after = after[after < n]
            begin[after] |= (kind[after] == LETTER) & ~edge[after]
    return begin


def split_specials(column: pa.Array, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, document of each, special id in front of it or -1, whether it is the document's first)."""
    column = column.fill_null("")
    n = len(column)
    table = specials(path)
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))) if table else None
    where = np.zeros(n, bool)
    if pattern:
        import pyarrow.compute as pc

        for s in table:
            where |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
    if not where.any():
        return column, np.arange(n), np.full(n, -1), np.ones(n, bool)
    texts, doc, front, first = [], [], [], []
    for i, text in enumerate(column.to_pylist()):
        at, special = 0, -1
        first.append(True)
        for m in pattern.finditer(text) if where[i] else ():
            texts.append(text[at : m.start()])
            doc.append(i)
            front.append(special)
            first.append(False)
            at, special = m.end(), table[m[0]]
        texts.append(text[at:])
        doc.append(i)
        front.append(special)
    return pa.array(texts, pa.large_string()), np.array(doc), np.array(front), np.array(first)


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start of each pre-token and the end of the last, 64-bit hashes, pre-token offsets by text)."""
    data, offsets = buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    bounds = heads[offsets]
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    at = np.flatnonzero(starts(points, edge[:-1])) if len(points) else np.zeros(0, np.int64)
    cut = np.append(at, len(points))
    hashes = np.empty(len(at), U64)
    step = 1 << 16
    for i in range(0, len(at), step):
        a, b = cut[i], cut[min(i + step, len(at))]
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(mix(points[a:b].astype(U64) + U64(0x51ED27)) * power[:-1], out=sums[1:])
        s, e = cut[i : i + step][: len(at) - i] - a, cut[i + 1 : i + step + 1] - a
        hashes[i : i + step] = mix((sums[e] - sums[s]) * inverse[s])
    return points, cut, hashes, np.searchsorted(at, bounds)


def strings(points: np.ndarray, cut: np.ndarray, which: np.ndarray) -> list[str]:
    raw = points.tobytes()
    return [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(cut[which].tolist(), cut[which + 1].tolist())]


class Pieces:
    """Piece ids of single pre-tokens by the library's model, kept for the most recent ones."""

    def __init__(self, path: str, most: int = 300_000):
        self.model, self.most = tokenizer(path).model, most
        self.known: dict[int, tuple[int, ...]] = {}
        self.table = {b: c for b, c in enumerate(letters())}

    def ids(self, text: str) -> list[int]:
        shown = text.encode("utf-8").decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(shown)]

    def batch(self, hashes: np.ndarray, points: np.ndarray, cut: np.ndarray, which: np.ndarray) -> list[tuple[int, ...]]:
        known = self.known
        found = [known.get(h) for h in hashes.tolist()]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(known) + len(missing) > self.most:
            known.clear()
        for i, text in zip(missing, strings(points, cut, which[missing] if missing else which[:0])):
            found[i] = known[int(hashes[i])] = tuple(self.ids(text))
        return found
