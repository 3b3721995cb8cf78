"""Quality scores learned from preference pairs (Bradley-Terry): logistic loss on feature differences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, bounded, buffers, grams, mix, numbered, owner, words
from .session import prepare, shuffle_partitions

NODES = 32  # grid nodes a unit of score, on which scores of pairs are compared
STEPS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.02)  # lengths tried along a direction, in one pass
HASHED = 256
BYTE_GROUPS = ("lower", "upper", "digit", "space", "line", "mark", "high", "other")


def _group_table() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[97:123], table[65:91], table[48:58], table[[0x20, 0x09]], table[[0x0A, 0x0D]] = 0, 1, 2, 3, 4
    table[[ord(c) for c in ".,;:'\"!?-()"]] = 5
    table[0x80:] = 6
    return table


GROUPS = _group_table()


def features(column: pa.Array) -> np.ndarray:
    """Shape of each whole text: shares of byte groups and of single signs, word lengths, repetition of words, pairs and lines, and hashed word counts."""
    data, offsets = buffers(column)
    n = len(column)
    size = np.diff(offsets)
    out = []

    def per(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    group = GROUPS[data]
    whole = np.maximum(size, 1)
    out += [per(group == g) / whole for g in range(8)]
    out += [per(data == ord(c)) / whole for c in "|#$%&*!?.,@/={}<>_+"]
    out.append(np.log1p(size))
    start, end, hashes, by_doc = words(data, offsets, SPACED)
    count = np.diff(by_doc)
    doc = owner(by_doc)
    length = (end - start).astype(float)
    mean = np.bincount(doc, weights=length, minlength=n) / np.maximum(count, 1)
    square = np.bincount(doc, weights=length**2, minlength=n) / np.maximum(count, 1)
    out += [np.log1p(count), mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, np.bincount(doc, weights=length <= 2, minlength=n) / np.maximum(count, 1), np.bincount(doc, weights=length > 20, minlength=n) / np.maximum(count, 1)]
    odd = np.zeros(len(data) + 1)
    np.cumsum((group >= 5) & (group != 6), out=odd[1:])
    out.append(np.bincount(doc, weights=(odd[end] - odd[start]) >= 0.5 * length, minlength=n) / np.maximum(count, 1))
    for k in (1, 2, 3):
        g = hashes if k == 1 else grams(hashes, k)
        inside = np.ones(len(g), bool) if k == 1 else doc[: len(g)] == doc[k - 1 :]
        d = doc[: len(g)][inside]
        key = d.astype(U64) << U64(52) | g[inside] >> U64(12)
        values, _, which = numbered(key)
        times = np.bincount(which, minlength=len(values))
        own = (values >> U64(52)).astype(np.int64)
        total = np.maximum(np.bincount(d, minlength=n), 1)
        out.append(np.bincount(own, minlength=n) / total)
        out.append(np.bincount(own, weights=times.astype(float) ** 2, minlength=n) / total**1.5)
        most = np.zeros(n)
        np.maximum.at(most, own, times)
        out.append(most / total)
    breaks = np.flatnonzero(data == 0x0A)
    line_doc = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(line_doc, minlength=n) + 1.0
    out += [np.log1p(lines), np.log1p(size / lines)]
    line_class = np.zeros(256, bool)
    line_class[0x0A] = True
    _, _, line_hash, by_line = words(data, offsets, (~line_class, mix(np.arange(1, 257, dtype=U64))))
    d = owner(by_line)
    values = numbered(d.astype(U64) << U64(52) | line_hash >> U64(12))[0]
    out.append(np.bincount((values >> U64(52)).astype(np.int64), minlength=n) / np.maximum(np.diff(by_line), 1))
    slots = (mix(hashes) >> U64(64 - HASHED.bit_length() + 1)).astype(np.int64)
    bag = np.bincount(doc * HASHED + slots, minlength=n * HASHED).reshape(n, HASHED)
    return np.concatenate([np.stack(out, 1), np.sqrt(bag / np.maximum(count, 1)[:, None])], 1)


def standardised(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features around their middle, and how far those of the shape are out."""
    z = np.clip((x - middle) / scale, -6, 6)
    return np.concatenate([z, np.maximum(np.abs(z[:, :-HASHED]) - 2, 0)], 1)


@dataclass
class Ranker:
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standardised(x, self.middle, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold stands where the quantile cut the raw scores."""
        odds = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + odds, -40, 40)))


Part = tuple[int, np.ndarray, np.ndarray]  # what is summed, at which places, the values there


def merged(parts: Iterable[Part]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places of each sum, ascending, and the sums there."""
    by: dict[int, list[Part]] = {}
    for part in parts:
        by.setdefault(part[0], []).append(part)
    out = {}
    for what, own in by.items():
        at, which = np.unique(np.concatenate([p[1] for p in own]), return_inverse=True)
        out[what] = at, np.bincount(which, weights=np.concatenate([p[2] for p in own]), minlength=len(at))
    return out


def totals(blocks: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], list[Part]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums over every row of blocks of what measure(features, times labelled 1, times labelled 0) gives; a task sends one row a sum."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for x, good, bad in zip(*(batch.column(c) for c in ("x", "good", "bad"))):
                weights = [np.frombuffer(w.as_buffer(), np.int64) for w in (good, bad)]
                own = measure(np.frombuffer(x.as_buffer(), np.float32).reshape(len(weights[0]), -1), *weights)
                so_far = merged([(what, at, value) for what, (at, value) in so_far.items()] + own)
        for what, (at, value) in so_far.items():
            yield pa.RecordBatch.from_arrays([pa.array([what], pa.int32()), pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], names=["what", "at", "value"])

    got = blocks.mapInArrow(add, "what int, at binary, value binary").toArrow()
    return merged((what, np.frombuffer(at, np.int64), np.frombuffer(value)) for what, at, value in zip(*(got.column(c).to_pylist() for c in ("what", "at", "value"))))


def on_nodes(s: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (twice the node, and 1 for label 0) and weights of scores, each shared by the two nodes around it."""
    low = np.floor(s * NODES)
    up, node = s * NODES - low, 2 * low.astype(np.int64)
    at, weight = np.concatenate([node, node + 2, node + 1, node + 3]), np.concatenate([good * (1 - up), good * up, bad * (1 - up), bad * up])
    return at[weight > 0], weight[weight > 0]


def met(at: np.ndarray, weight: np.ndarray) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Every document of label 1 against every one of label 0, from their weights on nodes.

    The mean of -log sigmoid(s(a) - s(b)) over all pairs, the first node, and for each node on the mean chance that a
    document of label 1 there loses, and that one of label 0 there wins (both divided by the count of their own label).
    """
    first = int(at.min() >> 1)
    n = int(at.max() >> 1) - first + 1
    mass = np.zeros((2, n))
    np.add.at(mass, (at & 1, (at >> 1) - first), weight)
    mass /= mass.sum(1, keepdims=True)
    size = 1 << (3 * n).bit_length()
    ahead = np.arange(1 - n, n) / NODES

    def against(kernel: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(kernel, size) * np.fft.rfft(other, size), size)[n - 1 : 2 * n - 1]

    loses = 1 / (1 + np.exp(np.clip(ahead, -700, 700)))
    loss = float(mass[0] @ against(np.logaddexp(0, -ahead), mass[1]))
    return loss, first, against(loses, mass[1]), against(loses[::-1], mass[0])


def learn(blocks: DataFrame, threshold: float = 0.3, rounds: int = 100, ridge: float = 3e-4, tolerance: float = 1e-4) -> Ranker:
    """Scores s with P(a before b) = sigmoid(s(a) - s(b)) from all pairs of a document of label 1 and one of label 0.

    Every row of blocks counts in each sum. Scores are summed up on a grid by label, so that each document meets
    all of the other label without pairs being listed; interpolation on it errs by (1 / NODES)^2 / 8 of the loss's
    curvature. L-BFGS with two passes a round (slopes, then the losses of all STEPS) until the slope is shorter than
    ``tolerance``, when the mean loss is within tolerance^2 / (2 ridge) of its least, or five rounds lower the loss by
    less than a thousandth of it; ``rounds`` is the most there are.
    The cut is a quantile of the scores: where the balanced accuracy over all rows is greatest. With one label
    only, every document is on that label's side.
    """

    def moments(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[Part]:
        wide, weight = x.astype(np.float64), (good + bad).astype(np.float64)
        place = np.arange(x.shape[1])
        return [(0, np.arange(2), np.array([good.sum(), bad.sum()], np.float64)), (1, place, weight @ wide), (2, place, weight @ wide**2)]

    width = features(pa.array([""], pa.large_string())).shape[1]
    first = totals(blocks, moments)
    good_rows, bad_rows = first[0][1] if first else (0.0, 0.0)
    n = good_rows + bad_rows
    middle, scale = (first[1][1] / n, np.sqrt(np.maximum(first[2][1] / n - (first[1][1] / n) ** 2, 0)) + 1e-3) if n else (np.zeros(width), np.ones(width))
    size = 2 * width - HASHED
    base = Ranker(middle, scale, np.zeros(size), 0.0, 1.0, threshold)
    if not good_rows or not bad_rows:
        base.cut = -1.0 if good_rows else 1.0
        return base
    around = middle.astype(np.float32), scale.astype(np.float32)

    def slopes(w: np.ndarray, at: int, lost: np.ndarray, won: np.ndarray) -> Callable[..., list[Part]]:
        def measure(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[Part]:
            z = standardised(x, *around)
            s = (z @ w.astype(np.float32)).astype(np.float64)
            node = np.arange(at, at + len(lost)) / NODES
            pull = bad / bad_rows * np.interp(s, node, won) - good / good_rows * np.interp(s, node, lost)
            return [(0, np.arange(size), (pull.astype(np.float32) @ z).astype(np.float64)), (1, np.arange(2), np.array([(good + bad) @ s, (good + bad) @ s**2]))]

        return measure

    def ahead(w: np.ndarray, way: np.ndarray) -> Callable[..., list[Part]]:
        def measure(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[Part]:
            z = standardised(x, *around)
            return [(i, *on_nodes((z @ (w + step * way).astype(np.float32)).astype(np.float64), good, bad)) for i, step in enumerate(STEPS)]

        return measure

    w = np.zeros(size)
    loss, *table = met(*on_nodes(np.zeros(2), np.array([good_rows, 0.0]), np.array([0.0, bad_rows])))
    past: list[tuple[np.ndarray, np.ndarray]] = []
    before, fallen = None, [loss]
    for t in range(rounds + 1):
        got = totals(blocks, slopes(w, *table))
        slope, (mean, square) = got[0][1] + ridge * w, got[1][1] / n
        if before is not None and (w - before[0]) @ (slope - before[1]) > 0:
            past = [*past[-9:], (w - before[0], slope - before[1])]
        if t == rounds or np.linalg.norm(slope) < tolerance or (t >= 5 and fallen[-1] > 0.999 * fallen[-6]):
            break
        way, shares = -slope, []
        for moved, bent in reversed(past):
            shares.append((moved @ way) / (moved @ bent))
            way = way - shares[-1] * bent
        for (moved, bent), share in zip(past, reversed(shares)):
            way = way + moved * (share - (bent @ way) / (moved @ bent))
        tried = totals(blocks, ahead(w, way))
        tables = [met(*tried[i]) for i in range(len(STEPS))]
        losses = [m[0] + ridge / 2 * np.sum((w + step * way) ** 2) for m, step in zip(tables, STEPS)]
        best = int(np.argmin(losses))
        if losses[best] >= fallen[-1]:
            break
        fallen.append(losses[best])
        before = w, slope
        w, (_, *table) = w + STEPS[best] * way, tables[best]
    base.weights = w
    deviation = float(np.sqrt(max(square - mean**2, 0)))
    bin_width = max(deviation, 1e-6) / 256

    def counted(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[Part]:
        place = 2 * np.floor(base.raw(x.astype(np.float64)) / bin_width).astype(np.int64)
        return [(0, np.concatenate([place[good > 0], place[bad > 0] + 1]), np.concatenate([good[good > 0], bad[bad > 0]]).astype(np.float64))]

    at, count = totals(blocks, counted)[0]
    place, which = np.unique(at >> 1, return_inverse=True)
    # the share of a label's rows in bins before each bin; cuts stand in the middle between two bins that hold rows
    of = [np.bincount(which[at & 1 == label], weights=count[at & 1 == label], minlength=len(place)) for label in (0, 1)]
    lower_good, lower_bad = ((np.cumsum(c) - c) / c.sum() for c in of)
    right = lower_bad + 1 - lower_good
    edges = np.concatenate([place[:1], (place[:-1] + 1 + place[1:]) / 2]) * bin_width
    best = np.flatnonzero(right >= right.max() - 1e-9)
    base.cut = float(edges[best[len(best) // 2]])
    base.slope = float(4 / (deviation + 1e-6))
    return base


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row, from its whole text.

    Learns from every row whose crc32(id as text) mod folds is not ``held_out`` and whose label is 0 or 1: labels and
    texts meet in a shuffle by id, and the features of labelled texts stay in the checkpoint folder, where each pass
    reads them. Null texts count as empty and get a score; nulls in labels are not learned from; of an id that is
    labelled several times, each labelling counts. Without labels every score is on the good side. Rows that repeat an id or have none
    (crc32 of the empty text) each get a row; an empty table gives an empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    own = own.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held_out)
    known = labels.select(labels[id_col].cast("long").alias("l"), labels[label_col].cast("int").alias("label")).where("l is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("l").cast("string")) % folds != held_out)
    n = shuffle_partitions(spark)
    # sorted, so that reruns add in one order; ids labelled often are one row with its counts
    known = known.groupBy("l").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    texts = own.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("doc_id", "text").repartition(n, "doc_id").sortWithinPartitions("doc_id", "text")
    joined = texts.join(known.hint("merge"), F.col("doc_id") == F.col("l")).select("text", "good", "bad")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            x, good, bad = features(batch.column("text")).astype(np.float32), *(batch.column(c).to_numpy() for c in ("good", "bad"))
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (x, good, bad)], names=["x", "good", "bad"])

    blocks = joined.mapInArrow(measure, "x binary, good binary, bad binary").checkpoint()
    shipped = spark.sparkContext.broadcast(learn(blocks.coalesce(4 * spark.sparkContext.defaultParallelism), threshold))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            s = shipped.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
