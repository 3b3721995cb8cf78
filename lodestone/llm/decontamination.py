"""Benchmark decontamination by winnowing: shared fingerprints are seeds, and seeds are extended to whole shared spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, U64, bounded, buffers, distinct, grams, mix, owner, words
from .exchange import block_ids
from .session import free, located, prepare, shuffle_partitions

WINDOW, GRAM = 13, 5  # a window of 9 five-grams spans 13 words, so every shared run of 13 words shares a fingerprint
MOST_BROADCAST = 2_000_000  # fingerprints; 16 MB


def fingerprints(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions of the k-grams whose hash is least in some window of words that lies in one document (all of a tie)."""
    width = window - gram + 1
    gram_hash = grams(hashes, gram)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = gram_hash[:n].copy()
    for s in range(1, width):
        np.minimum(least, gram_hash[s : s + n], out=least)
    inside = doc[:n] == doc[window - 1 :]
    chosen = np.zeros(len(gram_hash), bool)
    for s in range(width):
        chosen[s : s + n] |= inside & (gram_hash[s : s + n] == least)
    return np.flatnonzero(chosen)


def keyed(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of fingerprints (length 0) or of whole short items of a length, kept apart."""
    return mix(hashes ^ U64(length << 56))


def seeds(hashes: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of a batch's fingerprints and, for each given length, of all its runs of that length."""
    doc = owner(offsets)
    at = fingerprints(hashes, doc, window, gram)
    where, keys = [at], [keyed(grams(hashes, gram)[at], 0)]
    for length in lengths:
        run = grams(hashes, length)
        at = np.flatnonzero(doc[: len(run)] == doc[length - 1 :]) if len(run) else np.zeros(0, np.int64)
        where.append(at)
        keys.append(keyed(run[at], length))
    return np.concatenate(where), np.concatenate(keys)


def spans(text: np.ndarray, item: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which words of a text lie in an occurrence of one of the item's windows; both given as word hashes."""
    hit = np.zeros(len(text) + 1, np.int64)
    need = min(window, len(item))
    if len(item) < window:
        run = grams(text, need)
        at = np.flatnonzero(run == grams(item, need)[0]) if len(run) else np.zeros(0, np.int64)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + need, -1)
        return np.cumsum(hit)[:-1] > 0
    sides = []
    for x in (text, item):
        at = fingerprints(x, np.zeros(len(x), np.int64), window, gram)
        sides.append((at, grams(x, gram)[at]))
    (p, ph), (q, qh) = sides
    order = np.argsort(qh, kind="stable")
    q, qh = q[order], qh[order]
    lo, hi = np.searchsorted(qh, ph, "left"), np.searchsorted(qh, ph, "right")
    p, lo, count = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    step = 200_000
    ends = np.cumsum(count)
    for a in range(0, int(ends[-1]) if len(ends) else 0, step):
        flat = np.arange(a, min(a + step, int(ends[-1])))
        own = np.searchsorted(ends, flat, "right")
        i, j = p[own], q[lo[own] + flat - (ends[own] - count[own])]
        left, right = i.copy(), i + gram
        live = np.arange(len(i))
        while len(live):
            l, m = left[live] - 1, left[live] - 1 - i[live] + j[live]
            ok = (l >= 0) & (m >= 0)
            ok[ok] = text[l[ok]] == item[m[ok]]
            live = live[ok]
            left[live] -= 1
        live = np.arange(len(i))
        while len(live):
            r, m = right[live], right[live] - i[live] + j[live]
            ok = (r < len(text)) & (m < len(item))
            ok[ok] = text[r[ok]] == item[m[ok]]
            live = live[ok]
            right[live] += 1
        long = right - left >= window
        np.add.at(hit, left[long], 1)
        np.add.at(hit, right[long], -1)
    return np.cumsum(hit)[:-1] > 0


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    _, _, hashes, by_doc = words(data, offsets, ALNUM)
    return hashes, by_doc


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_broadcast: int = MOST_BROADCAST, id_type: str = "long") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (the sorted ids, as text) of every document.

    Words are runs of letters, digits and signs beyond ASCII, A-Z folded. An item's windows are its runs of
    ``window`` words; an item of fewer words, but not none, is one window. Words of a document inside any
    occurrence of a window are hit; a document with at least ``percent`` percent of its words hit is
    contaminated. Null and empty texts have no words; items without an id or words are no items; items that
    repeat an id count once; every document row gets a row, whether or not its id repeats or is null.

    Plan: one pass winnows each text and keeps the fingerprints that the benchmark has too (by a broadcast of
    the benchmark's fingerprints if they number at most ``most_broadcast``, otherwise all go to the join);
    fingerprints join to items; only documents that share one meet those items' texts, where seeds are
    extended word by word in both directions to whole shared spans.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")).where("item is not null and text is not null")

    def fingerprint_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            hashes, offsets = word_hashes(batch.column("text"))
            count = np.diff(offsets)
            at, key = seeds(hashes, offsets, (), window, gram)
            number = owner(offsets)[at]
            length = np.zeros(len(at), np.int64)
            for d in np.flatnonzero((count > 0) & (count < window)):
                number, length = np.append(number, d), np.append(length, count[d])
                key = np.append(key, keyed(grams(hashes[offsets[d] : offsets[d + 1]], int(count[d])), int(count[d])))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(number)), pa.array(key.view(np.int64)), pa.array(length)], names=["item", "key", "length"])

    known = items.mapInArrow(fingerprint_items, "item string, key long, length long").distinct().checkpoint()
    lengths = tuple(sorted(r.length for r in known.select("length").where("length > 0").distinct().collect()))
    keys = known.select("key").distinct()
    table = np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64)) if known.count() <= most_broadcast else None
    shipped = spark.sparkContext.broadcast(table)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, zip_ = block_ids(), zstandard.ZstdCompressor(3).compress
        table = shipped.value
        for batch in bounded(batches, "text"):
            hashes, offsets = word_hashes(batch.column("text"))
            at, key = seeds(hashes, offsets, lengths, window, gram)
            if table is not None:
                found = table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key if len(table) else np.zeros(len(key), bool)
                at, key = at[found], key[found]
            number = owner(offsets)[at]
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for d in np.unique(number):
                lists[d] = distinct(key[number == d]).view(np.int64).tolist()
            text = batch.column("text")
            kept = [zip_(text[d].as_py().encode()) if own else None for d, own in enumerate(lists)]
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers) for _ in lists]), batch.column("id"), pa.array(np.diff(offsets)), pa.array(lists, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["rid", "id", "n_words", "keys", "z"])

    scanned = docs.select(docs[id_col].cast(id_type).alias("id"), docs[text_col].alias("text")).mapInArrow(scan, f"rid long, id {id_type}, n_words long, keys array<long>, z binary").checkpoint()
    hits = scanned.select("rid", F.explode("keys").alias("key")).join(known.select("key", "item"), "key").select("rid", "item").distinct()
    parts = scanned.where("z is not null").select("rid", "id", F.lit("").alias("item"), F.lit(True).alias("own"), F.col("z").alias("payload")).unionByName(
        hits.join(items, "item").select("rid", F.lit(None).cast(id_type).alias("id"), "item", F.lit(False).alias("own"), F.encode("text", "utf-8").alias("payload"))
    )

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        now = text = hit = None
        found: set[str] = set()

        def result() -> pa.RecordBatch:
            names = sorted(found)
            n, k = len(text), int(hit.sum())
            return pa.RecordBatch.from_pydict({"doc_id": [now[1]], "n_words": [n], "n_hit": [k], "n_items": [len(names)], "items_sha256": [hashlib.sha256(",".join(names).encode()).hexdigest()], "contaminated": [k > 0 and 100 * k >= percent * n], "items": [names]}, schema=kind)

        for batch in batches:
            for rid, id_, item, own, payload in zip(*(batch.column(c).to_pylist() for c in ("rid", "id", "item", "own", "payload"))):
                if own:
                    if now is not None:
                        yield result()
                    now, found = (rid, id_), set()
                    text = word_hashes(pa.array([unzip(payload)], pa.large_binary()))[0]
                    hit = np.zeros(len(text), bool)
                else:
                    other = word_hashes(pa.array([payload], pa.large_binary()))[0]
                    covered = spans(text, other, window, gram) if len(other) else hit[:0]
                    if covered.any():
                        hit |= covered
                        found.add(item)
        if now is not None:
            yield result()

    kind = pa.schema([("doc_id", pa.int64() if id_type == "long" else pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])
    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    touched = parts.repartition(shuffle_partitions(spark), "rid").sortWithinPartitions("rid", F.desc("own")).mapInArrow(extend, schema)
    clean = scanned.where("z is null").select(
        F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(hashlib.sha256(b"").hexdigest()).alias("items_sha256"), F.lit(False).alias("contaminated"), F.array().cast("array<string>").alias("items")
    )
    return clean.unionByName(touched)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that have no word inside an occurrence of a benchmark window; each row is judged by itself, columns stay as they are."""
    prepare(docs.sparkSession)
    placed, file, at = located(docs)
    key = free("__key", placed.columns)
    placed = placed.withColumn(key, F.concat_ws(":", file, at))
    gone = decontaminate(placed, benchmark, window, gram, id_col=key, text_col=text_col, item_col=item_col, item_text_col=item_text_col, id_type="string").where("n_hit > 0")
    return placed.join(gone.select(F.col("doc_id").alias(key)), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
