"""Language-model scores by deleted interpolation: n-gram estimates mixed by context-frequency bucket."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, buffers, distinct, mix, numbered, regrouped, words
from .exchange import HOME, PACKED, block_of, gather, numbered_blocks, pack_batch, pack_numbers, row, rows_of, shard_count, shards_of, unpack_batch, unpack_numbers
from .session import prepare

BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
TOTALS = -(1 << 63)  # the block number under which shards report their totals
FOLDS, HELD_OUT, DELETED = 10, 0, 1
STEPS = 4  # histogram bins per octave


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end per text, hashes of the tokens before them, token offsets)."""
    data, offsets = buffers(column)
    _, _, hashes, by_doc = words(data, offsets, SPACED)
    tokens = np.insert(hashes, by_doc[1:], END)
    bounds = by_doc + np.arange(len(by_doc))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def key_pairs(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unigrams (odd) and bigrams (even); a text's begin counts as often as its end."""
    one = mix(tokens) | U64(1)
    two = mix(mix(before) * U64(0x9E3779B97F4A7C15) + tokens) & ~U64(1)
    return one, two


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one for each power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def learn_weights(histogram: dict[tuple[int, int, int], int], floor: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights (buckets, 3) of bigram, unigram and uniform estimates by expectation-maximisation.

    histogram counts held-out tokens by (bucket, bin of the deleted bigram estimate, bin of the deleted unigram
    estimate); bin 0 is an estimate of 0, bin k one of 2 ** (-(k - 1) / STEPS). A bucket that no token fell in
    takes the weights of the one below; an unseen context has no bigram weight.
    """
    weights = np.tile([0.0, 0.9, 0.1], (65, 1))
    estimate = lambda k: np.where(k > 0, 2.0 ** (-(k - 1) / STEPS), 0.0)
    last = np.array([0.3, 0.6, 0.1])
    for b in range(65):
        rows = np.array([(k2, k1, n) for (bucket, k2, k1), n in histogram.items() if bucket == b], np.int64).reshape(-1, 3)
        now = last.copy() if b else np.array([0.0, 0.9, 0.1])
        if len(rows):
            p = np.stack([estimate(rows[:, 0]), estimate(rows[:, 1]), np.full(len(rows), floor)], 1)
            if b == 0:
                p[:, 0] = 0
            for _ in range(rounds):
                share = p * now
                share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
                now = (share * rows[:, 2:]).sum(0) / rows[:, 2].sum()
            now = 0.999999 * now + 1e-6 * np.array([0.0, 0.0, 1.0])  # what was never held out stays possible
            now /= now.sum()
        weights[b] = now
        last = now if b else last
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts are words ``[^\\x20\\x09-\\x0D]+`` (A-Z folded) and one end; null is empty, which is an end alone. The model
    learns from rows whose crc32(id as text) mod 10 is not 0 (a null id counts as empty text). base_score is the
    smoothed unigram log10 probability; score is the deleted interpolation's: bigram and unigram maximum
    likelihood and uniform, weighted by the bucket (power of two) of the context's count. The weights are learned
    on fold 1, each token's own occurrence deleted from the counts. Unknown words get the uniform share.
    Repeated rows each count and each get a row; an empty table gives an empty result; other columns are ignored.

    Plan: blocks of documents send their distinct unigrams and bigrams with counts to shards by hash; shards add
    them up and reply; blocks score their own texts. Each key moves once a block and no count is dropped.
    """
    prepare(docs.sparkSession)
    n = shard_count(docs[text_col], docs)
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.spark_partition_id().alias("part")).withColumn("fold", (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % FOLDS).cast("int"))

    def split(batches: Iterable[pa.RecordBatch], requests: bool, deleted: bool) -> Iterator[pa.RecordBatch]:
        for number, batch in numbered_blocks(regrouped(batches, "text", block_bytes)):
            tokens, before, bounds = sequence(batch.column("text"))
            one, two = key_pairs(tokens, before)
            if requests and not deleted:
                train = np.repeat(batch.column("fold").to_numpy() != HELD_OUT, np.diff(bounds))
                keys = np.concatenate([one, two])
                keys, _, which = numbered(keys)
                count = np.bincount(which[np.concatenate([train, train])], minlength=len(keys))
            else:
                keys = distinct(np.concatenate([one, two]))
                count = np.zeros(len(keys), np.int64)
            block = block_of(number, keys)
            block = ~block if deleted else block
            if not requests:
                yield row(block, HOME, pack_batch(batch.replace_schema_metadata({"keys": str(len(keys))})))
                continue
            shard = shards_of(keys, n)
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                gaps = np.diff(keys[a:b], prepend=U64(0))
                packed = pack_numbers(gaps[1:]), pack_numbers(count[a:b])
                yield row(block, int(shard[a]), len(packed[0]).to_bytes(8, "little") + int(gaps[0]).to_bytes(8, "little") + b"".join(packed))

    def answer(payloads: list[bytes]) -> list[bytes]:
        keys, counts = [], []
        for p in payloads:
            size = int.from_bytes(p[:8], "little")
            keys.append(np.cumsum(np.append(U64(int.from_bytes(p[8:16], "little")), unpack_numbers(p[16 : 16 + size])), dtype=U64))
            counts.append(unpack_numbers(p[16 + size :]))
        cuts = np.cumsum([0, *map(len, keys)])
        known, _, which = numbered(np.concatenate(keys))
        total = np.bincount(which, weights=np.concatenate(counts).astype(np.float64), minlength=len(known)).astype(np.int64)
        one = (known & U64(1)) == 1
        answer.totals = pack_numbers(np.array([total[one].sum(), (total[one] > 0).sum()], U64))
        return [pack_numbers(total[which[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]

    def reduce_totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(rows_of(batches), key=lambda r: (r[1], r[0]))
        for shard in sorted({r[1] for r in got}):
            mine = [r for r in got if r[1] == shard]
            for (block, _, _), reply in zip(mine, answer([r[2] for r in mine])):
                yield row(block, shard, reply)
            yield row(TOTALS, shard, answer.totals)

    dev = own.where(F.col("fold") == DELETED)
    asked = own.mapInArrow(lambda b: split(b, True, False), PACKED).unionByName(dev.mapInArrow(lambda b: split(b, True, True), PACKED))
    replies = asked.repartitionById(n, asked["shard"]).mapInArrow(reduce_totals, PACKED).checkpoint()
    totals = [unpack_numbers(r.payload) for r in replies.where(F.col("block") == TOTALS).collect()]
    n_train, vocabulary = (int(sum(int(t[i]) for t in totals)) for i in (0, 1))
    uniform = 1 / (vocabulary + 1)

    def counted(home: bytes, answers: list[bytes]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        batch = unpack_batch(home)
        count = np.concatenate([np.zeros(0, U64), *map(unpack_numbers, answers)]).astype(np.int64)
        tokens, before, bounds = sequence(batch.column("text"))
        one, two = key_pairs(tokens, before)
        keys = distinct(np.concatenate([one, two]))
        if len(count) != len(keys):
            raise RuntimeError("a block lacks replies: the input changed between two scans")
        c1, c2 = count[np.searchsorted(keys, one)], count[np.searchsorted(keys, two)]
        end = count[np.searchsorted(keys, mix(np.array([END])) | U64(1))]
        ch = np.empty_like(c1)
        ch[1:] = c1[:-1]
        ch[bounds[:-1]] = end
        return batch, bounds, c1, c2, ch

    def bins(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))) + 1, 0).astype(np.int64)

    def held_out(home: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, _, c1, c2, ch = counted(home, answers)
        k2 = bins((c2 - 1) / np.maximum(ch - 1, 1))
        k1 = bins((c1 - 1) / max(n_train - 1, 1))
        key, _, which = numbered((bucket_of(ch - 1) << 40 | k2 << 20 | k1).astype(U64))
        key = key.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key >> 40), pa.array(key >> 20 & 0xFFFFF), pa.array(key & 0xFFFFF), pa.array(np.bincount(which, minlength=len(key)))], names=["b", "k2", "k1", "n"])

    seen = gather(dev.mapInArrow(lambda b: split(b, False, True), PACKED).unionByName(replies.where(f"block < 0 and block <> {TOTALS}")), n, held_out, "b long, k2 long, k1 long, n long")
    histogram = {(r.b, r.k2, r.k1): r.n for r in seen.groupBy("b", "k2", "k1").agg(F.sum("n").alias("n")).collect()}  # at most 65 x 250 x 250 bins
    weights = learn_weights(histogram, uniform)

    def finish(home: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        batch, bounds, c1, c2, ch = counted(home, answers)
        w = weights[bucket_of(ch)]
        p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(n_train, 1) + w[:, 2] * uniform
        base = np.log10((c1 + 0.1) / (n_train + 0.1 * (vocabulary + 1)))
        per = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else x
        fold = batch.column("fold").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(fold == HELD_OUT), pa.array(np.diff(bounds)), pa.array(per((c1 > 0).astype(np.int64))), pa.array(np.full(len(fold), n_train)), pa.array(per(base)), pa.array(per(np.log10(p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    parts = own.mapInArrow(lambda b: split(b, False, False), PACKED).unionByName(replies.where("block >= 0"))
    return gather(parts, n, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
