"""Asking a distributed table about a block's distinct keys, and getting the answers back in order.

A *block* is a few megabytes of documents. Its distinct keys go out in packed rows, one for each shard; the reducer of a shard sees every block's request, answers each distinct key once, and
replies with values in the request's order, so keys travel once and hot keys weigh one entry
a block, however many rows hold them. Shards are cut by key hash, hence even; no key is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .session import shuffle_partitions

PACKED = "block long, shard int, payload binary"
SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
HOME = -1  # the shard number of what a block keeps for itself


def block_ids() -> Iterator[int]:
    """Numbers that are unique over tasks, the same when a task is run again."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def numbered_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with numbers from their column ``part`` (spark_partition_id(), which a union doesn't shift) and their order in it."""
    for i, batch in enumerate(batches):
        yield (batch.column("part")[0].as_py() << 32) + i, batch


def block_of(number: int, keys: np.ndarray) -> int:
    """A block's id, from its number and its keys: scans that cut other blocks would find no replies, not wrong ones."""
    return int(mix(np.array([number], np.uint64) + np.sum(keys, dtype=np.uint64))[0] >> np.uint64(1))


def row(block: int, shard: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], schema=SCHEMA)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes under zstandard: small ones cost about a byte."""
    wide = np.ascontiguousarray(x, np.uint64)
    planes = wide.view(np.uint8).reshape(-1, 8)
    used = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return len(wide).to_bytes(8, "little") + bytes([used]) + zstandard.compress(np.ascontiguousarray(planes[:, :used].T).tobytes(), 1)


def unpack_numbers(payload: bytes) -> np.ndarray:
    n, used = int.from_bytes(payload[:8], "little"), payload[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(zstandard.decompress(payload[9:]), np.uint8).reshape(used, n).T
    return out.reshape(-1).view(np.uint64)


def shards_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shard of each key by the upper 32 bits of its hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        yield from zip(b.column("block").to_pylist(), b.column("shard").to_pylist(), b.column("payload").to_pylist())


SHARD_BYTES = 48 << 20  # of text for which there is one shard at least


def shard_count(texts: Column, docs: DataFrame) -> int:
    """How many shards the texts need for each to stay small, whatever the input's size: one pass adds up their bytes."""
    size = docs.agg(F.sum(F.octet_length(texts).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def ask(requests: DataFrame, n_shards: int, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Replies to requests; answer sees all of one shard's payloads and returns one reply for each."""

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(rows_of(batches))
        if got:
            got.sort(key=lambda r: r[:2])
            for shard in sorted({r[1] for r in got}):
                own = [r for r in got if r[1] == shard]
                for (block, _, _), reply in zip(own, answer([r[2] for r in own])):
                    yield row(block, shard, reply)

    return requests.repartitionById(n_shards, requests["shard"]).mapInArrow(reduce, PACKED)


def gather(parts: DataFrame, n: int, finish: Callable[[bytes, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """finish gets what a block kept for itself and its replies by shard; parts holds the rows of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, replies = None, None, []
        # a block without its own row means that two scans of one input cut it differently
        for block, shard, payload in rows_of(batches):
            if block != now:
                if now is not None:
                    if home is None:
                        raise RuntimeError("replies for a block that isn't there: the input changed between two scans")
                    yield from finish(home, replies)
                now, home, replies = block, None, []
            if shard == HOME:
                home = payload
            else:
                replies.append(payload)
        if now is not None:
            yield from finish(home, replies)

    return parts.repartition(n, "block").sortWithinPartitions("block", "shard").mapInArrow(run, schema)
