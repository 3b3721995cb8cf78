"""Token-id output in bit- or byte-plane shuffled, zstandard-compressed chunks with a chunk index.

File format (little-endian; one file holds consecutive documents in ascending id order)::

    b"PLNS" | u8 version | u8 planes (4 byte planes or 32 bit planes) | chunks ... | index | u64 length of index | b"SNLP"

A chunk is a block of up to CHUNK ids as u32, transposed into planes; each plane is one zstandard frame.
The index is JSON: per chunk its offset, number of ids, crc32 of its ids and the lengths of its planes, and
the documents' ids and lengths as zstandard frames of little-endian i64 (a bitmap marks null ids).
"""

from __future__ import annotations

import base64
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import bounded, numbered
from .pretokens import Pieces, pretokens, split_specials
from .session import prepare, shared_folder, shuffle_partitions

CHUNK = 1 << 16
FILE_IDS = 1 << 22
HEAD, TAIL = b"PLNS\x01", b"SNLP"


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], 1)).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in parts], 1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).reshape(-1).view("<u4")


def encode_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: list, planes: int = 4) -> bytes:
    out, at, chunks = [HEAD + bytes([planes])], len(HEAD) + 1, []
    for i in range(0, len(ids), CHUNK):
        part = np.ascontiguousarray(ids[i : i + CHUNK], "<u4")
        frames = [zstandard.compress(p, 3) for p in to_planes(part, planes)]
        chunks.append([at, len(part), zlib.crc32(part.tobytes()), [len(f) for f in frames]])
        out += frames
        at += sum(map(len, frames))
    frame = lambda x: base64.b64encode(zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)).decode()
    index = {
        "chunks": chunks,
        "docs": len(lengths),
        "lengths": frame(np.asarray(lengths, "<i8")),
        "ids": frame(np.array([0 if d is None else d for d in doc_ids], "<i8")),
        "null": frame(np.packbits(np.array([d is None for d in doc_ids], bool))),
    }
    tail = json.dumps(index).encode()
    return b"".join([*out, tail, len(tail).to_bytes(8, "little"), TAIL])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, length of each document, document ids); raises if the file isn't whole."""
    if data[:5] != HEAD or data[-4:] != TAIL:
        raise ValueError("not a plane file, or cut off")
    length = int.from_bytes(data[-12:-4], "little")
    index = json.loads(data[-12 - length : -12])
    ids = [np.zeros(0, "<u4")]
    for at, n, crc, sizes in index["chunks"]:
        parts = []
        for size in sizes:
            parts.append(zstandard.decompress(data[at : at + size]))
            at += size
        ids.append(from_planes(parts, n))
        if zlib.crc32(ids[-1].tobytes()) != crc:
            raise ValueError("a chunk's checksum differs")
    frame = lambda k, kind: np.frombuffer(zstandard.decompress(base64.b64decode(index[k])), kind)
    null = np.unpackbits(frame("null", np.uint8))[: index["docs"]].astype(bool)
    return np.concatenate(ids), frame("lengths", "<i8"), [None if z else d for d, z in zip(frame("ids", "<i8").tolist(), null)]


def encode_texts(column: pa.Array, pieces: Pieces, tokenizer_path: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of each text's ids): the library's pieces of each distinct pre-token, laid out by text."""
    texts, doc, front, first = split_specials(column, tokenizer_path)
    points, cut, hashes, offsets = pretokens(texts)
    keys, at, number = numbered(hashes)
    found = pieces.batch(keys, points, cut, at)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    size = sizes[number]
    to = np.cumsum(size)
    body = flat[np.repeat(begin[number] - to + size, size) + np.arange(int(size.sum()))]
    bounds = np.concatenate([[0], to])[offsets]
    per = np.bincount(doc, weights=np.diff(bounds) + (front >= 0), minlength=len(column)).astype(np.int64)
    where, values = [bounds[:-1][front >= 0]], [front[front >= 0]]
    if end is not None:
        last = np.append(doc[1:] != doc[:-1], True)
        where.append(bounds[1:][last])
        values.append(np.full(last.sum(), end))
        per += 1
    where, values = np.concatenate(where), np.concatenate(values)
    # at one place a document's end id comes before the special that opens the next segment only by text order
    rank = np.concatenate([2 * np.flatnonzero(front >= 0), 2 * np.flatnonzero(last) + 1]) if end is not None else np.flatnonzero(front >= 0)
    order = np.argsort(rank, kind="stable")
    return np.insert(body, where[order], values[order].astype(np.uint32)), per


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_token_ids(docs: DataFrame, tokenizer_path: str, folder: str, end: int | None = 0, planes: int = 4, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Writes ids in ascending id order (nulls first, ties by a hash of the text, then the text) and returns the manifest: path, start, n_docs, n_ids.

    Rows are range-partitioned and sorted by id; a task writes files of about FILE_IDS ids under names of its
    own attempt and reports them, so a task that is run again can't spoil what another wrote; only files in the
    manifest count. A null text is empty; rows that repeat an id each get their ids; an empty table writes no
    file. The manifest has a row for a file and is all that reaches the driver.
    """
    spark = prepare(docs.sparkSession)
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        pieces = Pieces(tokenizer_path)
        task = TaskContext.get()
        ids, lengths, names, total, k = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, names, total, k
            path = f"{root}/{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.planes"
            with system.open_output_stream(path) as f:
                f.write(encode_file(np.concatenate(ids), np.concatenate(lengths), names, planes))
            out = pa.RecordBatch.from_pydict({"part": [task.partitionId()], "k": [k], "file": [os.path.basename(path)], "n_docs": [len(names)], "n_ids": [total]}, schema=schema)
            ids, lengths, names, total, k = [], [], [], 0, k + 1
            return out

        for batch in bounded(batches, "text"):
            own, size = encode_texts(batch.column("text"), pieces, tokenizer_path, end)
            ids.append(own)
            lengths.append(size)
            names += batch.column("id").to_pylist()
            total += len(own)
            if total >= FILE_IDS:
                yield flush()
        if names:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    own = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("text"))
    n = n_files or shuffle_partitions(spark)
    files = own.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie", "text").mapInArrow(write, "part int, k int, file string, n_docs long, n_ids long").collect()
    start, rows = 0, []
    for f in sorted(files, key=lambda f: (f.part, f.k)):
        rows.append((f.file, start, f.n_docs, f.n_ids))
        start += f.n_ids
    return spark.createDataFrame(rows, "file string, start long, n_docs long, n_ids long")


def read_token_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    spark = manifest.sparkSession
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start in zip(b.column("content"), b.column("start").to_pylist()):
                ids, lengths, names = decode_file(data.as_py())
                to = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (t - n) : 4 * t]) for t, n in zip(to.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + to - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not manifest.take(1):
        return spark.createDataFrame([], kind)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest.select("file", "start"), "file").select("start", "content").mapInArrow(read, kind)


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int | None = 0, planes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids (see write_token_ids) and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/planes-{uuid.uuid4().hex}"
    return read_token_ids(write_token_ids(docs, tokenizer_path, folder, end, planes, id_col, text_col), folder)
