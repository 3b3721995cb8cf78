"""Token counts: pieces are counted once for each distinct pre-token and joined to documents' frequencies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import bounded, numbered, owner
from .exchange import HOME, PACKED, ask, block_of, gather, numbered_blocks, pack_batch, pack_numbers, row, shard_count, shards_of, unpack_batch, unpack_numbers
from .pretokens import Pieces, pretokens, split_specials, strings
from .session import prepare

LIMIT = 512


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text, for a byte-level BPE of the tokenizers library.

    Special strings inside a text count as their one token, as is the library's default. A null or empty
    text has 0 bytes and 0 tokens. Repeated rows and null ids give a row each; other columns are ignored;
    an empty table gives an empty result.

    Plan: each block of documents keeps (pre-token, frequency) pairs of its documents and sends its distinct
    pre-tokens to shards by hash; a shard counts the pieces of each distinct pre-token once; the counts come
    back and are summed by document. No ids are made and no text is shuffled. The input is scanned twice, for
    frequencies and for requests, which costs less than storing either.
    """
    prepare(docs.sparkSession)
    n = shard_count(docs[text_col], docs)

    def split(batches: Iterable[pa.RecordBatch], requests: bool) -> Iterator[pa.RecordBatch]:
        for number_, batch in numbered_blocks(bounded(batches, "text", block_bytes)):
            texts, doc, front, _ = split_specials(batch.column("text"), tokenizer_path)
            points, cut, hashes, offsets = pretokens(texts)
            keys, first, number = numbered(hashes)
            block = block_of(number_, keys)
            if requests:
                shard = shards_of(keys, n)
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else shard
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                    own = pa.array(strings(points, cut, first[a:b]), pa.string())
                    yield row(block, int(shard[a]), pack_batch(pa.RecordBatch.from_arrays([own], names=["key"])))
                continue
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            special = np.bincount(doc[front >= 0], minlength=batch.num_rows)
            pair = np.sort(doc[owner(offsets)] * len(keys) + number) if len(keys) else number
            new = np.ones(len(pair), bool)
            new[1:] = pair[1:] != pair[:-1]
            times = np.diff(np.append(np.flatnonzero(new), len(pair)))
            pair = pair[new]
            bounds = np.searchsorted(pair, np.arange(batch.num_rows + 1) * max(len(keys), 1))
            used = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pair % max(len(keys), 1), pa.int32()))
            often = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times, pa.int32()))
            yield row(block, HOME, pack_batch(pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(special, pa.int64()), used, often], names=["id", "size", "special", "used", "often"]).replace_schema_metadata({"keys": str(len(keys))})))

    def answer(payloads: list[bytes]) -> list[bytes]:
        pieces = Pieces(tokenizer_path)
        lists = [unpack_batch(p).column(0) for p in payloads]
        coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        count = np.fromiter((len(pieces.ids(k)) for k in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        values = count[coded.indices.to_numpy()]
        cuts = np.cumsum([0, *map(len, lists)])
        return [pack_numbers(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def finish(home: bytes, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        own = unpack_batch(home)
        count = np.concatenate([np.zeros(0, np.uint64), *map(unpack_numbers, replies)]).astype(np.int64)
        if len(count) != int(own.schema.metadata[b"keys"]):
            raise RuntimeError("a block lacks replies: the input changed between two scans")
        used, often = own.column("used"), own.column("often")
        sums = np.concatenate([[0], np.cumsum(count[used.values.to_numpy()] * often.values.to_numpy())])
        bounds = used.offsets.to_numpy()
        tokens = sums[bounds[1:]] - sums[bounds[:-1]] + own.column("special").to_numpy()
        yield pa.RecordBatch.from_arrays([own.column("id"), own.column("size").cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.spark_partition_id().alias("part"))
    replies = ask(own.mapInArrow(lambda b: split(b, True), PACKED), n, answer)
    return gather(own.mapInArrow(lambda b: split(b, False), PACKED).unionByName(replies), n, finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
