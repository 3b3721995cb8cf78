"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, bounded, buffers, mix, numbered, owner, shingle_sets, spread, words
from .components import components
from .session import kept, located, prepare, shuffle_partitions

SLOTS, ROWS = 160, 5  # 32 bands of 5: a pair at similarity 0.8 shares no band with probability below 4e-6
MAX_ROUNDS = 6
TILE, TILE_SHINGLES = 3000, 1_500_000  # rows and shingles of a cluster that one task holds


def superminhash(keys: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents, slots): for each slot the least (rank, random) over a set's elements.

    Every element visits the slots in the order of its own random permutation; at rank j it offers j plus a
    fraction. A set stops after the first rank at which all its slots are filled, since later ranks only
    offer more. Ranks run in step over many sets, which gives the same signature as element by element.
    """
    n = len(offsets) - 1
    out = np.full(n * slots, np.iinfo(U64).max, U64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 50_000, side="right")) - 1)
        seed = mix(keys[offsets[at] : offsets[to]] + U64(0x5BD1E995))
        doc = owner(offsets[at : to + 1])
        order = np.empty((min(len(seed), 50_000), slots), np.uint8)
        for first in range(0, len(seed), 50_000):  # only a single longer set takes several turns
            live = np.arange(first, min(first + 50_000, len(seed)))
            order[:] = np.arange(slots, dtype=np.uint8)
            for rank in range(slots):
                random = mix(seed[live] + U64((2 * rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                pick = rank + ((random & U64(0xFFFFFF)) * U64(slots - rank) >> U64(24)).astype(np.int64)
                slot = order[live - first, pick]
                order[live - first, pick] = order[live - first, rank]
                np.minimum.at(out, (doc[live] + at) * slots + slot, U64(rank << 40) | random >> U64(24))
                full = out.reshape(n, slots)[at:to].max(1) < U64((rank + 1) << 40)
                live = live[~full[doc[live]]]
                if not len(live):
                    break
        at = to
    return out.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = signatures.shape
    parts = signatures[:, : slots // rows * rows].reshape(n, -1, rows)
    key = np.broadcast_to(mix(np.arange(1, parts.shape[1] + 1, dtype=U64) * U64(0xA0761D6478BD642F)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ parts[:, :, j]) + U64(j)
    return key.view(np.int64)


def groups(batches: Iterable[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that are sorted by the long columns ``by``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1)))
        for at, to in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            mark = tuple(marks[at].tolist())
            if held and mark != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = mark
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    _, _, hashes, by_doc = words(data, offsets, SPACED)
    return shingle_sets(hashes, by_doc, shingle)


def packed_sets(z: pa.Array, shingle: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of compressed texts, a few texts at a time."""
    unzip = zstandard.ZstdDecompressor().decompress
    parts = [text_sets(pa.array([unzip(x.as_buffer()) for x in z.slice(at, step)], pa.large_binary()), shingle) for at in range(0, len(z), step)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])


def unite(keys: np.ndarray, offsets: np.ndarray, label: np.ndarray, percent: int, pivots: np.ndarray) -> np.ndarray:
    """Labels after every pivot has been set against all sets of another label, on whole sets.

    Intersections come from postings: a pivot's keys name the sets that hold them. Their number is at most that
    of all keys, so a pivot costs no more than a look at every set.
    """
    sizes, m = np.diff(offsets), len(offsets) - 1
    _, _, number = numbered(keys)
    holder = owner(offsets)[np.argsort(number, kind="stable")]
    count = np.bincount(number)
    begin = np.cumsum(count) - count
    for i in pivots.tolist():
        other = label != label[i]
        if not other.any():
            break
        k = number[offsets[i] : offsets[i + 1]]
        run, at = spread(count[k])
        both = np.bincount(holder[begin[k][run] + at], minlength=m)
        linked = other & (100 * both >= percent * (sizes + sizes[i] - both))
        if linked.any():
            label[np.isin(label, label[linked])] = label[i]
    return label


def settle(batches: Iterable[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(row, root) of the rows of whole clusters that have a link; root is the least row that links reach."""
    for group in groups(batches, ("cluster",)):
        row = np.sort(group.column("row").to_numpy())
        group = group.take(pa.array(np.argsort(group.column("row").to_numpy())))
        keys, offsets = packed_sets(group.column("z"), shingle)
        _, first, number = numbered(unite(keys, offsets, np.arange(len(row)), percent, np.arange(len(row))))
        linked = np.bincount(number)[number] > 1
        yield pa.RecordBatch.from_arrays([pa.array(row[linked]), pa.array(row[first][number][linked])], names=["row", "root"])


def against_pivots(batches: Iterable[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of rows to the pivot that comes first in their (pivot, salt) group, on whole sets."""
    for group in groups(batches, ("pivot", "salt")):
        group = group.take(pa.array(np.argsort(group.column("member").to_numpy(), kind="stable")))
        u, v = [], []
        (pivot, _), first = packed_sets(group.column("z").slice(0, 1), shingle), group.column("row")[0].as_py()
        for at in range(1, group.num_rows, 64):
            part = group.slice(at, 64)
            keys, offsets = packed_sets(part.column("z"), shingle)
            hit = np.concatenate([[0], np.cumsum(np.isin(keys, pivot, assume_unique=False))])
            both, sizes = hit[offsets[1:]] - hit[offsets[:-1]], np.diff(offsets)
            ok = 100 * both >= percent * (sizes + len(pivot) - both)
            u += part.column("row").to_numpy()[ok].tolist()
            v += [first] * int(ok.sum())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def across_tiles(batches: Iterable[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) between the roots of a left tile's rows and of a right tile's, on whole sets."""
    for group in groups(batches, ("cluster", "a", "b")):
        roots, left = group.column("root").to_numpy(), group.column("left").to_numpy(zero_copy_only=False)
        keys, offsets = packed_sets(group.column("z"), shingle)
        own, first, label = numbered(roots)
        after = unite(keys, offsets, label, percent, np.flatnonzero(left))[first]
        moved = after != np.arange(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[after[moved]])], names=["u", "v"])


def sign(batches: Iterable[pa.RecordBatch], shingle: int, slots: int, rows: int) -> Iterator[pa.RecordBatch]:
    names = ["row", "file", "at", "id"]
    for batch in bounded(batches, "text"):
        keys, offsets = text_sets(batch.column("text"), shingle)
        sizes = np.diff(offsets)
        sums = []
        for salt in (0x1F83D9AB, 0x5BE0CD19):
            total = np.zeros(len(keys) + 1, U64)
            np.cumsum(mix(keys ^ U64(salt << 20)), out=total[1:])
            sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
        bands = band_keys(superminhash(keys, offsets, slots), rows)
        some = np.where(sizes > 0, bands.shape[1], 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]), pa.int32()), pa.array(bands[sizes > 0].reshape(-1)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), lists], names=[*names, "n", "a", "b", "bands"])


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        z = [zip_(b"" if t is None else t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), pa.array(z, pa.binary())], names=["file", "at", "z"])


def large_links(texts: DataFrame, placed: DataFrame, shingle: int, percent: int, tile: int, tile_shingles: int) -> DataFrame:
    """(row, root) of the linked rows of clusters that are too large for a task: pivots first, then tiles.

    texts: row, cluster, n and z of the clusters' rows; placed: key and row of their buckets. In each round every
    bucket that holds several components names a pivot, and every row meets the pivot that most of its buckets
    name; a pivot's text goes out once for some 1,000 rows. Rounds go on while they unite rows. Then the rows
    outside a cluster's largest component meet all of the cluster's rows, tile by tile.
    """
    spark = texts.sparkSession
    n_parts = shuffle_partitions(spark)
    plain = texts.select("row", "cluster", "n")
    buckets = placed.join(plain, "row").select("key", "row", "n")
    ranked = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    degree = ranked.groupBy("row").agg(F.sum("size").alias("degree"))
    buckets = buckets.join(degree, "row").select("key", "row", "n", "degree").checkpoint()
    edges = spark.createDataFrame([], "u long, v long")
    now = buckets.withColumn("root", F.col("row"))
    for turn in range(MAX_ROUNDS):
        first = -F.col("degree") if turn == 0 else F.xxhash64("row", F.lit(turn))
        named = now.groupBy("key").agg(F.min(F.struct(first.alias("p"), F.col("row").alias("pivot"), F.col("n").alias("pn"), F.col("root").alias("proot"))).alias("x")).select("key", "x.pivot", "x.pn", "x.proot")
        meets = now.join(named, "key").where(f"root <> proot and 100 * least(n, pn) >= {percent} * greatest(n, pn)").groupBy("row", "pivot").agg(F.count(F.lit(1)).alias("times"))
        meets = meets.groupBy("row").agg(F.max(F.struct("times", "pivot")).alias("x")).select("row", "x.pivot").checkpoint()
        salts = meets.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("long").alias("salts"))
        members = meets.join(salts, "pivot").join(texts, "row").select("pivot", F.pmod(F.xxhash64("row"), "salts").alias("salt"), F.lit(1).alias("member"), "row", "z")
        heads = salts.join(texts, F.col("pivot") == F.col("row")).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), "row", "z")
        together = members.unionByName(heads).repartition(n_parts, "pivot", "salt").sortWithinPartitions("pivot", "salt")
        found = together.mapInArrow(lambda b: against_pivots(b, shingle, percent), "u long, v long").checkpoint()
        if not found.take(1):
            break
        edges = edges.unionByName(found)
        now = buckets.join(components(edges), F.col("row") == F.col("node"), "left").select("key", "row", "n", "degree", F.coalesce("root", "row").alias("root"))
        open_ = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        now = now.join(open_, "key", "left_semi").checkpoint()
    roots = components(edges).checkpoint()
    rooted = plain.join(roots, F.col("row") == F.col("node"), "left").select("row", "cluster", "n", F.coalesce("root", "row").alias("root")).checkpoint()
    top = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("x")).select("cluster", F.col("x.root").alias("top"))
    sided = rooted.join(top, "cluster").withColumn("out", (F.col("root") != F.col("top")).cast("int"))
    tiles = lambda rows, shingles: F.ceil(F.greatest(rows / tile, shingles / tile_shingles)).cast("long")
    counts = sided.groupBy("cluster").agg(tiles(F.sum("out"), F.sum(F.col("out") * F.col("n"))).alias("lefts"), tiles(F.count(F.lit(1)), F.sum("n")).alias("rights")).where("lefts > 0")
    spots = sided.join(counts, "cluster")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = spots.where("out = 1").select("row", "root", "cluster", F.pmod(F.xxhash64("row"), "lefts").alias("a"), upto("rights").alias("b"), F.lit(True).alias("left"))
    right = spots.select("row", "root", "cluster", upto("lefts").alias("a"), F.pmod(F.xxhash64("row"), "rights").alias("b"), F.lit(False).alias("left"))
    dealt = left.unionByName(right).join(texts.select("row", "z"), "row").repartition(n_parts, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    more = dealt.mapInArrow(lambda b: across_tiles(b, shingle, percent), "u long, v long")
    return components(edges.unionByName(more)).select(F.col("node").alias("row"), "root")


def linked(docs: DataFrame, shingle: int, percent: int, slots: int, rows: int, tile: int, tile_shingles: int, null_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(row, file, at, id, n of every row of docs; row, root of the rows that have a link, but for roots).

    docs has file and at (where a row lies), id and text. Rows are numbered once; root is the least row that links
    reach. A row of null id links only if ``null_ids``.
    """
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    signed = (
        docs.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(lambda b: sign(b, shingle, slots, rows), "row long, file long, at long, id long, n long, a long, b long, bands array<long>")
        .checkpoint()
    )
    some = signed.where("n > 0" if null_ids else "n > 0 and id is not null")
    classes = kept(some.groupBy("a", "b", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b", "n", "rep"))  # so that the join has exchanges of its own, which split where one set is very common
    copies = kept(some.select("a", "b", "n", "row").join(classes, ["a", "b", "n"]).where("row <> rep").select("row", "rep"))

    entries = some.select(F.explode("bands").alias("key"), "row", "a")
    busy = entries.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("key")
    placed = kept(entries.select("key", "row").join(busy, "key").join(copies.select("row"), "row", "left_anti").select("key", "row"))
    lead = kept(placed.groupBy("key").agg(F.min("row").alias("lead")))
    clusters = components(placed.join(lead, "key").select(F.col("row").alias("u"), F.col("lead").alias("v"))).select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    roster = kept(some.select("row", "file", "at", "n").join(clusters, "row"))
    sizes = roster.groupBy("cluster").agg(((F.count(F.lit(1)) > tile) | (F.sum("n") > tile_shingles)).alias("large"))
    texts = kept(docs.select("file", "at", "text").mapInArrow(pack, "file long, at long, z binary").join(roster.join(sizes, "cluster"), ["file", "at"]).select("row", "cluster", "n", "large", "z"))
    together = texts.where("not large").select("cluster", "row", "z").repartition(n_parts, "cluster").sortWithinPartitions("cluster")
    labels = together.mapInArrow(lambda b: settle(b, shingle, percent), "row long, root long")
    large = texts.where("large").drop("large")
    if large.take(1):
        labels = labels.unionByName(large_links(large, placed, shingle, percent, tile, tile_shingles))
    labels = kept(labels)
    of_copies = copies.join(labels.withColumnRenamed("row", "rep"), "rep", "left").select("row", F.coalesce("root", "rep").alias("root"))
    return signed.drop("a", "b", "bands"), kept(labels.where("row <> root").unionByName(of_copies))


def distinct_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text", slots: int = SLOTS, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """docs without the rows that are near copies of an earlier one: one row of each group stays, whatever its id.

    Links are those of near_duplicates. Every column stays as it is. Empty and null texts link with nothing and stay.
    """
    spark = prepare(docs.sparkSession)
    placed, file, at = located(docs)
    own = placed.select(F.col(file).alias("file"), F.col(at).alias("at"), F.lit(None).cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed, labels = linked(own, shingle, percent, slots, rows, tile, tile_shingles, True)
    gone = signed.join(labels, "row").select(F.col("file").alias(file), F.col("at").alias(at))
    return placed.join(gone, [file, at], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of ``shingle``-word shingles
    (words ``[^\\x20\\x09-\\x0D]+``, A-Z folded; a shorter text is one shingle; an empty or null one has none
    and no link). component_id is the least id that links reach and kept marks the rows that bear it. Rows that
    repeat an id are one node, which has the links of each of its texts, and each get a row; a row without an id
    links with nothing, has no component and isn't kept. Other columns are ignored; an empty table gives an empty
    result.

    Rows of equal sets are one class, found by size and a 128-bit hash; only its first row goes on. Banding puts
    rows in buckets; only the keys go through that shuffle, and only rows of buckets that hold different sets are
    looked at again. Buckets that share rows form clusters; a cluster of up to ``tile`` rows and ``tile_shingles``
    shingles is settled whole in one task, where intersections are counted exactly on whole sets; large_links does
    the others. So a candidate's text moves twice, no pair is ever a row, and banding is the only approximation.
    Shingles are compared as 52-bit hashes.
    """
    prepare(docs.sparkSession)
    placed, file, at = located(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")))
    own = placed.select(F.col(file).alias("file"), F.col(at).alias("at"), "id", "text")
    signed, labels = linked(own, shingle, percent, slots, rows, tile, tile_shingles, False)
    ids = signed.select("row", "id", "n")
    both = kept(labels.unionByName(labels.select(F.col("root").alias("row"), "root").distinct()).join(ids, "row").select("root", "id"))
    named = both.join(both.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
    if ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").take(1):
        named = components(named.select(F.col("id").alias("u"), F.col("component").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("component"))
    component = F.coalesce("component", "id")
    return ids.join(named, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNotNull() & (component == F.col("id"))).alias("kept"))
