"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U64, bounded, buffers, mix, numbered
from .pretokens import LETTER, classes
from .session import prepare

ORDER = 4
SAMPLE = 400  # labelled documents a language from which its model is learned, and a third more to calibrate
DISCOUNT = 0.75
BLANK = 0x20
UNKNOWN = "und"


@cache
def folded() -> np.ndarray:
    """Lower-case letters for letters, a blank for all else."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded signs with ORDER - 1 blanks before each text, offsets, number of letters by text)."""
    data, offsets = buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    bounds = heads[offsets]
    signs = folded()[points]
    blank = signs == BLANK
    before = np.ones(len(signs) + 1, bool)
    before[1:] = np.append(blank, True)[: len(signs)]
    before[bounds] = True
    keep = ~(blank & before[:-1])
    kept = np.zeros(len(signs) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(signs) + 1, np.int64)
    np.cumsum(~blank, out=letters[1:])
    signs, bounds_kept = signs[keep], kept[bounds]
    pad = ORDER - 1
    signs = np.insert(signs, np.repeat(bounds_kept[:-1], pad), BLANK)
    return signs, bounds_kept + pad * np.arange(len(bounds)), letters[bounds[1:]] - letters[bounds[:-1]]


def ngram_hashes(signs: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each sign (the first order - 1 are of no use)."""
    out = np.full(len(signs), order, U64)
    for j in range(order - 1, -1, -1):
        out *= U64(0x100000001B3)
        out[j:] += signs[: len(signs) - j].astype(U64)
    return mix(out)


@dataclass
class Table:
    """Rows of values under sorted hashes; an index by the upper bits points into them."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.bits = min(20, len(self.keys).bit_length() + 2)
        top = (self.keys >> U64(64 - self.bits)).astype(np.int64)
        self.index = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.index).max(initial=0))

    def find(self, query: np.ndarray) -> np.ndarray:
        """The row of each query, or -1."""
        out = np.full(len(query), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.index[(query >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        for j in range(self.most):
            row = np.minimum(at + j, len(self.keys) - 1)
            hit = self.keys[row] == query
            out[hit] = row[hit]
        return out


@dataclass
class Models:
    languages: list[str]
    grams: list[Table]  # by order 1..ORDER: natural log probabilities, a column a language
    backoffs: list[Table]  # by context length 0..ORDER-1: log of the mass left to the next lower order
    floor: np.ndarray
    limit: np.ndarray  # the cross-entropy above which a text is rejected, by language
    spread: np.ndarray

    def entropies(self, signs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Cross-entropy (nats a sign) of each text under each language; nan for texts without signs."""
        pad = ORDER - 1
        real = np.ones(len(signs), bool)
        real[(bounds[:-1, None] + np.arange(pad)).reshape(-1)] = False
        at = np.flatnonzero(real)
        sizes = np.diff(bounds) - pad
        total = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            table = self.grams[order - 1]
            row = table.find(ngram_hashes(signs, order)[at[open_]])
            hit = row >= 0
            total[open_[hit]] += table.values[row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            table = self.backoffs[order - 1]
            row = table.find(ngram_hashes(signs, order - 1)[at[open_] - 1]) if order > 1 else np.full(len(open_), 0 if len(table.keys) else -1)
            hit = row >= 0
            total[open_[hit]] += table.values[row[hit]]
            if order == 1:
                total[open_] += self.floor
        sums = np.zeros((len(sizes), len(self.languages)))
        some = np.flatnonzero(sizes > 0)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            sums[some] = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums / sizes[:, None]


def gram_counts(signs: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, its context, itself without its first sign, how often it occurs) of the distinct n-grams of texts."""
    real = np.ones(len(signs), bool)
    real[(bounds[:-1, None] + np.arange(ORDER - 1)).reshape(-1)] = False
    at = np.flatnonzero(real)
    gram, first, which = numbered(ngram_hashes(signs, order)[at])
    at = at[first]
    before = ngram_hashes(signs, order - 1) if order > 1 else np.zeros(len(signs), U64)
    return gram, before[at - 1], before[at], np.bincount(which, minlength=len(gram))


def learn(texts: dict[str, list[str]], calibration: dict[str, list[str]]) -> Models:
    """Models of texts by language, calibrated on others (or on the same where there are none)."""
    languages = sorted(texts)
    parts = [characters(pa.array(texts[x], pa.large_string())) for x in languages]
    counted = []
    for order in range(1, ORDER + 1):
        own = [gram_counts(signs, bounds, order) for signs, bounds, _ in parts]
        owner = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
        counted.append((owner, *(np.concatenate([np.zeros(0, U64), *(o[i] for o in own)]) for i in range(4))))
    models = build(languages, counted)
    for number, language in enumerate(languages):
        signs, bounds, letters = characters(pa.array(calibration.get(language) or texts[language], pa.large_string()))
        calibrate(models, number, models.entropies(signs, bounds)[:, number][letters >= 20])
    return models


def calibrate(models: Models, number: int, entropies: np.ndarray) -> None:
    """Sets the cross-entropy above which a language's model rejects a text, from those of texts in the language."""
    if len(entropies):
        middle = np.median(entropies)
        wide = max(np.quantile(entropies, 0.995) - middle, 0.05)
        models.limit[number], models.spread[number] = middle + 3.5 * wide, wide


def build(languages: list[str], counted: list[tuple[np.ndarray, ...]]) -> Models:
    """Models of all languages over the union of their n-grams, so that one lookup serves them all.

    counted holds by order the (language's number, n-gram, context, n-gram without its first sign, times) of the
    distinct n-grams of each language.
    """
    size = len(languages)
    keys: list[np.ndarray] = []
    context_of: list[np.ndarray] = []
    shorter: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for owners, grams, contexts, suffixes, times in counted:
        gram, first, which = numbered(grams)
        table = np.zeros((len(gram), size))
        table[which, owners] = times
        keys.append(gram)
        context_of.append(contexts[first])
        shorter.append(suffixes[first])
        counts.append(table)
    alphabet = len(keys[0]) + 1
    for order in range(ORDER - 1, 0, -1):  # lower orders count the different signs seen before an n-gram
        follow = np.zeros_like(counts[order - 1])
        where = np.searchsorted(keys[order - 1], shorter[order])
        np.add.at(follow, where, counts[order] > 0)
        counts[order - 1] = follow
    grams_, backoffs = [], []
    lower = None
    for order in range(1, ORDER + 1):
        context, _, which = numbered(context_of[order - 1])
        total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
        np.add.at(total, which, counts[order - 1])
        np.add.at(kinds, which, counts[order - 1] > 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        below = lower[np.searchsorted(keys[order - 2], shorter[order - 1])] if order > 1 else np.full((len(keys[0]), size), 1 / alphabet)
        lower = np.maximum(counts[order - 1] - DISCOUNT, 0) / np.maximum(total, 1)[which] + left[which] * below
        grams_.append(Table(keys[order - 1], np.log(np.maximum(lower, 1e-300)).astype(np.float32)))
        backoffs.append(Table(context, np.log(np.maximum(left, 1e-300)).astype(np.float32)))
    return Models(languages, grams_, backoffs, np.full(size, np.log(1 / alphabet), np.float32), np.full(size, np.inf), np.ones(size))


def predict(models: Models, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of each text."""
    signs, bounds, letters = characters(column)
    h = models.entropies(signs, bounds)
    some = (letters > 0) & bool(models.languages)
    names, score, accepted = [UNKNOWN] * len(letters), np.zeros(len(letters)), np.zeros(len(letters), bool)
    where = np.flatnonzero(some)
    if len(where):
        own = h[where]
        best = own.argmin(1)
        least = own[np.arange(len(own)), best]
        size = np.minimum(letters[where], 40)  # neighbouring signs repeat themselves: more are not more evidence
        share = 1 / np.exp(-(own - least[:, None]) * size[:, None]).sum(1)
        short = 1.5 / np.sqrt(letters[where])  # a short text's entropy strays further
        over = (least - models.limit[best] - short) / models.spread[best]
        score[where] = share / (1 + np.exp(np.clip(over, -50, 50)))
        accepted[where] = (over <= 0) & (share >= 0.5)
        for i, b in zip(where.tolist(), best.tolist()):
            names[i] = models.languages[b]
    return names, score, accepted


def learn_models(docs: DataFrame, text_col: str, lang_col: str, order_col: str, sample: int = SAMPLE) -> Models:
    """Models from a bounded sample: per language the ``sample`` labelled documents with the least hash of order_col and text, whole, and a third more to calibrate.

    Languages are counted first; a hash threshold then keeps about twice what is needed, whose hashes alone give the
    exact cuts, so no language is ever sorted. Rows with one hash, being copies, are taken once. N-grams are counted in
    tasks and added up by Spark; the driver gets the counts of distinct n-grams and the entropies of the calibration,
    never a text.
    """
    spark = prepare(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(order_col, text_col).alias("h"))
    need = sample + sample // 3
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)

    def below(limits: dict[str, int]) -> Column:
        return reduce(lambda x, y: x | y, [(F.col("lang") == language) & (F.col("h") <= top) for language, top in limits.items()], F.lit(False))

    rough = {language: min((1 << 63) - 1, int(min(1.0, (2 * need + 50) / n) * 2.0**64) - (1 << 63)) for language, n in counts.items()}
    hashes: dict[str, list[int]] = {language: [] for language in counts}
    for r in known.where(below(rough)).select("lang", "h").distinct().toLocalIterator():
        hashes[r.lang].append(r.h)
    chosen = {language: sorted(found)[:need] for language, found in hashes.items() if found}
    held = {language: found[len(found) // 4 - 1] for language, found in chosen.items() if len(found) >= 4}
    taken = known.where(below({language: found[-1] for language, found in chosen.items()})).dropDuplicates(["lang", "h"]).withColumn("held", below(held)).checkpoint()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            for language in batch.column("lang").unique().to_pylist():
                signs, bounds, _ = characters(batch.column("text").filter(pc.equal(batch.column("lang"), language)))
                for order in range(1, ORDER + 1):
                    gram, context, shorter, times = gram_counts(signs, bounds, order)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), languages.index(language))), pa.array(np.full(len(gram), order)), *(pa.array(x.view(np.int64)) for x in (gram, context, shorter)), pa.array(times)], names=["number", "ord", "gram", "context", "shorter", "times"]
                    )

    grams = taken.where("not held").mapInArrow(count, "number long, ord long, gram long, context long, shorter long, times long")
    found = grams.groupBy("number", "ord", "gram").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("times").alias("times")).toArrow()
    column = {c: found.column(c).to_numpy() for c in found.column_names}
    counted = []
    for order in range(1, ORDER + 1):
        own = column["ord"] == order
        counted.append((column["number"][own], *(column[c][own].view(U64) for c in ("gram", "context", "shorter")), column["times"][own]))
    models = build(languages, counted)
    shipped = spark.sparkContext.broadcast(models)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            signs, bounds, letters = characters(batch.column("text"))
            number = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
            h = shipped.value.entropies(signs, bounds)[np.arange(len(number)), number]
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column("held"), pa.array(h)], names=["number", "held", "h"]).filter(pa.array(letters >= 20))

    measured = taken.select("lang", "held", "text").mapInArrow(measure, "number long, held boolean, h double").toArrow()
    number, held_out, h = (measured.column(c).to_numpy() for c in ("number", "held", "h"))
    for i, language in enumerate(languages):
        calibrate(models, i, h[(number == i) & (held_out == (language in held))])
    return models


def identify(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_accepted; a text without letters, or null, is ``und`` and not accepted.

    Row by row, with all columns kept; columns of those three names in docs are replaced. No shuffle.
    """
    prepare(docs.sparkSession)
    kept = docs.drop("lang_pred", "lang_score", "lang_accepted")
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_accepted", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col, 1 << 20):
            names, score, accepted = predict(shipped.value, batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_accepted"])

    return kept.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row; learns where crc32(id as text) mod folds is not held_out.

    Nulls in lang are not learned from; with no labelled row every prediction is ``und``. Repeated rows and null
    ids (crc32 of the empty text) get a row each; ties go to the first language by name; an empty table gives an
    empty result; other columns are ignored.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    own = own.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held_out)
    models = learn_models(own.where(~F.col("held_out")), "text", "lang", "doc_id", sample)
    return identify(own.drop("lang"), models).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
