"""Documents that only a parser can read: whole files become rows on the executors, one file a row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import ANY, STRUCT
from ..lang.values import Value

FIELDS = [("t", pa.string()), ("n", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("x", pa.string())]


def as_dict(v: Value) -> dict:
    t = v.tag
    return {"t": t, "n": int(v.value) if t in "nb" else None, "d": float(v.value) if t in "df" else None, "s": str(v.value) if t in "sizlou" else None, "x": v.extra}


def read_whole(spark: SparkSession, path: str, width: int, parse: Callable[[str, str], Iterator[tuple[Value, ...]]]) -> tuple[DataFrame, list[str]]:
    """Rows that parse(text, file name) yields for each file under path."""
    names = [f"c{i}" for i in range(width)]
    kind = pa.schema([(n, pa.struct(FIELDS)) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, name in zip(b.column("value").to_pylist(), b.column("file").to_pylist()):
                rows: list[tuple[Value, ...]] = []
                for row in parse(text, name):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([{n: as_dict(v) for n, v in zip(names, r)} for r in rows], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: as_dict(v) for n, v in zip(names, r)} for r in rows], schema=kind)

    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.mapInArrow(run, ", ".join(f"{n} {STRUCT}" for n in names)), [ANY] * width
