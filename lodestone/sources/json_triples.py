"""A JSON document as triples (node, key, value): a ``type`` for each node, ``value`` for scalars, members for the rest."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..lang.values import Value, integer
from .parsed import read_whole

NAMES = {type(None): "null", bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def scalar(v) -> Value:
    if isinstance(v, bool):
        return Value("b", v)
    if isinstance(v, int):
        whole = integer(str(v))
        return whole if whole.tag == "n" else Value("u", v) if 0 <= v < 1 << 64 else Value("d", float(v))
    return Value("d", v) if isinstance(v, float) else Value("s", v)


def triples(text: str, file: str = "") -> Iterator[tuple[Value, Value, Value]]:
    """Nodes are numbered as they are met, the document being 0; what was met last is looked into first."""
    waiting, count = [(0, json.loads(text))], 0
    while waiting:
        number, now = waiting.pop()
        node = Value("n", number)
        yield node, Value("i", "type"), Value("s", NAMES[type(now)])
        if isinstance(now, (list, dict)):
            members = enumerate(now) if isinstance(now, list) else sorted(now.items())
            for key, inner in members:
                count += 1
                waiting.append((count, inner))
                yield node, Value("n", key) if isinstance(key, int) else Value("s", key), Value("n", count)
        elif now is not None:
            yield node, Value("i", "value"), scalar(now)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    return read_whole(spark, path, 3, triples)
