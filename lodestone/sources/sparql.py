"""SPARQL endpoints: a query's result, and the same restricted to given bindings, page by page."""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.encoding import ANY, STRUCT, python_value
from ..lang.ast import RuleError
from ..lang.values import Value, canonical
from ..plans.storage import materialised
from .parsed import FIELDS, as_dict

#: The most bindings and characters of a page, and the length from which a query is posted.
PAGE_ROWS, PAGE_CHARS, POST_FROM = 32_000, 740_000, 2_000


def ask(endpoint: str, query: str) -> str:
    """The endpoint's answer as tab-separated values."""
    headers = {"Accept": "text/tab-separated-values", "User-Agent": "lodestone"}
    form = urllib.parse.urlencode({"query": query})
    if len(query) > POST_FROM:
        request = urllib.request.Request(endpoint, data=form.encode(), headers=headers)
    else:
        request = urllib.request.Request(f"{endpoint}{'&' if '?' in endpoint else '?'}{form}", headers=headers)
    with urllib.request.urlopen(request, timeout=300) as got:
        return got.read().decode()


def rows_of(answer: str) -> Iterator[tuple[Value, ...]]:
    from .rdf import Turtle

    for line in answer.splitlines()[1:]:
        cells = line.split("\t")
        if all(cells):
            yield tuple(Turtle(c, "sparql", None).term() for c in cells)


def pages(bindings: Iterable[tuple[Value, ...]], names: list[str]) -> Iterator[str]:
    """VALUES blocks, each within a page's bounds."""
    head, block, size, count = f"VALUES ({' '.join('?' + n for n in names)}) {{ ", [], 0, 0
    for row in bindings:
        text = "(" + " ".join(f"<{v.value}>" if v.tag == "i" else canonical(v) for v in row) + ")"
        if block and (count >= PAGE_ROWS or size + len(text) > PAGE_CHARS):
            yield head + " ".join(block) + " }"
            block, size, count = [], 0, 0
        block.append(text)
        size, count = size + len(text), count + 1
    if block:
        yield head + " ".join(block) + " }"


def restricted(query: str, values: str) -> str:
    """The query with a VALUES block put at the front of its pattern."""
    at = query.index("{", query.lower().index("where")) if "where" in query.lower() else query.index("{")
    return f"{query[: at + 1]} {values} {query[at + 1 :]}"


def selected(query: str) -> list[str] | None:
    """The names of a query's columns, if it lists plain variables."""
    m = re.search(r"\bselect\s+(?:distinct\s+|reduced\s+)?((?:[?$]\w+[\s,]*)+)(?:where\b|from\b|\{)", query, re.I)
    return re.findall(r"[?$](\w+)", m[1]) if m else None


def endpoint_and_query(params: dict) -> tuple[str, str]:
    from . import text_of

    endpoint, query = text_of(params.get("endpoint")), text_of(params.get("query"))
    if not endpoint or not query:
        raise RuleError("a SPARQL import needs an endpoint and a query", 220)
    return str(endpoint), str(query)


def read(spark: SparkSession, params: dict, arity: int | None, bindings: tuple[list[str], DataFrame] | None = None, send: Callable[[str, str], str] = ask) -> tuple[DataFrame, list[str]]:
    """All rows of a query, or only those that join with bindings: variable names and a table of values of any kind.

    Requests are sent, and answers read, by tasks: one for a whole query, and one for about a page of bindings.
    """
    endpoint, query = endpoint_and_query(params)
    width = arity or len(selected(query) or [])
    if not width:
        raise RuleError("a SPARQL import's number of columns isn't known", 232)
    names = [f"c{i}" for i in range(width)]
    kind = pa.schema([(n, pa.struct(FIELDS)) for n in names])

    given = None if bindings is None else bindings[0]

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (row.values() for b in batches for row in b.to_pylist())
        if given is None:
            queries: Iterable[str] = (query for _ in cells)
        else:
            queries = (restricted(query, block) for block in pages((tuple(python_value(x, ANY) for x in row) for row in cells), given))
        for q in queries:
            rows = [row for row in rows_of(send(endpoint, q)) if len(row) == width]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([{n: as_dict(v) for n, v in zip(names, r)} for r in rows[at : at + 10_000]], schema=kind)

    if bindings is None:
        asked = spark.range(1).coalesce(1)
    else:
        asked = materialised(bindings[1].distinct())
        asked = asked.repartition(max(1, -(-asked.count() // PAGE_ROWS)))
    # answers are written, so that no request is sent twice
    return materialised(asked.mapInArrow(fetch, ", ".join(f"{n} {STRUCT}" for n in names))), [ANY] * width
