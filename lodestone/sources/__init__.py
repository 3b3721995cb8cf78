"""Readers of the import formats."""

from __future__ import annotations

import gzip
import io
import os
import re
import shutil
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Import, Op, RuleError, Tuple_, Var, substitute
from ..lang.values import Value

#: What formats there are, the parameters they take, and file name endings of the RDF ones.
COMMON = {"resource", "compression", "http_headers", "http_get_parameters", "http_post_parameters", "iri_fragment", "limit"}
DSV = {"csv": ",", "tsv": "\t", "dsv": None}
RDF_ENDINGS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "trig": "trig", "rdf": "rdfxml"}
RDF = ("ntriples", "nquads", "turtle", "trig", "rdfxml", "rdf")
PARAMETERS = {**{f: COMMON | {"format", "ignore_headers", "quoting", "delimiter"} for f in DSV}, **{f: COMMON | {"base", "format"} for f in RDF}, "json": COMMON, "sparql": {"endpoint", "query", "base", "format", "iri_fragment"}, "parquet": COMMON}


def parameters(spec: Import) -> dict:
    """A specification's parameters with what its guards bind put in."""
    map_ = {}
    for g in spec.guards:
        if isinstance(g, Op) and g.name == "EQUALITY" and isinstance(g.args[0], Var):
            map_[g.args[0]] = g.args[1]
        else:
            raise RuleError("an import's conditions must bind variables", 239)
    out = {k: evaluated(substitute(v, map_)) for k, v in spec.params.items()}
    allowed = PARAMETERS.get(spec.format)
    if allowed is None:
        raise RuleError(f"no format is named {spec.format}", 231)
    for k, v in out.items():
        if k not in allowed:
            raise RuleError(f"format {spec.format} has no parameter {k}", 221)
        if isinstance(v, Var):
            raise RuleError(f"parameter {k} isn't bound", 238)
    return out


def evaluated(term):
    """Ground text operations in parameters, such as names put together."""
    if isinstance(term, Op):
        args = [evaluated(a) for a in term.args]
        if term.name in ("CONCAT", "STR") and all(isinstance(a, Value) for a in args):
            return Value("s", "".join(str(a.value) for a in args))
        raise RuleError("only texts can be computed in parameters")
    return Tuple_(tuple(evaluated(a) for a in term.items), term.tag) if isinstance(term, Tuple_) and term.tag is None else term


def text_of(value, default=None):
    return default if value is None else value.value if isinstance(value, Value) else value


def resource_path(params: dict, base_dir: str) -> str:
    path = text_of(params.get("resource"))
    if not path:
        raise RuleError("an import needs a resource", 220)
    path = str(path)
    if path == "stdin":
        return shared(lambda out: shutil.copyfileobj(sys.stdin.buffer, out), "stdin")
    if path.startswith("file:"):
        path = re.sub(r"^file:(//)?", "", path)
    if re.match(r"https?://", path):
        return fetched(path, params)
    if re.match(r"[a-z0-9]+://", path) or os.path.isabs(path):
        return path
    return os.path.join(base_dir, path)


def limit_of(params: dict) -> int | None:
    limit = text_of(params.get("limit"))
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise RuleError("a limit must be an integer", 222)
    if limit < 0:
        raise RuleError("a limit can't be negative", 224)
    return limit


def delimiter(params: dict, form: str) -> str:
    sep = text_of(params.get("delimiter"), DSV[form])
    if sep is None:
        raise RuleError(f"format {form} needs a delimiter", 220)
    if not isinstance(sep, str) or len(sep) != 1:
        raise RuleError("a delimiter must be a single character", 225)
    return sep


def compression(params: dict) -> str | None:
    """The compression named; files of a known ending need none named."""
    named = text_of(params.get("compression"))
    if named is not None and str(named) != "gzip":
        raise RuleError(f"no compression is named {named}", 226)
    return named


def rdf_form(path: str) -> str:
    ending = re.sub(r"\.gz$", "", path).rpartition("/")[2].rpartition(".")
    if not ending[1]:
        raise RuleError(f"{path} has no ending that names an RDF format", 229)
    if ending[2] not in RDF_ENDINGS:
        raise RuleError(f"no RDF format has the ending {ending[2]}", 230)
    return RDF_ENDINGS[ending[2]]


def plain(spark: SparkSession, path: str, params: dict) -> str:
    """path as Spark's readers can take it: what is compressed without an ending that says so is written plain to the shared folder.

    Gzip can't be read in splits anyhow, so one task unpacks a file, a few megabytes at a time.
    """
    if compression(params) is None or path.endswith(".gz"):
        return path
    import uuid

    from ..plans.storage import shared_folder

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with gzip.open(io.BytesIO(content.as_buffer()), "rt", encoding="utf-8", newline="\n") as lines:
                    while held := lines.readlines(4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array("".join(held).removesuffix("\n").split("\n"))], names=["value"])

    folder = f"{shared_folder(spark)}/plain-{uuid.uuid4().hex}"
    spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string").write.text(folder)
    return folder


def pairs(value) -> list[tuple[str, str]]:
    return [(str(k), str(text_of(v))) for k, v in value.items] if isinstance(value, Tuple_) else []


def fetched(url: str, params: dict) -> str:
    """A web resource, got with the given headers and parameters."""
    import urllib.parse
    import urllib.request

    query, post = pairs(params.get("http_get_parameters")), pairs(params.get("http_post_parameters"))
    if query:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query)
    request = urllib.request.Request(url, data=urllib.parse.urlencode(post).encode() if post else None, headers=dict(pairs(params.get("http_headers"))))

    def bring(out: BinaryIO) -> None:
        with urllib.request.urlopen(request, timeout=60) as got:
            shutil.copyfileobj(got, out)

    return shared(bring, os.path.basename(urllib.parse.urlparse(url).path) or "resource")


def shared(fill: Callable[[BinaryIO], None], name: str) -> str:
    """A file in the shared folder, where executors can read it, with what fill writes."""
    import tempfile
    import uuid

    from ..plans.storage import shared_folder

    spark = SparkSession.getActiveSession()
    target = f"{shared_folder(spark)}/got-{uuid.uuid4().hex}/{name}"
    with tempfile.NamedTemporaryFile() as out:
        fill(out)
        out.flush()
        path = spark._jvm.org.apache.hadoop.fs.Path
        path(target).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path(f"file://{out.name}"), path(target))
    return target


def load(spark: SparkSession, spec: Import, base_dir: str, arity: int | None) -> tuple[DataFrame, list[str]]:
    """Rows and column kinds of an import."""
    from . import dsv, json_triples, rdf, sparql

    params = parameters(spec)
    if spec.format in DSV:
        return dsv.read(spark, spec.format, params, base_dir, arity)
    if spec.format == "json":
        return json_triples.read(spark, plain(spark, resource_path(params, base_dir), params))
    if spec.format == "sparql":
        return sparql.read(spark, params, arity)
    if spec.format == "parquet":
        from ..functions.encoding import adopt

        return adopt(spark.read.parquet(resource_path(params, base_dir)))
    return rdf.read(spark, spec.format, params, base_dir)
