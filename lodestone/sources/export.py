"""Writers: delimited text in the language's syntax, and RDF."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import ANY, Col, canonical_text, datatype, lexical, quote
from ..lang.ast import Export, RuleError
from ..lang.values import XSD
from .dsv import formats_of


def folder_or_file(df: DataFrame, path: str, overwrite: bool, gzip: bool) -> str:
    """Text lines at path: a folder of part files, as Spark writes them."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if gzip or path.endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.text(path)
    return path


def cell(col: Col, form: str) -> Column:
    """A value as text in a column's format, NULL where the format can't hold it."""
    if form == "any":
        return canonical_text(col)
    tag = col.c["t"] if col.k == ANY else F.lit(col.k)
    fits = {"string": tag == "s", "int": tag.isin("n", "u"), "double": tag == "d", "float": tag == "f"}[form]
    if form == "int" and col.k in (ANY, "o"):
        fits = fits | (tag == "o") & (datatype(col) == XSD + "integer")
    return F.when(fits, lexical(col))


def write_table(engine, pred: str, path: str, sep: str, overwrite: bool = True, gzip: bool = False, limit: int | None = None, formats: list[str] | None = None) -> str:
    """Delimited text; rows with a value that its column's format can't hold are left out, columns of format skip too."""
    stored = engine.relations[pred]
    formats = formats or ["any"] * len(stored.kinds)
    if len(formats) != len(stored.kinds):
        raise RuleError(f"{pred} has {len(stored.kinds)} columns but {len(formats)} formats", 219)
    df = engine.relation(pred)
    cells = []
    for i, (k, form) in enumerate(zip(stored.kinds, formats)):
        if form == "skip":
            continue
        text = cell(Col(F.col(f"c{i}"), k), form)
        df = df.where(text.isNotNull())
        cells.append(F.when(text.contains(sep) | text.contains('"') | text.rlike("[\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    if limit is not None:
        df = df.limit(limit)
    return folder_or_file(df.select(F.concat_ws(sep, *cells).alias("value")), path, overwrite, gzip)


def rdf_term(col: Col, place: str) -> Column:
    """A term in N-Triples syntax, NULL where its place can't hold it."""
    c, k = col
    tag = c["t"] if k == ANY else F.lit(k)
    text, kind = lexical(col), datatype(col)
    resource = F.when(tag == "i", F.concat(F.lit("<"), text, F.lit(">")))
    if place == "predicate":
        return resource
    resource = F.when(tag == "z", text).otherwise(resource)
    if place in ("subject", "graph"):
        return resource
    extra = c["x"] if k in ("l", "o", ANY) else F.lit("")
    return F.coalesce(resource, F.when(tag == "s", quote(text)).when(tag == "l", F.concat(quote(text), F.lit("@"), extra)).otherwise(F.concat(quote(text), F.lit("^^<"), kind, F.lit(">"))))


def write_rdf(engine, pred: str, path: str, form: str, overwrite: bool, gzip: bool, limit: int | None) -> str:
    """Every line is a statement of N-Triples (which Turtle is too) or N-Quads; rows that aren't statements are left out."""
    stored = engine.relations[pred]
    width = len(stored.kinds)
    quads = form in ("nquads", "trig")
    if width != (4 if quads else 3):
        raise RuleError(f"{form} needs {4 if quads else 3} columns, {pred} has {width}", 219)
    places = (["graph"] if quads else []) + ["subject", "predicate", "object"]
    df = engine.relation(pred)
    if limit is not None:
        df = df.limit(limit)
    df = df.select(*[rdf_term(Col(F.col(f"c{i}"), k), p).alias(p) for i, (k, p) in enumerate(zip(stored.kinds, places))]).na.drop()
    default = F.col("graph") == "<DEFAULT_GRAPH>" if quads else F.lit(True)
    triple = F.concat_ws(" ", "subject", "predicate", "object")
    if form == "nquads":
        line = F.when(default, F.concat(triple, F.lit(" ."))).otherwise(F.concat(triple, F.lit(" "), F.col("graph"), F.lit(" .")))
    elif form == "trig":
        line = F.when(default, F.concat(triple, F.lit(" ."))).otherwise(F.concat(F.col("graph"), F.lit(" { "), triple, F.lit(" . }")))
    elif form == "rdfxml":
        body = F.regexp_extract("predicate", r"^<(.*[/#:])[^/#:]+>$", 1), F.regexp_extract("predicate", r"[/#:]([^/#:]+)>$", 1)
        escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
        about = lambda c, key: F.when(c.startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.regexp_replace(c, r"^_:", "n"), F.lit('"'))).otherwise(F.concat(F.lit(f'rdf:{key}="'), escape(F.regexp_extract(c, r"^<(.*)>$", 1)), F.lit('"')))
        value = F.regexp_replace(F.regexp_extract("object", r'^"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1")
        extra = F.when(F.col("object").rlike(r'"@[A-Za-z-]+$'), F.concat(F.lit(' xml:lang="'), F.regexp_extract("object", r'"@([A-Za-z0-9-]+)$', 1), F.lit('"'))).when(F.col("object").rlike(r'"\^\^<'), F.concat(F.lit(' rdf:datatype="'), F.regexp_extract("object", r'"\^\^<([^>]*)>$', 1), F.lit('"'))).otherwise("")
        inner = F.when(F.col("object").startswith('"'), F.concat(F.lit("<p:"), body[1], F.lit(' xmlns:p="'), escape(body[0]), F.lit('"'), extra, F.lit(">"), escape(value), F.lit("</p:"), body[1], F.lit(">"))).otherwise(
            F.concat(F.lit("<p:"), body[1], F.lit(' xmlns:p="'), escape(body[0]), F.lit('" '), about(F.col("object"), "resource"), F.lit("/>"))
        )
        row = F.concat(F.lit("<rdf:Description "), about(F.col("subject"), "about"), F.lit(">"), inner, F.lit("</rdf:Description>"))
        head = engine.spark.createDataFrame([(0, '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'), (2, "</rdf:RDF>")], "o int, value string")
        # an XML document is one file: this format alone is written by one task
        return folder_or_file(df.select(F.lit(1).alias("o"), row.alias("value")).union(head).coalesce(1).sortWithinPartitions("o").select("value"), path, overwrite, gzip)
    else:
        line = F.concat(triple, F.lit(" ."))
    return folder_or_file(df.select(line.alias("value")), path, overwrite, gzip)


def write_export(engine, spec: Export, base_dir: str, overwrite: bool = True, gzip: bool = False) -> str:
    """Writes one @export; without a resource the file is named after the predicate, and ``stdout`` prints."""
    from . import DSV, RDF_ENDINGS, compression, delimiter, limit_of, parameters, rdf_form, text_of

    params = parameters(spec)
    form = spec.format
    gzip = gzip or compression(params) == "gzip"
    endings = {**{v: k for k, v in RDF_ENDINGS.items()}, "dsv": "csv"}
    name = str(text_of(params.get("resource")) or f"{re.sub(r'\\W', '_', spec.pred)}.{endings.get(form, form)}")
    limit = limit_of(params)
    if name == "stdout":
        df = engine.relation(spec.pred, strings=True)
        for row in (df.limit(limit) if limit is not None else df).toLocalIterator():
            print((text_of(params.get("delimiter"), DSV.get(form)) or "\t").join(row))
        return name
    path = name if os.path.isabs(name) or re.match(r"[a-z0-9]+:/", name) else os.path.join(base_dir, name)
    if form in DSV:
        return write_table(engine, spec.pred, path, delimiter(params, form), overwrite, gzip, limit, formats_of(params, None))
    if form == "rdf":
        form = rdf_form(name)
    if form not in ("ntriples", "nquads", "turtle", "trig", "rdfxml"):
        raise RuleError(f"{spec.format} can't be exported", 995)
    return write_rdf(engine, spec.pred, path, form, overwrite, gzip, limit)
