"""RDF readers. N-Triples and N-Quads are read line by line in Spark; Turtle, TriG and RDF/XML by whole file."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import ANY, STRUCT
from ..functions.library import finite
from ..lang.ast import RuleError
from ..lang.parser import unescape
from ..lang.values import RDF as RDF_NS
from ..lang.values import XSD, Value, typed_literal
from .dsv import struct_value
from .parsed import read_whole

TYPE, FIRST, REST, NIL = (RDF_NS + x for x in ("type", "first", "rest", "nil"))
DEFAULT_GRAPH = Value("i", "DEFAULT_GRAPH")
TERM = r'(<[^>]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?)'


def unescaped(c: Column) -> Column:
    """Escapes of N-Triples, each read once from left to right; texts without a backslash pass untouched."""

    def undone(p: Column) -> Column:
        sign = F.when(F.length(p) == 6, F.decode(F.unhex(F.substr(p, F.lit(3))), "UTF-16BE")).when(F.length(p) == 10, F.decode(F.unhex(F.substr(p, F.lit(3))), "UTF-32"))
        return F.when(~p.startswith("\\"), p).when(F.length(p) == 2, F.translate(F.substr(p, F.lit(2)), "tbnrf", "\t\b\n\r\f")).otherwise(F.coalesce(sign, p))

    pieces = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, undone), "")).otherwise(c)


WHOLE = [XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedShort", "unsignedByte", "unsignedLong")]


def term(df: DataFrame, source: str, out: str) -> DataFrame:
    """Column out from a term in N-Triples syntax; its parts are columns first, which keeps generated code small."""
    raw, lang, kind = f"{out}_raw", f"{out}_lang", f"{out}_kind"
    literal = F.col(source).startswith('"')
    df = df.withColumns({raw: F.when(literal, F.regexp_extract(source, r'^"((?:[^"\\]|\\.)*)"', 1)), lang: F.when(literal, F.regexp_extract(source, r'"@([A-Za-z0-9-]+)$', 1)), kind: F.when(literal, F.regexp_extract(source, r'"\^\^<([^>]*)>$', 1))})
    df = df.withColumn(raw, unescaped(F.col(raw)))
    c, text = F.col(source), F.col(raw)
    decimal = (F.col(kind) == XSD + "decimal") & text.rlike(r"^[+-]?\d+(\.0*)?$")
    whole = F.when(decimal, F.substring_index(text, ".", 1).try_cast("bigint")).when(F.col(kind).isin(*WHOLE), text.try_cast("bigint"))
    real = F.when(F.col(kind) == XSD + "double", finite(text.try_cast("double")))
    value = (
        F.when(c.startswith("<"), struct_value("i", s=unescaped(F.expr(f"substring({source}, 2, length({source}) - 2)"))))
        .when(c.startswith("_:"), struct_value("z", s=F.concat(F.lit("_:"), F.substring(F.md5("f"), 1, 8), F.lit("_"), F.substr(c, F.lit(3)))))
        .when(F.col(lang) != "", struct_value("l", s=text, x=F.lower(lang)))
        .when((F.col(kind) == "") | (F.col(kind) == XSD + "string"), struct_value("s", s=text))
        .when(whole.isNotNull(), struct_value("n", n=whole))
        .when(real.isNotNull(), struct_value("d", d=real))
        .when((F.col(kind) == XSD + "boolean") & text.isin("true", "false", "1", "0"), struct_value("b", n=text.isin("true", "1").cast("bigint")))
        .otherwise(struct_value("o", s=text, x=F.col(kind)))
        .cast(STRUCT)
    )
    return df.withColumn(out, value).drop(raw, lang, kind)


def read_lines(spark: SparkSession, path: str, quads: bool) -> tuple[DataFrame, list[str]]:
    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("l"), F.input_file_name().alias("f")).where("l <> '' and not startswith(l, '#')")
    pattern = r"^" + r"\s*".join([TERM] * 3) + (r"\s*(<[^>]*>|_:[^\s<\"]+)?" if quads else "") + r"\s*\.\s*(?:#.*)?$"
    places = [4, 1, 2, 3] if quads else [1, 2, 3]
    df = lines.where(F.col("l").rlike(pattern)).withColumns({f"p{k}": F.regexp_extract("l", pattern, k) for k in places})
    if quads:
        df = df.withColumn("p4", F.when(F.col("p4") == "", f"<{DEFAULT_GRAPH.value}>").otherwise(F.col("p4")))
    for i, k in enumerate(places):
        df = term(df, f"p{k}", f"c{i}")
    return df.select(*[f"c{i}" for i in range(len(places))]), [ANY] * len(places)


class Turtle:
    """Turtle and TriG by recursive descent; yields (graph, subject, predicate, object)."""

    TOKEN = re.compile(
        r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
        |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<blank>_:[\w.\-]*[\w\-])
        |(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:[\w:%\-](?:[\w:%.\-]*[\w:%\-])?)?)|(?P<word>[A-Za-z]+)|(?P<punct>[.;,\[\](){}])""",
        re.X | re.S,
    )

    def __init__(self, text: str, file: str, base: str | None):
        self.tokens, at = [], 0
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m:
                raise RuleError(f"{file}: can't read {text[at:at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.prefixes, self.out, self.graph = 0, base or "", {}, [], DEFAULT_GRAPH
        self.salt, self.fresh = hashlib.md5(file.encode()).hexdigest()[:8], 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, text: str) -> bool:
        if self.peek() == ("punct", text):
            self.at += 1
            return True
        return False

    def node(self) -> Value:
        self.fresh += 1
        return Value("z", f"_:{self.salt}_g{self.fresh}")

    def resolve(self, iri: str) -> str:
        iri = unescape(iri)
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", iri) else iri

    def term(self) -> Value:
        kind, text = self.take()
        if kind == "iri":
            return Value("i", self.resolve(text[1:-1]))
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise RuleError(f"prefix {prefix}: isn't declared")
            return Value("i", self.prefixes[prefix] + local)
        if kind == "blank":
            return Value("z", f"_:{self.salt}_{text[2:]}")
        if kind in ("str", "long"):
            body = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return Value("l", body, self.take()[1][1:].lower())
            if self.peek()[0] == "type":
                self.take()
                return typed_literal(body, self.term().value)
            return Value("s", body)
        if kind == "num":
            return typed_literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return Value("b", text == "true")
        if kind == "word" and text == "a":
            return Value("i", TYPE)
        if (kind, text) == ("punct", "["):
            node = self.node()
            if not self.skip("]"):
                self.properties(node)
                self.skip("]")
            return node
        if (kind, text) == ("punct", "("):
            items = []
            while not self.skip(")"):
                items.append(self.term())
            head = Value("i", NIL)
            for item in reversed(items):
                node = self.node()
                self.out += [(self.graph, node, Value("i", FIRST), item), (self.graph, node, Value("i", REST), head)]
                head = node
            return head
        raise RuleError(f"unexpected {text!r} in RDF")

    def properties(self, subject: Value) -> None:
        while self.peek()[1] not in (".", "]", "}", ""):
            verb = self.term()
            while True:
                self.out.append((self.graph, subject, verb, self.term()))
                if not self.skip(","):
                    break
            if not self.skip(";"):
                break
            while self.skip(";"):
                pass

    def triples(self) -> None:
        bracket = self.peek() == ("punct", "[")
        subject = self.term()
        if not (bracket and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def run(self) -> list[tuple[Value, ...]]:
        while self.at < len(self.tokens):
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if kind in ("lang", "word") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1].rstrip(":")
                    self.prefixes[name] = self.resolve(self.take()[1][1:-1])
                else:
                    self.base = self.resolve(self.take()[1][1:-1])
                self.skip(".")
                continue
            if kind == "word" and word == "graph":
                self.take()
                kind, text = self.peek()
            following = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else ""
            if text == "{" or kind in ("iri", "name", "blank") and following == "{":
                self.graph = DEFAULT_GRAPH if text == "{" else self.term()
                self.skip("{")
                while not self.skip("}"):
                    self.triples()
                    self.skip(".")
                self.graph = DEFAULT_GRAPH
                self.skip(".")
                continue
            self.triples()
            self.skip(".")
        return self.out


def xml_triples(text: str, file: str, base: str | None) -> Iterator[tuple[Value, ...]]:
    """RDF/XML: node and property elements, typed nodes, attributes, containers, collections and literals."""
    salt, fresh, out = hashlib.md5(file.encode()).hexdigest()[:8], [0], []
    xml = "{http://www.w3.org/XML/1998/namespace}"
    own = lambda name: f"{{{RDF_NS}}}{name}"

    def iri(name: str) -> str:
        return re.sub(r"^\{([^}]*)\}", r"\1", name)

    def node() -> Value:
        fresh[0] += 1
        return Value("z", f"_:{salt}_g{fresh[0]}")

    def resolve(value: str, at: str) -> Value:
        return Value("i", urljoin(at, value) if at and not re.match(r"[A-Za-z][\w+.\-]*:", value) else value)

    def plain(value: str, lang: str | None) -> Value:
        return Value("l", value, lang.lower()) if lang else Value("s", value)

    def subject_of(e: ET.Element, at: str) -> Value:
        if own("about") in e.attrib:
            return resolve(e.attrib[own("about")], at)
        if own("ID") in e.attrib:
            return resolve("#" + e.attrib[own("ID")], at)
        if own("nodeID") in e.attrib:
            return Value("z", f"_:{salt}_{e.attrib[own('nodeID')]}")
        return node()

    def read_node(e: ET.Element, at: str, lang: str | None) -> Value:
        at, lang = e.attrib.get(xml + "base", at), e.attrib.get(xml + "lang", lang)
        subject = subject_of(e, at)
        if e.tag != own("Description"):
            out.append((subject, Value("i", TYPE), Value("i", iri(e.tag))))
        for key, value in e.attrib.items():
            if key == own("type"):
                out.append((subject, Value("i", TYPE), resolve(value, at)))
            elif not key.startswith((xml, f"{{{RDF_NS}}}")):
                out.append((subject, Value("i", iri(key)), plain(value, lang)))
        count = 0
        for p in e:
            count += p.tag == own("li")
            read_property(subject, p, f"{RDF_NS}_{count}" if p.tag == own("li") else iri(p.tag), at, lang)
        return subject

    def read_property(subject: Value, p: ET.Element, verb: str, at: str, lang: str | None) -> None:
        at, lang = p.attrib.get(xml + "base", at), p.attrib.get(xml + "lang", lang)
        kind = p.attrib.get(own("parseType"))
        extra = {k: v for k, v in p.attrib.items() if not k.startswith((xml, f"{{{RDF_NS}}}"))}
        if kind == "Resource":
            value = node()
            for inner in p:
                read_property(value, inner, iri(inner.tag), at, lang)
        elif kind == "Collection":
            items = [read_node(x, at, lang) for x in p]
            value = Value("i", NIL)
            for item in reversed(items):
                cell = node()
                out.extend([(cell, Value("i", FIRST), item), (cell, Value("i", REST), value)])
                value = cell
        elif kind == "Literal":
            value = Value("o", (p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in p), RDF_NS + "XMLLiteral")
        elif own("resource") in p.attrib or own("nodeID") in p.attrib or extra and not len(p):
            value = resolve(p.attrib[own("resource")], at) if own("resource") in p.attrib else Value("z", f"_:{salt}_{p.attrib[own('nodeID')]}") if own("nodeID") in p.attrib else node()
            out.extend((value, Value("i", iri(k)), plain(v, lang)) for k, v in extra.items())
        elif len(p):
            value = read_node(p[0], at, lang)
        elif own("datatype") in p.attrib:
            value = typed_literal(p.text or "", resolve(p.attrib[own("datatype")], at).value)
        else:
            value = plain(p.text or "", lang)
        out.append((subject, Value("i", verb), value))

    root = ET.fromstring(text)
    at = root.attrib.get(xml + "base", base or "")
    for e in root if root.tag == own("RDF") else [root]:
        read_node(e, at, root.attrib.get(xml + "lang"))
    yield from out


def read(spark: SparkSession, form: str, params: dict, base_dir: str) -> tuple[DataFrame, list[str]]:
    from . import limit_of, plain, rdf_form, resource_path, text_of

    path = resource_path(params, base_dir)
    if form == "rdf":
        form = rdf_form(path)
    path = plain(spark, path, params)
    base = text_of(params.get("base"))
    if form in ("ntriples", "nquads"):
        df, kinds = read_lines(spark, path, form == "nquads")
    elif form == "rdfxml":
        df, kinds = read_whole(spark, path, 3, lambda t, f: xml_triples(t, f, base))
    else:
        quads = form == "trig"
        df, kinds = read_whole(spark, path, 4 if quads else 3, lambda t, f: (row if quads else row[1:] for row in Turtle(t, f, base).run()))
    if (limit := limit_of(params)) is not None:
        df = df.limit(limit)
    spec = params.get("format")
    if spec is not None and hasattr(spec, "items"):
        keep = [i for i, v in enumerate(spec.items) if str(v.value) != "skip"]
        df = df.select(*[F.col(f"c{i}").alias(f"c{j}") for j, i in enumerate(keep)])
        kinds = [kinds[i] for i in keep]
    return df, kinds
