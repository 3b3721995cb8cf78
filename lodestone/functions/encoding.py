"""How values are kept in columns.

A column all of whose values are of one domain is a plain Spark column of that domain's type; its *kind* is
the domain's tag. Only a column of several domains (kind ``*``) is a struct of tag and payload, kept
canonical so that equal structs are equal values. SQL NULL means *undefined* and never outlives a rule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.values import RDF, XSD, Value

ANY = "*"
PAIR = "struct<v:string,x:string>"
STRUCT = "struct<t:string,n:bigint,d:double,s:string,x:string>"
TYPES = {"n": "bigint", "d": "double", "f": "float", "s": "string", "i": "string", "b": "boolean", "z": "string", "l": PAIR, "o": PAIR, "u": "decimal(20,0)", ANY: STRUCT}


class Col(NamedTuple):
    c: Column
    k: str


def join_kinds(*kinds: str | None) -> str | None:
    known = {k for k in kinds if k}
    return None if not known else known.pop() if len(known) == 1 else ANY


def literal(v: Value) -> Col:
    if v.tag in "lo":
        return Col(F.struct(F.lit(v.value).alias("v"), F.lit(v.extra).alias("x")).cast(PAIR), v.tag)
    return Col(F.lit(v.value).cast(TYPES[v.tag]), v.tag)


def to_any(col: Col) -> Column:
    c, k = col
    if k == ANY:
        return c
    null = lambda t: F.lit(None).cast(t)
    n = c.cast("bigint") if k in "nb" else null("bigint")
    d = c.cast("double") if k in "df" else null("double")
    s = c if k in "siz" else c["v"] if k in "lo" else c.cast("string") if k == "u" else null("string")
    x = c["x"] if k in "lo" else null("string")
    return F.when(c.isNotNull(), F.struct(F.lit(k).alias("t"), n.alias("n"), d.alias("d"), s.alias("s"), x.alias("x")))


def from_any(c: Column, k: str) -> Column:
    """The payload where the tag is k, NULL elsewhere."""
    value = {"n": c["n"], "d": c["d"], "f": c["d"].cast("float"), "b": c["n"] == 1}.get(k, c["s"])
    if k == "u":
        value = c["s"].try_cast("decimal(20,0)")
    if k in "lo":
        value = F.struct(c["s"].alias("v"), c["x"].alias("x"))
    return F.when(c["t"] == k, value)


def as_kind(col: Col, k: str) -> Column:
    if col.k == k:
        return col.c
    return to_any(col) if k == ANY else from_any(col.c, k) if col.k == ANY else F.lit(None).cast(TYPES[k])


def equal(a: Col, b: Col) -> Column:
    """Strict equality: never true across domains; NULL where an argument is undefined."""
    if a.k == b.k:
        return a.c == b.c
    if ANY in (a.k, b.k):
        return to_any(a) == to_any(b)
    return F.when(a.c.isNotNull() & b.c.isNotNull(), F.lit(False))


def python_value(raw, k: str) -> Value:
    if k == ANY:
        t = raw["t"]
        inner = raw["n"] if t == "n" else raw["d"] if t in "df" else bool(raw["n"]) if t == "b" else int(raw["s"]) if t == "u" else raw["s"]
        return Value(t, inner, raw["x"])
    if k in "lo":
        return Value(k, raw["v"], raw["x"])
    return Value(k, int(raw) if k in "nu" else raw)


def raw_value(v: Value, k: str):
    """The row field for a value in a column of kind k."""
    if k == ANY:
        t = v.tag
        return Row(t=t, n=int(v.value) if t in "nb" else None, d=float(v.value) if t in "df" else None, s=str(v.value) if t in "sizlou" else None, x=v.extra)
    if k in "lo":
        return Row(v=v.value, x=v.extra)
    if k == "u":
        from decimal import Decimal

        return Decimal(v.value)
    return v.value


def schema(kinds: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T._parse_datatype_string(TYPES[k])) for i, k in enumerate(kinds)])


def adopt(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """A user's DataFrame as positional native columns: integers widen, decimals become doubles, timestamps dates."""
    columns, kinds = [], []
    for i, f in enumerate(df.schema.fields):
        c, t = df[f"`{f.name}`"], f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c, k = c.cast("bigint"), "n"
        elif isinstance(t, T.DecimalType):
            c, k = c.cast("double"), "d"
        elif isinstance(t, T.DoubleType):
            k = "d"
        elif isinstance(t, T.FloatType):
            k = "f"
        elif isinstance(t, T.BooleanType):
            k = "b"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            date = isinstance(t, T.DateType)
            c = F.when(c.isNotNull(), F.struct(F.date_format(c, "yyyy-MM-dd" if date else "yyyy-MM-dd'T'HH:mm:ss").alias("v"), F.lit(XSD + ("date" if date else "dateTime")).alias("x")))
            k = "o"
        elif isinstance(t, T.StringType):
            k = "s"
        elif isinstance(t, T.StructType) and {x.name for x in t.fields} == {"t", "n", "d", "s", "x"}:
            k = ANY
        else:
            c, k = F.to_json(F.struct(c.alias("v"))), "s"
        if k in "df":
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        columns.append(c.alias(f"c{i}"))
        kinds.append(k)
    return df.select(*columns), kinds


def datatype(col: Col) -> Column:
    c, k = col
    if k == ANY:
        out = F.lit(None).cast("string")
        for t in "ndfsiblou":
            out = F.when(c["t"] == t, datatype(Col(from_any(c, t), t))).otherwise(out)
        return out
    if k == "n":
        return F.when(c.isNotNull(), F.when(c.between(-(1 << 31), (1 << 31) - 1), XSD + "int").otherwise(XSD + "long"))
    if k == "o":
        return c["x"]
    name = {"d": XSD + "double", "f": XSD + "float", "s": XSD + "string", "i": XSD + "anyURI", "b": XSD + "boolean", "l": RDF + "langString", "u": XSD + "unsignedLong"}.get(k)
    return F.when(c.isNotNull(), F.lit(name).cast("string"))


def number_text(c: Column) -> Column:
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(c.cast("string"))


def lexical(col: Col) -> Column:
    c, k = col
    if k == ANY:
        out = c["s"]
        for t in "ndfb":
            out = F.when(c["t"] == t, lexical(Col(from_any(c, t), t))).otherwise(out)
        return out
    return number_text(c) if k in "df" else c["v"] if k in "lo" else c.cast("string")


def quote(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def canonical_text(col: Col) -> Column:
    """The compact syntax of exports and fullStr, as a string column."""
    c, k = col
    if k == ANY:
        out = F.lit(None).cast("string")
        for t in "ndfsibzlou":
            out = F.when(c["t"] == t, canonical_text(Col(from_any(c, t), t))).otherwise(out)
        return out
    text = lexical(col)
    if k in "nz":
        return text
    if k == "s":
        return quote(c)
    if k == "i":
        return F.when(c.rlike(r"^\p{L}[\p{L}\p{N}_%]*$"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    if k == "l":
        return F.concat(quote(text), F.lit("@"), c["x"])
    return F.concat(quote(text), F.lit("^^<"), datatype(col), F.lit(">"))
