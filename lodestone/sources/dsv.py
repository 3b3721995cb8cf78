"""Delimiter-separated values: lines of the wrong width, and cells that a column's format can't read, drop the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import ANY, STRUCT
from ..functions.library import finite
from ..lang.ast import RuleError, Tuple_
from ..lang.values import XSD

FORMATS = {"any": ANY, "string": "s", "int": "n", "double": "d", "float": "f", "skip": None}


def struct_value(k: str, **parts: Column) -> Column:
    fields = (("n", "bigint"), ("d", "double"), ("s", "string"), ("x", "string"))
    return F.struct(F.lit(k).alias("t"), *[(parts.get(f) if f in parts else F.lit(None).cast(t)).alias(f) for f, t in fields])


def any_value(df: DataFrame, cell: str, out: str) -> DataFrame:
    """A cell by the look of it: IRI, number, quoted literal, name, full IRI or else text.

    Its parts are columns of their own first, so that no pattern is matched twice and generated code stays small.
    """
    c, plain, tag, kind, whole = (f"{out}_{x}" for x in ("c", "plain", "tag", "kind", "whole"))
    quoted = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?$'
    df = df.withColumn(c, F.trim(F.coalesce(F.col(cell), F.lit(""))))
    first = F.substring(F.col(c), 1, 1)
    is_quoted = (first == '"') & F.col(c).rlike(quoted)
    part = lambda k: F.when(is_quoted, F.regexp_extract(c, quoted, k))
    df = df.withColumns({plain: F.replace(part(1), F.lit('\\"'), F.lit('"')), tag: part(2), kind: part(3), whole: F.when(F.col(c).rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(c, r"\.0*$", ""))})
    text, number = F.col(plain), F.col(whole).try_cast("bigint")
    typed_int = F.when(F.col(kind).isin(*[XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger")]), text.try_cast("bigint"))
    typed_double = F.when(F.col(kind) == XSD + "double", finite(text.try_cast("double")))
    value = (
        F.when(F.col(c) == "", struct_value("s", s=F.lit("")))
        .when(number.isNotNull(), struct_value("n", n=number))
        .when(F.col(whole).isNotNull(), struct_value("o", s=F.col(c), x=F.lit(XSD + "integer")))
        .when(F.col(c).rlike(r"^[+-]?\d*\.\d+$"), struct_value("o", s=F.col(c), x=F.lit(XSD + "decimal")))
        .when(F.col(tag) != "", struct_value("l", s=text, x=F.lower(tag)))
        .when(typed_int.isNotNull(), struct_value("n", n=typed_int))
        .when(typed_double.isNotNull(), struct_value("d", d=typed_double))
        .when((F.col(kind) == XSD + "boolean") & text.isin("true", "false", "1", "0"), struct_value("b", n=text.isin("true", "1").cast("bigint")))
        .when((F.col(kind) != "") & (F.col(kind) != XSD + "string"), struct_value("o", s=text, x=F.col(kind)))
        .when(text.isNotNull(), struct_value("s", s=text))
        .when(F.col(c).rlike(r"^<[^<>\s]*>$"), struct_value("i", s=F.expr(f"substring({c}, 2, length({c}) - 2)")))
        .when(F.col(c).rlike(r"^\p{L}[\p{L}\p{N}_%]*$") | F.col(c).rlike(r'^[A-Za-z][A-Za-z0-9+.\-]*:[^\s"]+$'), struct_value("i", s=F.col(c)))
        .otherwise(struct_value("s", s=F.coalesce(F.col(cell), F.lit(""))))
        .cast(STRUCT)
    )
    return df.withColumn(out, value).drop(c, plain, tag, kind, whole)


def formats_of(params: dict, arity: int | None) -> list[str] | None:
    spec = params.get("format")
    if spec is None:
        return ["any"] * arity if arity else None
    names = [str(v.value) for v in spec.items] if isinstance(spec, Tuple_) else [str(spec.value)]
    for n in names:
        if n not in FORMATS:
            raise RuleError(f"no column format is named {n}", 223)
    return names


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes. Where none has, no cell holds a line break, and files can be read in splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).take(1))


def read(spark: SparkSession, form: str, params: dict, base_dir: str, arity: int | None) -> tuple[DataFrame, list[str]]:
    from . import delimiter, limit_of, plain, resource_path, text_of

    sep, limit = delimiter(params, form), limit_of(params)
    flag = lambda name, default: str(text_of(params.get(name), default)).lower() in ("true", "1")
    formats = formats_of(params, arity)
    if formats is None:
        raise RuleError("an import's number of columns isn't known", 232)
    width = len(formats)
    options = {"sep": sep, "header": str(flag("ignore_headers", False)).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_", "escape": '"', "enforceSchema": "true", "emptyValue": "", "nullValue": "\u0000"}
    path = plain(spark, resource_path(params, base_dir), params)
    if not flag("quoting", True):
        options["quote"] = ""
    elif breaks_in_quotes(spark, path):
        options["multiLine"] = "true"
    fields = ", ".join(f"f{i} string" for i in range(width))
    df = spark.read.options(**options).schema(f"{fields}, bad_ string").csv(path)
    if limit is not None:
        df = df.limit(limit)
    # a record with too few or too many fields is marked; reading all fields keeps the mark right
    df = df.where(F.col("bad_").isNull())
    columns, kinds, partial = [], [], []
    for i, f in enumerate(formats):
        if f == "skip":
            continue
        name = f"c{len(columns)}"
        if f == "any":
            df = any_value(df, f"f{i}", name)
        else:
            cell = F.coalesce(F.col(f"f{i}"), F.lit(""))
            if f == "string":
                c = cell
            elif f == "int":
                c = F.when(F.trim(cell).rlike(r"^[+-]?\d+$"), F.trim(cell).try_cast("bigint"))
            else:
                c = finite(F.trim(cell).try_cast("double" if f == "double" else "float"))
            df = df.withColumn(name, c)
            if f != "string":
                partial.append(name)
        columns.append(name)
        kinds.append(FORMATS[f])
    df = df.select(*columns)
    return (df.na.drop(subset=partial) if partial else df), kinds
