"""The thirteen relational operators of a rule plan, as functions on DataFrames of named columns.

All have set semantics: what they give holds no row twice. Names shared by inputs are what they meet on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch_table(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A stored table, in a given column order."""
    return df.select(*(order or df.columns))


def join(*children: DataFrame) -> DataFrame:
    """Natural join; of the inputs left, one that shares columns with what is joined comes next, so products come last."""
    left, out = list(children[1:]), children[0]
    while left:
        nxt = max(left, key=lambda d: len(set(d.columns) & set(out.columns)))
        left.remove(nxt)
        on = [c for c in nxt.columns if c in out.columns]
        out = out.join(nxt, on) if on else out.crossJoin(nxt)
    return out


def union(*children: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), children).distinct()


def subtract(main: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of main that match no row of any other on that other's columns."""
    columns = main.columns
    for other in others:
        on = [c for c in other.columns if c in main.columns]
        if on:
            main = main.join(other.select(*on).distinct(), on, "left_anti")
        else:  # no shared column: any row at all matches every row
            main = main.withColumn("one_", F.lit(1)).join(F.broadcast(other.limit(1).select(F.lit(1).alias("one_"))), "one_", "left_anti").drop("one_")
    return main.select(*columns)


def project_reorder(child: DataFrame, columns: list[str]) -> DataFrame:
    return child.select(*columns).distinct()


def single(child: DataFrame, keep: list[str]) -> DataFrame:
    """One witness row for each value of the columns kept."""
    return child.dropDuplicates(keep)


def filter_rows(child: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions are true; undefined (NULL) is not true."""
    return child.where(reduce(lambda a, b: a & b, conditions)) if conditions else child


def function(child: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds computed columns; a row for which one is undefined goes."""
    for name, c in columns.items():
        child = child.withColumn(name, c).where(F.col(name).isNotNull())
    return child


def null(child: DataFrame, columns: list[str], rule: str, markers: dict[str, str] | None = None) -> DataFrame:
    """Adds fresh labelled nulls by row, named by a hash of rule, marker and row; columns of one marker share theirs."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in child.columns]
    label = lambda m: F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(rule), F.lit(m), *key), 256), 1, 32))
    return child.withColumns({c: label((markers or {}).get(c, c)) for c in columns})


def aggregate(child: DataFrame, groups: list[str], kind: str, value: str, told_apart: list[str] | None = None, out: str = "value") -> DataFrame:
    """count, sum, min or max of value over the set of (groups, value, told_apart); no row comes of no rows."""
    rows = child.select(*groups, F.col(value).alias("a_"), *[F.col(c).alias(f"x_{i}") for i, c in enumerate(told_apart or [])])
    if kind in ("count", "sum"):
        rows = rows.distinct()
    made = {"count": F.count(F.lit(1)), "sum": F.sum("a_"), "min": F.min("a_"), "max": F.max("a_")}[kind]
    keys = [F.col(g) for g in groups] or [F.lit(1).alias("one_")]
    return rows.groupBy(*keys).agg(made.alias(out)).select(*groups, out)


def incremental_import(source: DataFrame, bindings: DataFrame) -> DataFrame:
    """Only those rows of a source that can join with the bindings at hand."""
    on = [c for c in bindings.columns if c in source.columns]
    return source.join(bindings.select(*on).distinct(), on, "left_semi")


def rename(child: DataFrame, names: dict[str, str]) -> DataFrame:
    return child.withColumnsRenamed(names)


def zero(spark: SparkSession) -> DataFrame:
    """The relation without columns that holds the empty row."""
    return spark.range(1).select()
