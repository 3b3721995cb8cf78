"""Mixing sources to target weights by entropy balancing, on DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import prepare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # no document is taken more often, and no source's target is above so many times its size
TOLERANCE = 1e-9
MAX_NEWTON = 60
BUCKETS = 4096  # parts into which one rounding level cuts an interval; two levels leave 2**-24


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight in code-point order (null last), capped, the excess reshared.

    A source is capped exactly if the common level (words per weight) times its weight reaches its cap, so after
    sorting by size per weight the level is found from running sums: one window over the sources, a row each.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("cap", most * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy(F.lit(0))
    summed = (
        ranked.withColumn("whole", F.sum("source_size").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"])
    )
    return summed.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def tilted(size: Column, tilt: Column, mean: Column, most: float = MOST) -> Column:
    """Copies per document: exp(tilt * size / mean size), at most ``most``."""
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(40.0), tilt * size / mean)))


def entropy_balance(sized: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """source, mean, tilt: the dual variable of each source's token constraint.

    Minimising sum r log r - r over rates 0 <= r <= most under sum(r * size) = target gives r = min(most,
    exp(tilt * size)), and the dual's derivative in tilt is the constraint's gap; Newton steps, kept inside a
    bracket, run for all sources at once over counts of equal sizes. Each round is one aggregation; only the
    greatest relative gap reaches the driver.
    """
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    same = F.col("source").eqNullSafe(F.col("s"))
    state = means.join(targets.withColumnRenamed("source", "s"), same).select("source", "mean", "target", (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("all"))
    state = state.select("source", "mean", "target", "all", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("gap")).checkpoint()
    for _ in range(MAX_NEWTON):
        now = counts.join(state.where("not all").withColumnRenamed("source", "s"), same)
        rate = tilted(F.col("size"), F.col("tilt"), F.col("mean"), most)
        x = F.col("size") / F.col("mean")
        sums = now.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("mean", "target", "all", "tilt", "lo", "hi")],
        )
        over = F.col("taken") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.try_divide(F.col("target") - F.col("taken"), F.col("slope"))))
        wide = F.when(over, F.col("tilt") * 2 - 8 - F.abs("tilt")).otherwise(F.col("tilt") * 2 + 8 + F.abs("tilt"))
        middle = F.when(F.col("new_lo").isNotNull() & F.col("new_hi").isNotNull(), (F.col("new_lo") + F.col("new_hi")) / 2).otherwise(F.col("wide"))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.coalesce("new_lo", F.lit(float("-inf")))) & (F.col("newton") < F.coalesce("new_hi", F.lit(float("inf"))))
        gap = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        state = (
            sums.select("source", "mean", "target", "all", "tilt", lo.alias("new_lo"), hi.alias("new_hi"), newton.alias("newton"), wide.alias("wide"), gap.alias("gap"))
            .select("source", "mean", "target", "all", F.when(F.col("gap") <= tolerance, F.col("tilt")).when(inside, F.col("newton")).otherwise(middle).alias("tilt"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "gap")
            .unionByName(state.where("all"))
            .checkpoint()
        )
        worst = state.where("not all").agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "mean", F.when(F.col("all"), F.lit(None).cast("double")).otherwise(F.col("tilt")).alias("tilt"))


def rounded(sized: DataFrame, by_source: DataFrame, most: int) -> DataFrame:
    """sized with what its source's row in by_source (s, source_size, target, mean, tilt) makes of it: rate, base, place, large and open."""
    return (
        sized.join(by_source, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("rate", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce(tilted(F.col("size"), F.col("tilt"), F.col("mean"), float(most)), F.lit(float(most)))))
        .withColumn("base", F.floor("rate"))
        .withColumn("place", (F.pmod("draw", F.lit(1 << 52)).cast("double") / float(1 << 52) - (F.col("rate") - F.col("base")) + 1) / 2)
        .withColumn("large", F.col("size") > F.col("mean"))
        .withColumn("open", (F.col("base") < most) & (F.col("size") > 0))
    )


def up(large: bool, cut: str) -> Column:
    """1 for a row that its cut rounds up."""
    return F.when(F.col("open") & (F.col("large") == large) & (F.col("place") < F.col(cut)), 1).otherwise(0)


def copied(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = True) -> DataFrame:
    """docs as one struct column ``doc`` (null unless ``whole``), with doc_id, source, size, source_size, target and copies of every row; see mix_sources.

    Everything but one row a source is worked out on the row itself, so docs never go through a shuffle.
    """
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(docs[id_col].cast("long"), F.xxhash64(docs[text_col]))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.lit(None)
    rows = docs.select(doc.alias("doc"), docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit("round"), own, size).alias("draw"))
    sized = rows.select("doc_id", "source", "size", "draw").checkpoint()
    if not whole:
        rows = sized.withColumn("doc", F.lit(None))
    targets = source_targets(sized, weights, most).checkpoint()
    balanced = entropy_balance(sized, targets, float(most)).checkpoint()
    goals = targets.join(balanced.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").checkpoint()
    rated = rounded(sized, small(goals), most)
    above = rated.where("large").groupBy("source").agg(F.sum((F.col("rate") - F.col("base")) * F.col("size")).alias("need"))
    high = lowest_places(rated.where("open and large").select("source", "size", "place"), above).withColumnRenamed("cut", "cut_large")
    goals = goals.join(high.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").checkpoint()
    rated = rounded(sized, small(goals), most)
    left = rated.groupBy("source").agg((F.first("target") - F.sum((F.col("base") + up(True, "cut_large")) * F.col("size"))).alias("need"))
    low = lowest_places(rated.where("open and not large").select("source", "size", "place"), left).withColumnRenamed("cut", "cut_small")
    goals = goals.join(low.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").checkpoint()
    copies = (F.col("base") + up(True, "cut_large") + up(False, "cut_small")).cast("long")
    return rounded(rows, small(goals), most).select("doc", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row; taken = copies * size.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0). A source's target is its weight's share of all
    sizes (weights repeat over sources in code-point order, null last), at most ``most`` times its size, the excess
    reshared. Rates come from entropy_balance; fractions are rounded by a hash of the id (of the text where there is
    none): those documents go up whose hash lies furthest below the fraction, first of those above their source's
    mean size, as many as come nearest to what their fractions add up to, then of the others, as many as bring the
    source nearest to its target. The cuts are found by counting in buckets, so no source is ever sorted or gathered.
    Documents of size 0 take 0. Rows that repeat an id and a size round alike. Other columns are ignored; an empty
    table gives an empty result. Reruns agree.
    """
    mixed = copied(docs, weights, most, id_col, text_col, source_col, False)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs, all its columns as they are, as often as mix_sources takes it."""
    mixed = copied(docs, weights, most, id_col, text_col, source_col).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def small(by_source: DataFrame) -> DataFrame:
    """A table with a row a source, its key as s: broadcast if it has few rows, joined by shuffle if not."""
    renamed = by_source.withColumnRenamed("source", "s")
    return F.broadcast(renamed) if by_source.count() <= 10_000 else renamed


def lowest_places(rows: DataFrame, needs: DataFrame, levels: int = 2) -> DataFrame:
    """source, cut: the rows of source with place below cut have sizes that add up nearest to its need.

    Each level counts sizes in BUCKETS parts of the interval in which the sum passes the need and goes on inside
    the part where it does; the last part, nearly always one row, goes in if that is nearer.
    """
    cut = needs.select("source", "need", F.lit(0.0).alias("from"), F.lit(1.0).alias("width"), F.lit(0).cast("long").alias("last")).checkpoint()
    for _ in range(levels):
        low = small(cut.drop("last"))
        inside = rows.join(low, F.col("source").eqNullSafe(F.col("s"))).where("place >= from and place < from + width")
        bucket = inside.groupBy("source", "need", "from", "width", F.least(F.floor((F.col("place") - F.col("from")) / F.col("width") * BUCKETS), F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("size").alias("w"))
        run = Window.partitionBy("source", "need", "from", "width").orderBy("b")
        stepped = bucket.withColumn("upto", F.sum("w").over(run)).withColumn("before", F.col("upto") - F.col("w"))
        # the first part that passes the need; where none does, everything inside goes in
        found = stepped.groupBy("source", "need", "from", "width").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("b", "before", "upto"))).alias("x"))
        found = found.select(
            F.col("source").alias("s2"),
            F.when(F.col("x").isNull(), F.col("need")).otherwise(F.col("need") - F.col("x.before")).alias("need2"),
            F.when(F.col("x").isNull(), F.col("from") + F.col("width")).otherwise(F.col("from") + F.col("x.b") * F.col("width") / BUCKETS).alias("from2"),
            F.when(F.col("x").isNull(), F.lit(0.0)).otherwise(F.col("width") / BUCKETS).alias("width2"),
            (F.col("x.upto") - F.col("x.before")).alias("last2"),
        )
        cut = (
            cut.drop("last")
            .join(found, F.col("source").eqNullSafe(F.col("s2")), "left")
            .select("source", F.coalesce("need2", "need").alias("need"), F.coalesce("from2", "from").alias("from"), F.coalesce("width2", F.lit(0.0)).alias("width"), F.coalesce("last2", F.lit(0)).cast("long").alias("last"))
            .checkpoint()
        )
    return cut.select("source", F.when(F.col("need") * 2 >= F.greatest(F.col("last"), F.lit(1)), F.col("from") + F.col("width")).otherwise(F.col("from")).alias("cut"))
