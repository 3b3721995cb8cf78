from pyspark.sql import functions as F

from lodestone import operators as O
from lodestone.streaming import evaluate_stream


def test_operators(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(2, 9), (3, 8)], "y int, z int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(O.fetch_table(a, ["y", "x"]))[0] == (2, 1)
    assert rows(O.join(a, b).distinct()) == [(2, 1, 9), (3, 2, 8)]
    assert rows(O.union(a, a)) == [(1, 2), (2, 3)]
    assert rows(O.subtract(O.union(a, a), b.where("z = 8").select("y"))) == [(1, 2)]
    assert rows(O.subtract(a, spark.createDataFrame([(1,)], "w int"))) == []
    assert rows(O.project_reorder(a, ["y"])) == [(2,), (3,)]
    assert O.single(a, ["x"]).count() == 2
    assert rows(O.filter_rows(a, F.col("x") > 1, F.col("y") > 2).distinct()) == [(2, 3)]
    assert rows(O.function(a, {"z": F.when(F.col("x") > 1, F.col("x"))}).distinct()) == [(2, 3, 2)]
    n = O.null(O.union(a, a), ["u", "v"], "rule", {"u": "m", "v": "m"}).collect()
    assert len({r.u for r in n}) == 2 and all(r.u == r.v for r in n)
    assert rows(O.aggregate(a, ["x"], "sum", "y")) == [(1, 2), (2, 3)]
    assert rows(O.aggregate(a.where("x > 5"), [], "count", "y")) == []
    assert rows(O.incremental_import(b, a.where("x = 1"))) == [(2, 9)]
    assert O.rename(a, {"x": "k"}).columns == ["k", "y"] and O.zero(spark).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    seen = []
    query = evaluate_stream(stream, "e", "t(?x,?y) :- e(?x,?y). t(?x,?z) :- t(?x,?y), e(?y,?z).", str(tmp_path / "store"), lambda out, n: seen.append(sorted(tuple(r) for r in out["t"].collect())), checkpoint=str(tmp_path / "c"))
    query.awaitTermination(120)
    assert seen[-1] == [(1, 2), (1, 3), (2, 3)]
