import random

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, evaluate
from lodestone.plans import pairs
from lodestone.queries import QUERIES


@pytest.fixture
def always(monkeypatch):
    """Every rule that can be is joined in cells, of a few rows each."""
    for name, value in (("MANY", 0), ("SPREAD", 0), ("BLOCK", 2), ("TASK", 10)):
        monkeypatch.setattr(pairs, name, value)


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,size,columns", [("self_join", 2_100, None), ("equality_join", 1_000, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])])
def test_one_large_group_is_paired_without_a_shuffle_of_pairs(spark, tmp_path, name, size, columns):
    """All suppliers, and customers, in one nation: more than four million pairs, and none is told from its like."""
    n = spark.range(size)
    n.selectExpr("id as s_suppkey", "'s' as s_name", "3 as s_nationkey", "0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(4_100).selectExpr("id as c_custkey", "'c' as c_name", "3 as c_nationkey", "0D as c_acctbal", "'m' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert "Aggregate" not in logical(got) and "Deduplicate" not in logical(got)
    assert got.count() == (size * (size - 1) if columns is None else size * 4_100)
    assert tuple(got.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first())[:2] == (0, size - 1)


def test_a_large_group_is_dealt_over_tasks(spark, monkeypatch):
    for name, value in (("MANY", 1_000), ("BLOCK", 16), ("TASK", 4_000)):
        monkeypatch.setattr(pairs, name, value)
    t = spark.range(300).selectExpr("id as a", "1 as k")
    got = evaluate(spark, "r(?a, ?b) :- t(?a, ?k), t(?b, ?k) . @output r.", {"t": t})["r"]
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90_000 and len(sizes) > 15 and max(sizes) < 20_000


RULES = {
    "r(?a, ?b) :- s(?a, ?k, _), t(?b, ?k, _) .": lambda s, t: {(a, b) for a, k, _ in s for b, l, _ in t if k == l},
    "r(?a, ?b) :- s(?a, ?k, _), s(?b, ?k, _), ?a != ?b .": lambda s, t: {(a, b) for a, k, _ in s for b, l, _ in s if k == l and a != b},
    "r(?b, 7, ?a, ?b) :- s(?a, ?x, _), t(?b, ?y, _), ?x = ?y, ?a < ?b .": lambda s, t: {(b, 7, a, b) for a, k, _ in s for b, l, _ in t if k == l and a < b},
    "r(?a, ?k, ?b) :- s(?a, ?k, _), t(?b, ?k, _), ?k > 1 .": lambda s, t: {(a, k, b) for a, k, _ in s for b, l, _ in t if k == l and k > 1},
    "r(?a, ?b) :- s(?a, ?k, ?i), t(?b, ?k, ?j), ?i < ?j .": lambda s, t: {(a, b) for a, k, i in s for b, l, j in t if k == l and i < j},
    "r(?a, ?b) :- s(?a, ?k, ?i), t(?b, ?k, ?j), ?i + ?a < ?j + ?b .": lambda s, t: {(a, b) for a, k, i in s for b, l, j in t if k == l and i + a < j + b},
    "r(?a, ?b) :- s(?a, ?k, ?i), t(?b, ?k, ?i) .": lambda s, t: {(a, b) for a, k, i in s for b, l, j in t if (k, i) == (l, j)},
    "r(?a, ?b) :- s(?a, ?k, _), t(?b, ?k, _), s(_, _, ?k) .": lambda s, t: {(a, b) for a, k, _ in s for b, l, _ in t if k == l and k in {i for _, _, i in s}},
    "r(?a, ?b) :- s(?a, ?k, _), t(?k, ?l, _), t(?b, ?l, _) .": lambda s, t: {(a, b) for a, k, _ in s for x, l, _ in t for b, m, _ in t if k == x and l == m},
    "r(?a, ?b) :- s(?a, _, ?i), t(?b, _, _), ?i > 2 .": lambda s, t: {(a, b) for a, _, i in s for b, _, _ in t if i > 2},
}


@pytest.mark.parametrize("rule", RULES)
def test_pairs_against_python(spark, always, rule):
    """Values with several keys, repeated rows, NULLs: each pair comes once."""
    r = random.Random(5)
    s, t = ([(r.randrange(12), r.randrange(6), r.randrange(5)) for _ in range(40)] for _ in "st")
    tables = {n: spark.createDataFrame(rows + rows[:5] + [(None, 1, 1), (3, None, None)], "a int, k long, i int") for n, rows in (("s", s), ("t", t))}
    assert pairs.sides(Engine(spark).load(rule).program.rules[0])
    got = [tuple(x) for x in evaluate(spark, rule + " @output r.", tables)["r"].collect()]
    want = RULES[rule](s, t)
    if "s(?a, _, " in rule:  # of a row with a NULL, what isn't used may be NULL
        want |= {(3, b) for b, *_ in t if (3, 3) in {(a, i) for a, _, i in s}}
        want |= {(a, 3) for a, _, i in s if i > 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_over_mixed_values(spark, always):
    engine = Engine(spark)
    engine.run('m(1, "x"). m(2, 5). m(3, 5). m(3, "x"). n(7, 5). n(8, 5.0). n(8, "x"@en). n(9, 5). i(10, 5). i(11, 6). r(?a, ?b) :- m(?a, ?k), n(?b, ?k). q(?a, ?b) :- m(?a, ?k), i(?b, ?k).')
    assert sorted(engine.result("r")) == [[2, 7], [2, 9], [3, 7], [3, 9]] and sorted(engine.result("q")) == [[2, 10], [3, 10]]


def test_an_atom_that_brings_nothing_filters(spark):
    """No pairs are made where a rule asks only whether there are partners."""
    t = spark.range(400).selectExpr("id as a", "id % 2 as k")
    engine = Engine(spark).register("t", t).register("u", t)
    engine.run("r(?k) :- t(_, ?k), u(_, ?k) . n(#count(?a)) :- t(?a, ?k), u(?b, ?k), ?b > 398 . @output r. @output n.")
    for p, rows in (("r", [[0], [1]]), ("n", [[200]])):
        assert "LeftSemi" in engine.explain(p) and sorted(engine.result(p)) == rows
