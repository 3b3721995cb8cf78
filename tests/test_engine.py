import random

import pytest

from lodestone.engine import Engine, evaluate
from lodestone.lang.ast import RuleError


def run(spark, text, **options):
    engine = Engine(spark, **options)
    return {p: sorted(map(tuple, engine.result(p)), key=str) for p in engine.run(text)}, engine


BASIC = """
w(4, 9). w(9, 9). w(6, 4). w(5, 10). w(4, 0).
either(?x) :- w(?x, _). either(?y) :- w(_, ?y).
loop(?x) :- w(?x, ?x).
nine(?x) :- w(?x, 9).
odd_ones(?x, ?y) :- w(?x, ?y), 36 / ?y != 9 .
others(?x) :- w(?x, _), ~w(?x, 9) .
unless(?x) :- w(?x, _), ~w(6, 4) .
half(?x) :- w(?x, _), ~w(?x, ?t), ?t = 2 * ?x .
plus(?x, ?z) :- w(?x, ?y), ?z = ?x + ?y .
chain(?z) :- w(?x, ?y), ?u = ?x * 3, ?z = ?u - ?y .
"""


def test_relational(spark):
    got, _ = run(spark, BASIC)
    w = {(4, 9), (9, 9), (6, 4), (5, 10), (4, 0)}
    assert {x for x, in got["either"]} == {z for row in w for z in row}
    assert {x for x, in got["loop"]} == {x for x, y in w if x == y}
    assert {x for x, in got["nine"]} == {x for x, y in w if y == 9}
    assert set(got["odd_ones"]) == {(x, y) for x, y in w if y and 36 // y != 9}
    assert {x for x, in got["others"]} == {x for x, _ in w if (x, 9) not in w}
    assert got["unless"] == []
    assert {x for x, in got["half"]} == {x for x, _ in w if (x, 2 * x) not in w}
    assert set(got["plus"]) == {(x, x + y) for x, y in w}
    assert {z for z, in got["chain"]} == {3 * x - y for x, y in w}


AGGREGATES = """
c(#count(?x, ?y)) :- d(?x, ?y, _).
s(?x, #sum(?y)) :- d(?x, ?y, _).
t(?x, ?x + #sum(?y * ?z)) :- d(?x, ?y, ?z).
u(?x, #sum(?y, ?z)) :- d(?x, ?y, ?z).
m(#max(?x)) :- d(?x, _, _).
g(MAX(0, ?y - ?x), #count(?z)) :- d(?x, ?y, ?z).
z(#count(?x)) :- d(?x, _, _), ?x > 100 .
o(#sum(?y, ?x)) :- d(?x, ?y, _), ?x = 3 .
w(#sum(?q)) :- v(?q). v(7). v(0.25). v(word).
k(#count(?q)) :- v(?q).
"""


def test_aggregates_over_sets(spark):
    r = random.Random(12)
    d = {(r.randrange(-3, 5), r.randrange(6), r.randrange(9)) for _ in range(40)} | {(3, 1, 1), (3, 2, 1)}
    got, _ = run(spark, " ".join(f"d({x},{y},{z})." for x, y, z in d) + AGGREGATES)
    first = {x for x, _, _ in d}
    assert got["c"] == [(len({(x, y) for x, y, _ in d}),)]
    assert set(got["s"]) == {(x, sum({b for a, b, _ in d if a == x})) for x in first}
    assert set(got["t"]) == {(x, x + sum({b * c for a, b, c in d if a == x})) for x in first}
    assert set(got["u"]) == {(x, sum(b for b, c in {(b, c) for a, b, c in d if a == x})) for x in first}
    assert got["m"] == [(max(first),)] and got["z"] == []
    assert set(got["g"]) == {(n, len({c for a, b, c in d if max(0, b - a) == n})) for n in {max(0, b - a) for a, b, _ in d}}
    assert got["o"] == [(sum({b for a, b, _ in d if a == 3}),)]
    assert got["w"] == [(7.25,)] and got["k"] == [(3,)]


def nulls(rows):
    names = {}
    return [tuple(names.setdefault(x, f"n{len(names)}") if str(x).startswith("_:") else x for x in row) for row in rows]


def test_chase(spark):
    owns = "owns(pip, pip). owns(ada, key). owns(key, lock). "
    got, _ = run(spark, owns + "safe(?x, ?x) :- owns(?x, ?x). safe(?x, !box) :- owns(?x, _).")
    assert sorted(nulls(got["safe"])) == [("ada", "n0"), ("key", "n1"), ("pip", "pip")]
    got, _ = run(spark, owns + "safe(?x, ?x) :- owns(?x, ?x). safe(?x, !box) :- owns(?x, _).", skolem=True)
    assert sorted(nulls(got["safe"])) == [("ada", "n0"), ("key", "n1"), ("pip", "n2"), ("pip", "pip")]
    got, _ = run(spark, owns + "in(?x, !b), of(!b, ?y), thing(?y) :- owns(?x, ?y). twin(!t, !t) :- owns(?x, ?y).")
    assert len(got["in"]) == 3 and {x[1] for x in got["in"]} == {x[0] for x in got["of"]} and len(got["thing"]) == 3
    assert len(got["twin"]) == 1 and got["twin"][0][0] == got["twin"][0][1]
    got, _ = run(spark, "man(eve). mother(?x, !m) :- man(?x). man(?m) :- mother(?x, ?m), first(?x). first(eve).")
    assert len(got["mother"]) == 2 and len(got["man"]) == 2
    with pytest.raises(RuleError):
        run(spark, "next(0, 1). next(?y, !z) :- next(?x, ?y).", max_steps=6)


@pytest.mark.parametrize("broadcast_rows", [20_000, 0, 5])
def test_chase_over_new_rows(spark, broadcast_rows):
    """A cell for every path of a graph without cycles: each step meets only what the last one added."""
    r = random.Random(7)
    edges = {(a, b) for a in range(9) for b in range(a + 1, 9) if r.random() < 0.35} | {(0, 1), (1, 2), (2, 3)}
    facts = " ".join(f"edge({a},{b})." for a, b in edges)
    rules = "cell(!c, ?x, none) :- root(?x). root(0). cell(!d, ?y, ?c) :- cell(?c, ?x, _), edge(?x, ?y). ends(?y, #count(?c)) :- cell(?c, ?y, _). sure(?c, ?y) :- cell(?c, ?y, ?p), seen(?p). seen(?p) :- cell(?p, 0, none). seen(?c) :- sure(?c, _). n(#count(?c)) :- sure(?c, _)."
    got, _ = run(spark, facts + rules, broadcast_rows=broadcast_rows)
    paths = {0: 1}
    for b in range(1, 9):
        paths[b] = sum(paths[a] for a in range(b) if (a, b) in edges)
    assert dict(got["ends"]) == {k: n for k, n in paths.items() if n}
    assert got["n"] == [(sum(paths.values()) - 1,)]


def test_recursion_against_python(spark):
    r = random.Random(3)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(22)}
    closure = set(edges)
    while True:
        more = {(a, d) for a, b in closure for c, d in edges if b == c} - closure
        if not more:
            break
        closure |= more
    facts = " ".join(f"e({a},{b})." for a, b in edges)
    got, _ = run(spark, facts + "t(?x,?y) :- e(?x,?y). t(?x,?z) :- t(?x,?y), t(?y,?z). n(?x) :- e(?x,_), ~t(?x,?x). @output t, n.")
    assert set(got["t"]) == closure
    assert {x for x, in got["n"]} == {a for a, _ in edges} - {a for a, b in closure if a == b}


def test_mixed_columns(spark):
    got, _ = run(spark, 'mix(kind,"a text"). mix(3,17). mix(8,0.5). mix(5,"y"@fr). r(?x) :- mix(?x,_). s(?y + 1) :- mix(_,?y). t(?y) :- mix(_,?y), ?y > 0 . j(?x) :- mix(?x,_), eight(?x). eight(8). eight("8"). eight(8.0).')
    assert set(got["r"]) == {(3,), (8,), (5,), ("kind",)}
    assert got["s"] == [(1.5,), (18,)] and got["t"] == [(0.5,), (17,)] and got["j"] == [(8,)]


def test_registered_tables_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k int, s string")
    got = evaluate(spark, "r(?k) :- t(?k, _). q(?s) :- t(_, ?s). @output r, q.", {"t": df})
    assert sorted(x[0] for x in got["r"].collect()) == [1, 3] and sorted(x[0] for x in got["q"].collect()) == ["a", "b"]


def test_trace(spark):
    _, engine = run(spark, 'a(1,2). a(2,3). t(?x,?y) :- a(?x,?y). #[name("step")] t(?x,?z) :- t(?x,?y), a(?y,?z).', tracing=True)
    found = engine.trace("t(1,3)")
    assert found.rule.name == "step" and found.size() == 4 and "a(2, 3)" in found.ascii()
    assert engine.trace("t(3,1)") is None
    assert found.json() and found.graphml().count("<node") == 4


def test_trace_names_what_has_no_name(spark):
    _, engine = run(spark, "pair(1,2). pair(3,4). left(?x) :- pair(?x,_). top(?x) :- left(?x), pair(?x,_).", tracing=True)
    found = engine.trace("top(3)")
    assert [str(c.fact.args[-1].value) for c in found.children] == ["3", "4"] and found.size() == 4 and list(found.assignment) == ["x"]


def test_trace_of_tables(spark):
    _, engine = run(spark, "road(1,2). road(2,3). road(2,4). road(7,8). road(8,9). way(?x,?y) :- road(?x,?y). far(?x,?z) :- way(?x,?y), road(?y,?z), ~shut(?y). shut(9).", tracing=True)
    assert sorted(t.fact.args[1].value for t in engine.trace_predicates(["far"])) == [3, 4, 9]
    shape = engine.trace_tree(["far(1,3)", "far(7,9)"])
    assert [c.pred for c in shape.children] == ["way", "road"] and [c.pred for c in shape.children[0].children] == ["road"]
    assert shape.to_dict()["children"][1]["facts"] == ["road(2, 3)", "road(8, 9)"]
    assert engine.trace_tree(["far(1,3)", "far(1,9)"]) is None
    tables = {at: {tuple(r) for r in df.collect()} for at, df in engine.trace_node(shape).items()}
    assert tables[()] == {(1, 3), (1, 4), (7, 9)} and tables[(0,)] == tables[(0, 0)] == {(1, 2), (7, 8)} and tables[(1,)] == {(2, 3), (2, 4), (8, 9)}


def test_trace_of_an_aggregate_is_whole(spark):
    facts = " ".join(f"a({1 + (i > 25)}, {i})." for i in range(1, 31))
    _, engine = run(spark, facts + " c(?g, #count(?x)) :- a(?g, ?x). d(?g + 1, #sum(?x)) :- a(?g, ?x).", tracing=True)
    for fact, group in (("c(1, 25)", range(1, 26)), ("d(2, 325)", range(1, 26)), ("d(3, 140)", range(26, 31))):
        assert sorted(c.fact.args[1].value for c in engine.trace(fact).children) == list(group)


def test_plan_pushes_filters_and_columns(spark, tmp_path):
    spark.range(10).selectExpr("id as a", "id as b", "id as c").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark).register("t", spark.read.parquet(str(tmp_path / "t")))
    engine.run("r(?a) :- t(?a, 3, _).")
    plan = engine.explain("r")
    assert "EqualTo(b,3)" in plan and "c:bigint" not in plan
