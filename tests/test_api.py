from lodestone import api


def test_reasoner(spark, tmp_path):
    program = api.load_string("@parameter $n = 2 . p(?x) :- q(?x), ?x >= $n . q(1). q(2).", {"n": "1 + 1"})
    assert api.output_predicates(program) == ["p"]
    r = api.Reasoner(spark, program).reason()
    assert r.result("p") == [[2]] and r.timing() and r.trace("p(2)").size() == 2
    assert r.dataframe("p", ["x"]).columns == ["x"]
    r.write_result("p", str(tmp_path / "p.csv"))
    assert [x.value for x in spark.read.text(str(tmp_path / "p.csv")).collect()] == ["2"]
