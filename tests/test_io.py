import functools
import gzip
import http.server
import io
import re
import threading
import urllib.parse

import pytest

from lodestone.cli import main
from lodestone.engine import Engine
from lodestone.lang.ast import RuleError
from lodestone.lang.values import Value
from lodestone.sources import sparql


def run(spark, base, text):
    engine = Engine(spark, str(base))
    return {p: sorted(map(tuple, engine.result(p)), key=str) for p in engine.run(text)}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('foo,1,2.50\n"x y",2,3\n<http://a>,-3,"q"@en\nbad,1\n,5,1.0\n12a,7,"5"^^<http://x>\n')
    (tmp_path / "h.csv").write_text("foo,bar\n1,2\nx,3\n")
    with gzip.open(tmp_path / "z.tsv.gz", "wt") as f:
        f.write("1\ta\n2\tb\n")
    got = run(spark, tmp_path, '@import a :- csv{resource="a.csv"}. r(?x,?y,?z) :- a(?x,?y,?z). @output r.')["r"]
    assert got == [('""', 5, 1), ('"12a"', 7, '"5"^^<http://x>'), ('"x y"', 2, 3), ("<http://a>", -3, '"q"@en'), ("foo", 1, '"2.50"^^<http://www.w3.org/2001/XMLSchema#decimal>')]
    got = run(spark, tmp_path, '@import a :- csv{resource="h.csv",format=(int,int),ignore_headers=true}. @import b :- csv{resource=?f,format=(skip,string)}, ?f = "h.csv". @import c :- tsv{resource="z.tsv.gz",format=(int,string),limit=1}. r(?x) :- a(?x,_). q(?x) :- b(?x). s(?x,?y) :- c(?x,?y).')
    assert got["r"] == [(1,)] and got["q"] == [('"2"',), ('"3"',), ('"bar"',)] and len(got["s"]) == 1
    for text, code in (('@import a :- dsv{resource="a.csv"}. r(?x) :- a(?x).', 220), ('@import a :- csv{resource="a.csv",oops=1}. r(?x) :- a(?x).', 221), ('@import a :- xyz{resource="a"}. r(?x) :- a(?x).', 231), ('@import a :- csv{resource="a.csv",format=(int)}. r(?x,?y) :- a(?x,?y).', 232)):
        with pytest.raises(RuleError) as e:
            run(spark, tmp_path, text)
        assert e.value.code == code


def test_line_breaks_in_cells_and_compression(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,"x\ny"\nb,"p ""q"" r"\nc,z\n')
    (tmp_path / "packed.data").write_bytes(gzip.compress(b"1,x\n2,y\n" * 1 + b"3,z"))
    (tmp_path / "packed.nt2").write_bytes(gzip.compress(b"<http://a> <http://p> 'no' .\n<http://a> <http://p> \"yes\" .\n"))
    got = run(spark, tmp_path, '@import a :- csv{resource="b.csv",format=(string,string)}. @import b :- csv{resource="packed.data",compression=gzip,format=(int,string)}. @import c :- ntriples{resource="packed.nt2",compression=gzip}. r(?x,?y) :- a(?x,?y). s(?x,?y) :- b(?x,?y). t(?x) :- c(_,_,?x).')
    assert got["r"] == [('"a"', '"x\\ny"'), ('"b"', '"p \\"q\\" r"'), ('"c"', '"z"')]
    assert got["s"] == [(1, '"x"'), (2, '"y"'), (3, '"z"')] and got["t"] == [('"yes"',)]


@pytest.mark.parametrize(
    "spec, code",
    [('csv{resource="b.csv",compression=zip}', 226), ('csv{resource="b.csv",limit=-1}', 224), ('csv{resource="b.csv",limit="x"}', 222), ('dsv{resource="b.csv",delimiter="::"}', 225), ("csv{}", 220), ('rdf{resource="b"}', 229), ('rdf{resource="b.csv"}', 230), ('csv{resource="b.csv",format=(odd,odd)}', 223)],
)
def test_import_checks(spark, tmp_path, spec, code):
    with pytest.raises(RuleError) as e:
        run(spark, tmp_path, f"@import a :- {spec}. r(?x,?y) :- a(?x,?y).")
    assert e.value.code == code


def test_triple_escapes(spark, tmp_path):
    label = "b" * 1500
    lines = [r'"C:\\new"', r'"\\"', r'"\\u00E9 \u00E9\U0001F600 \t\"q\""', rf"_:{label}1", rf"_:{label}2", r"<http://e/\u00E9>"]
    (tmp_path / "n.nt").write_text("".join(f"<http://a> <http://p> {x} .\n" for x in lines))
    engine = Engine(spark, str(tmp_path))
    engine.run('@import a :- ntriples{resource="n.nt"}. r(?x) :- a(_,_,?x).')
    got = {row[0].value for row in engine.rows("r")}
    assert {"C:\\new", "\\", '\\u00E9 é😀 \t"q"', "http://e/é"} < got and len(got) == 6


def test_json(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"b":[1,\nnull],\n"a":true}\n')
    got = run(spark, tmp_path, '@import a :- json{resource="j.json"}. r(?v) :- a(0,"b",?x), a(?x,0,?y), a(?y,value,?v). n(#count(?x)) :- a(?x,type,_).')
    assert got["r"] == [(1,)] and got["n"] == [(5,)]


def test_rdf(spark, tmp_path):
    (tmp_path / "t.ttl").write_text('@prefix ex: <http://e/> .\nex:a\na ex:B ; ex:p 1, 2.5, "x"@en . [ ex:q (1 2) ] ex:r ex:s .')
    (tmp_path / "g.trig").write_text('@prefix ex: <http://e/> . ex:g { ex:a ex:p ex:b . } ex:c ex:d "e" .')
    (tmp_path / "n.nt").write_text('<http://a> <http://p> "x\\"y" .\n_:b <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # c\n')
    (tmp_path / "x.rdf").write_text('<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:T rdf:about="http://a"><e:p>v</e:p><e:q rdf:resource="http://b"/></e:T></rdf:RDF>')
    three = lambda f, n: run(spark, tmp_path, f'@import a :- {f}{{resource="{n}"}}. r(?x,?y,?z) :- a(?x,?y,?z).')["r"]
    assert len(three("turtle", "t.ttl")) == 10 and len(three("rdf", "t.ttl")) == 10
    assert ("<http://a>", "<http://p>", '"x\\"y"') in three("ntriples", "n.nt") and any(r[2] == 5 for r in three("rdf", "n.nt"))
    assert ("<http://a>", "<http://e/q>", "<http://b>") in three("rdf", "x.rdf")
    got = run(spark, tmp_path, '@import a :- trig{resource="g.trig"}. r(?g) :- a(?g,?x,?y,?z).')["r"]
    assert got == [("<http://e/g>",), ("DEFAULT_GRAPH",)]


def test_export_round_trip_and_cli(spark, tmp_path, capsys):
    (tmp_path / "p.rls").write_text('a(1,"x, y","q"@en). a(<http://s>,2,b). r(?x,?y,?z) :- a(?x,?y,?z). t(<http://s>,<http://p>,?y) :- a(_,?y,_). @export r :- csv{resource="r.csv"}. @export t :- ntriples{resource="t.nt"}.')
    assert main([str(tmp_path / "p.rls"), "-D", str(tmp_path / "out"), "-o", "--print-facts", "idb", "--trace", 'r(1,"x, y","q"@en)'], spark) == 0
    shown = capsys.readouterr().out
    assert 'r(1, "x, y", "q"@en) .' in shown and "a(1" in shown
    back = run(spark, tmp_path / "out", '@import b :- csv{resource="r.csv"}. @import c :- ntriples{resource="t.nt"}. r(?x,?z) :- b(?x,_,?z). n(#count(?y)) :- c(_,_,?y).')
    assert back["r"] == [("<http://s>", "b"), (1, '"q"@en')] and back["n"] == [(2,)]
    assert main([str(tmp_path / "p.rls"), "other.rls"], spark) == 1
    assert main([str(tmp_path / "missing.rls")], spark) == 1


def test_sparql(spark, tmp_path):
    """A server of one fixed table that keeps what it was asked."""
    table = [(f"http://e/{i}", i * i) for i in range(50)]
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0])

        def do_POST(self):
            self.answer(urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0])

        def answer(self, query):
            asked.append(query)
            given = set(re.findall(r"\(<([^>]*)>\)", query))
            rows = [f"<{a}>\t{b}" for a, b in table if not given or a in given]
            self.send_response(200)
            self.end_headers()
            self.wfile.write("\n".join(["?a\t?b", *rows, ""]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spec = f'@import t :- sparql{{endpoint="http://127.0.0.1:{server.server_port}/q", query="SELECT ?a ?b WHERE {{ ?a <http://e/p> ?b }}"}} . '
    try:
        assert len(run(spark, tmp_path, spec + "r(?a, ?b) :- t(?a, ?b). @output r.")["r"]) == 50 and len(asked) == 1 and "VALUES" not in asked[0]
        asked.clear()
        got = run(spark, tmp_path, spec + "wish(<http://e/3>). wish(<http://e/7>). wish(<http://e/x>). r(?a, ?b) :- wish(?a), t(?a, ?b). @output r.")["r"]
        assert got == [("<http://e/3>", 9), ("<http://e/7>", 49)] and len(asked) == 1 and "VALUES (?a)" in asked[0] and asked[0].count("<http://e/") == 4
    finally:
        server.shutdown()


def test_web_and_standard_input(spark, tmp_path, monkeypatch):
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.csv").write_text("1,x\n2,y\n")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "site"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = run(spark, tmp_path, f'@import a :- csv{{resource="http://127.0.0.1:{server.server_port}/a.csv",format=(int,string)}}. r(?x) :- a(?x,_).')
        assert got["r"] == [(1,), (2,)]
    finally:
        server.shutdown()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"7,z\n8,w\n")))
    assert run(spark, tmp_path, '@import a :- csv{resource="stdin",format=(int,string)}. r(?x) :- a(?x,_).')["r"] == [(7,), (8,)]


def test_pages_of_bindings():
    blocks = list(sparql.pages(((Value("i", f"http://{i}"),) for i in range(40_000)), ["a"]))
    assert len(blocks) == 2 and all(b.startswith("VALUES (?a) {") and len(b) < 750_000 for b in blocks) and sum(b.count("(<") for b in blocks) == 40_000
    assert sparql.selected("PREFIX e: <x> select distinct ?a ?bc { ?a ?p ?bc }") == ["a", "bc"] and sparql.selected("SELECT * WHERE {}") is None
