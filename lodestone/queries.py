"""Registered queries: rule programs over the star-schema tables, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators
from .engine import Engine
from .lang.ast import RuleError
from .plans.storage import shared_folder
from .plans.trace import Shape

#: The columns that stand for a predicate's arguments, in order.
TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type", "value"],
}


@dataclass(frozen=True)
class RuleQuery:
    program: str
    output: str
    columns: tuple[str, ...]
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name, columns in TABLES.items():
            if f"{name}(" in self.program:
                engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns)
        engine.run(self.program, outputs=[self.output])
        return engine.relation(self.output, list(self.columns))


def q(program: str, output: str, columns: str, sql: str) -> RuleQuery:
    return RuleQuery(program, output, tuple(columns.split()), sql)


LINE = "lineitem(?o, ?p, ?s, ?n, ?q, ?e, ?d, ?f, ?t)"
#: from a part to one that the same supplier delivers later in the same order: a sparse graph over all lines at every size
EDGES = "edge(?x, ?y) :- lineitem(?o, ?x, ?s, ?i, _, _, _, _, _), lineitem(?o, ?y, ?s, ?j, _, _, _, _, _), ?i < ?j ."
EDGES_SQL = "edge(x, y) AS (SELECT DISTINCT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b USING (l_orderkey, l_suppkey) WHERE a.l_linenumber < b.l_linenumber)"

QUERIES: dict[str, RuleQuery] = {
    "flagship_customer_spend": q("big(?c, ROUND(#sum(?p, ?o) * 100) / 100) :- orders(?o, ?c, _, ?p, _), ?p > 1000 .", "big", "c spend", "SELECT o_custkey AS c, round(sum(o_totalprice) * 100) / 100 AS spend FROM orders WHERE o_totalprice > 1000 GROUP BY 1"),
    "projection_reorder": q("r(?s, ?c) :- orders(_, ?c, ?s, _, _) .", "r", "s c", "SELECT DISTINCT o_orderstatus AS s, o_custkey AS c FROM orders"),
    "equi_join_three_way": q("r(?n, ?m, ?s) :- customer(?c, _, ?k, _, ?s), nation(?k, ?n, ?g), region(?g, ?m) .", "r", "n m s", "SELECT DISTINCT n_name AS n, r_name AS m, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_aggregate_three_way": q(
        "rev(?n, ROUND(#sum(?v, ?o, ?l))) :- lineitem(?o, _, ?s, ?l, _, ?e, ?d, _, _), supplier(?s, _, ?k, _), nation(?k, ?n, _), ?v = ?e * (1.0 - ?d) .",
        "rev", "n revenue",
        "SELECT n_name AS n, round(sum(v)) AS revenue FROM (SELECT DISTINCT n_name, l_extendedprice * (1.0 - l_discount) AS v, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1",
    ),
    "theta_join": q("r(?a, ?b) :- nation(?x, ?a, ?g), nation(?y, ?b, ?g), ?x < ?y .", "r", "a b", "SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey"),
    "cross_product": q("r(?a, ?b) :- region(_, ?a), region(_, ?b) .", "r", "a b", "SELECT DISTINCT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "self_join": q("r(?a, ?b) :- supplier(?a, _, ?k, _), supplier(?b, _, ?k, _), ?a != ?b .", "r", "a b", "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey"),
    "equality_join": q("r(?a, ?b) :- supplier(?a, _, ?x, _), customer(?b, _, ?y, _, _), ?x = ?y .", "r", "a b", "SELECT DISTINCT s_suppkey AS a, c_custkey AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey"),
    "union_rules": q("r(?k) :- supplier(_, _, ?k, ?b), ?b > 5000 . r(?k) :- customer(_, _, ?k, ?b, _), ?b > 9000 .", "r", "k", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000"),
    "intersection": q("r(?k) :- supplier(_, _, ?k, _), customer(_, _, ?k, _, _) .", "r", "k", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    "except_negation": q(
        "twice(?p) :- lineitem(?o, ?p, _, ?i, _, _, _, _, _), lineitem(?o, ?p, _, ?j, _, _, _, _, _), ?i < ?j . r(?p) :- part(?p, _, _, _, _, _), ~twice(?p) .", "r", "p",
        "SELECT p_partkey AS p FROM part EXCEPT SELECT a.l_partkey FROM lineitem a JOIN lineitem b USING (l_orderkey, l_partkey) WHERE a.l_linenumber < b.l_linenumber",
    ),
    "negation_constant": q('r(?c) :- customer(?c, _, _, _, _), ~orders(_, ?c, "F", _, _) .', "r", "c", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)"),
    "negation_operation": q("r(?a) :- nation(?a, _, _), ~nation(?a + 1, _, _) .", "r", "a", "SELECT DISTINCT n_nationkey AS a FROM nation WHERE n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)"),
    "negation_ground": q("r(?a) :- region(?a, _), ~nation(99, _, _) .", "r", "a", "SELECT DISTINCT r_regionkey AS a FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)"),
    "semi_join": q("r(?n) :- nation(?k, ?n, _), supplier(_, _, ?k, _) .", "r", "n", "SELECT DISTINCT n_name AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "constants": q('r("x", ?c, 7) :- customer(?c, _, 3, _, _) .', "r", "k c n", "SELECT DISTINCT 'x' AS k, c_custkey AS c, CAST(7 AS BIGINT) AS n FROM customer WHERE c_nationkey = 3"),
    "repeated_variables": q("r(?x, ?y, ?x) :- nation(?x, ?y, ?x) .", "r", "a b c", "SELECT DISTINCT n_nationkey AS a, n_name AS b, n_nationkey AS c FROM nation WHERE n_nationkey = n_regionkey"),
    "operation_in_atom": q("r(?a, ?b) :- nation(?a, _, _), nation(?a + 1, ?b, _) .", "r", "a b", "SELECT DISTINCT a.n_nationkey AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1"),
    "assignment_chain": q("r(?o, ?z) :- orders(?o, ?c, _, _, _), ?y = ?c * 2, ?z = ?y + ?o .", "r", "o z", "SELECT DISTINCT o_orderkey AS o, o_custkey * 2 + o_orderkey AS z FROM orders"),
    "undefined_division": q("r(?n, ?v) :- nation(?n, _, ?g), ?v = 10 / ?g .", "r", "n v", "SELECT DISTINCT n_nationkey AS n, CAST(10 // n_regionkey AS BIGINT) AS v FROM nation WHERE n_regionkey <> 0"),
    "boolean_filter": q("r(?p) :- part(?p, _, _, _, ?s, ?c), OR(NUMGREATER(?s, 45), AND(NUMLESS(?s, 5), NUMLESS(?c, 1000))) .", "r", "p", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size > 45 OR (p_size < 5 AND p_retailprice < 1000)"),
    "aggregate_count": q("r(?c, #count(?o)) :- orders(?o, ?c, _, _, _) .", "r", "c n", "SELECT o_custkey AS c, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1"),
    "aggregate_sum_set": q("r(?f, #sum(?q)) :- lineitem(_, _, _, _, ?q, _, _, ?f, _) .", "r", "f q", "SELECT l_returnflag AS f, sum(DISTINCT l_quantity) AS q FROM lineitem GROUP BY 1"),
    "aggregate_sum_told_apart": q("r(?f, ?t, #sum(?q, ?o, ?n)) :- lineitem(?o, _, _, ?n, ?q, _, _, ?f, ?t) .", "r", "f t q", "SELECT l_returnflag AS f, l_linestatus AS t, sum(l_quantity) AS q FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2"),
    "aggregate_min": q("r(?b, #min(?c)) :- part(_, _, ?b, _, _, ?c) .", "r", "b c", "SELECT p_brand AS b, min(p_retailprice) AS c FROM part GROUP BY 1"),
    "aggregate_max": q("r(?b, #max(?s)) :- part(_, _, ?b, _, ?s, _) .", "r", "b s", "SELECT p_brand AS b, CAST(max(p_size) AS BIGINT) AS s FROM part GROUP BY 1"),
    "aggregate_global": q("r(#count(?c)) :- customer(?c, _, _, ?b, _), ?b < 0 .", "r", "n", "SELECT count(DISTINCT c_custkey) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0"),
    "aggregate_head_arithmetic": q("r(?g, ?g + #sum(?k * 2)) :- nation(?k, _, ?g) .", "r", "g v", "SELECT CAST(n_regionkey AS BIGINT) AS g, CAST(n_regionkey + sum(DISTINCT n_nationkey * 2) AS BIGINT) AS v FROM nation GROUP BY n_regionkey"),
    "aggregate_computed_group": q("r(MAX(0, ?s - 25), #count(?p)) :- part(?p, _, _, _, ?s, _) .", "r", "g n", "SELECT CAST(greatest(0, p_size - 25) AS BIGINT) AS g, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1"),
    "having_by_rule": q("n(?c, #count(?o)) :- orders(?o, ?c, _, _, _) . r(?c) :- n(?c, ?k), ?k >= 15 .", "r", "c", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 15"),
    "stratified_negation": q(
        'low(?k) :- supplier(_, _, ?k, ?b), ?b < 0 . clean(?k) :- nation(?k, _, _), ~low(?k) . r(?n, #count(?c)) :- clean(?k), nation(?k, ?n, _), customer(?c, _, ?k, _, _) .', "r", "n c",
        "SELECT n_name AS n, count(DISTINCT c_custkey) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1",
    ),
    "transitive_closure": q(
        EDGES + " path(?x, ?y) :- edge(?x, ?y) . path(?x, ?z) :- path(?x, ?y), edge(?y, ?z) .", "path", "x y",
        f"WITH RECURSIVE {EDGES_SQL}, path(x, y) AS (SELECT x, y FROM edge UNION SELECT path.x, edge.y FROM path JOIN edge ON path.y = edge.x) SELECT x, y FROM path",
    ),
    "nonlinear_closure": q(
        EDGES + " path(?x, ?y) :- edge(?x, ?y) . path(?x, ?z) :- path(?x, ?y), path(?y, ?z) .", "path", "x y",
        f"WITH RECURSIVE {EDGES_SQL}, path(x, y) AS (SELECT x, y FROM edge UNION SELECT path.x, edge.y FROM path JOIN edge ON path.y = edge.x) SELECT x, y FROM path",
    ),
    "mutual_recursion": q(
        EDGES + " odd(?y) :- edge(?x, ?y), part(?x, _, \"Brand#2\", _, _, _) . even(?y) :- odd(?x), edge(?x, ?y) . odd(?y) :- even(?x), edge(?x, ?y) .", "even", "y",
        f"WITH RECURSIVE {EDGES_SQL}, walk(y, o) AS (SELECT y, 1 FROM edge WHERE x IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') UNION SELECT edge.y, 1 - walk.o FROM walk JOIN edge ON walk.y = edge.x) SELECT DISTINCT y FROM walk WHERE o = 0",
    ),
    "unreachable": q(
        EDGES + " node(?x) :- edge(?x, _) . node(?x) :- edge(_, ?x) . seen(?y) :- edge(?x, ?y), part(?x, _, \"Brand#2\", _, _, _) . seen(?y) :- seen(?x), edge(?x, ?y) . r(?x) :- node(?x), ~seen(?x) .", "r", "x",
        f"WITH RECURSIVE {EDGES_SQL}, seen(y) AS (SELECT y FROM edge WHERE x IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') UNION SELECT edge.y FROM seen JOIN edge ON seen.y = edge.x) SELECT x FROM (SELECT x FROM edge UNION SELECT y FROM edge) n(x) WHERE x NOT IN (SELECT y FROM seen)",
    ),
    "counting_recursion": q("r(0) . r(?y) :- r(?x), ?x < 40, ?y = ?x + 2 .", "r", "x", "SELECT CAST(range AS BIGINT) AS x FROM range(0, 41, 2)"),
    "existential_restricted": q(
        'has(?c, !v), kind(!v, ?s) :- customer(?c, _, ?k, _, ?s), ?k < 3 . r(?c, ?s) :- has(?c, ?v), kind(?v, ?s) .', "r", "c s",
        "SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_nationkey < 3",
    ),
    "existential_blocked": q(
        "known(?k, ?g) :- nation(?k, _, ?g), ?g < 2 . known(?k, !v) :- nation(?k, _, _) . r(?k) :- known(?k, ?v), isNull(?v) = true .", "r", "k",
        "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey >= 2",
    ),
    "polymorphic_column": q(
        "m(?k) :- nation(?k, _, _) . m(?n) :- nation(_, ?n, _) . r(?t, #count(?v)) :- m(?v), ?t = isInteger(?v) .", "r", "t n",
        "SELECT true AS t, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT false, count(DISTINCT n_name) FROM nation",
    ),
    "strings": q(
        'r(?n, UCASE(?n), STRLEN(?n), SUBSTR(?n, 2, 3), STRBEFORE(?n, "A"), STRAFTER(?n, "A"), CONCAT(?n, "-", STR(?k)), STRREV(?n)) :- nation(?k, ?n, _), CONTAINS(?n, "A") .', "r", "n u l s b a c v",
        "SELECT DISTINCT n_name AS n, upper(n_name) AS u, length(n_name) AS l, substr(n_name, 2, 3) AS s, substr(n_name, 1, instr(n_name, 'A') - 1) AS b, substr(n_name, instr(n_name, 'A') + 1) AS a, n_name || '-' || n_nationkey AS c, reverse(n_name) AS v FROM nation WHERE contains(n_name, 'A')",
    ),
    "string_tests": q(
        'r(?n, STRSTARTS(?n, "NATION_2"), STRENDS(?n, "4"), REGEX(?n, "^N.*_1[0-4]$"), LEVENSHTEIN(?n, "NATION_13"), COMPARE(?n, "NATION_15"), CONTAINS(?n, "_2")) :- nation(_, ?n, _) .', "r", "n s e x l c i",
        "SELECT DISTINCT n_name AS n, starts_with(n_name, 'NATION_2') AS s, ends_with(n_name, '4') AS e, regexp_matches(n_name, '^N.*_1[0-4]$') AS x, levenshtein(n_name, 'NATION_13') AS l, CAST(CASE WHEN n_name < 'NATION_15' THEN -1 WHEN n_name > 'NATION_15' THEN 1 ELSE 0 END AS BIGINT) AS c, contains(n_name, '_2') AS i FROM nation",
    ),
    "string_filters": q(
        'r(?n, 1) :- nation(_, ?n, _), STRSTARTS(?n, "NATION_2") . r(?n, 2) :- nation(_, ?n, _), STRENDS(?n, "4") . r(?n, 3) :- nation(_, ?n, _), REGEX(?n, "^N.*_1[0-4]$") . r(?n, 4) :- nation(_, ?n, _), LEVENSHTEIN(?n, "NATION_13") < 2 . r(?n, 5) :- nation(_, ?n, _), COMPARE(?n, "NATION_15") = -1 .', "r", "n k",
        "SELECT n_name AS n, CAST(1 AS BIGINT) AS k FROM nation WHERE starts_with(n_name, 'NATION_2') UNION SELECT n_name, 2 FROM nation WHERE ends_with(n_name, '4') UNION SELECT n_name, 3 FROM nation WHERE regexp_matches(n_name, '^N.*_1[0-4]$') UNION SELECT n_name, 4 FROM nation WHERE levenshtein(n_name, 'NATION_13') < 2 UNION SELECT n_name, 5 FROM nation WHERE n_name < 'NATION_15'",
    ),
    "type_functions": q(
        'r(?k, DATATYPE(?n), isFloat(FLOAT(?k)), isDouble(?b), isIri(IRI(?n)), isIri(?n), NOT(isString(?k)), NUMLESSEQ(?k, 7), BITSHRU(?k, 1), isFloat(?b), isDouble(?k), STR(IRI(?n)), DOUBLE(FLOAT(?k))) :- supplier(?k, ?n, _, ?b) .', "r", "k t f d i j s l u g h n e",
        "SELECT s_suppkey AS k, 'http://www.w3.org/2001/XMLSchema#string' AS t, true AS f, true AS d, true AS i, false AS j, true AS s, s_suppkey <= 7 AS l, s_suppkey >> 1 AS u, false AS g, false AS h, s_name AS n, CAST(s_suppkey AS DOUBLE) AS e FROM supplier",
    ),
    "trigonometry": q(
        "r(?k, ROUND(SIN(?b / 1000) * 1000000), ROUND(COS(?b / 1000) * 1000000), ROUND(TAN(?b / 1000) * 1000)) :- supplier(?k, _, _, ?b) .", "r", "k s c t",
        "SELECT s_suppkey AS k, sign(s) * floor(abs(s) + 0.5) AS s, sign(c) * floor(abs(c) + 0.5) AS c, sign(t) * floor(abs(t) + 0.5) AS t FROM (SELECT s_suppkey, sin(s_acctbal / 1000) * 1000000 AS s, cos(s_acctbal / 1000) * 1000000 AS c, tan(s_acctbal / 1000) * 1000 AS t FROM supplier)",
    ),
    "large_doubles": q(
        "r(?k, CEIL(?v), FLOOR(?v), ROUND(?v)) :- supplier(?k, _, _, ?b), ?v = ?b * 1.0E30 .", "r", "k c f r",
        "SELECT s_suppkey AS k, ceil(s_acctbal * 1e30) AS c, floor(s_acctbal * 1e30) AS f, s_acctbal * 1e30 AS r FROM supplier",
    ),
    "second_assignment": q("r(?k, ?v) :- nation(?k, _, ?g), ?v = ?k + ?g, ?v = ?g * 6 .", "r", "k v", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey * 6 AS BIGINT) AS v FROM nation WHERE n_nationkey + n_regionkey = n_regionkey * 6"),
    "equality_chain": q(
        "r(?a, ?b) :- nation(?a, _, ?x), nation(?b, _, ?y), ?x = ?u, ?u = ?w, ?w = ?y, ?a < ?b .", "r", "a b",
        "SELECT DISTINCT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey",
    ),
    "told_apart_by_a_constant": q("r(#sum(?k, ?g)) :- nation(?k, _, ?g), ?g = 3 .", "r", "s", "SELECT CAST(sum(DISTINCT n_nationkey) AS BIGINT) AS s FROM nation WHERE n_regionkey = 3 HAVING count(*) > 0"),
    "empty_frontier": q("some(!v) :- nation(_, _, _) . r(#count(?v)) :- some(?v) .", "r", "n", "SELECT CAST(1 AS BIGINT) AS n"),
    "uri_functions": q('r(?n, URIENCODE(CONCAT(?n, " &/", LCASE(?n))), URIDECODE("a%20b%26")) :- region(_, ?n) .', "r", "n e d", "SELECT DISTINCT r_name AS n, url_encode(r_name || ' &/' || lower(r_name)) AS e, 'a b&' AS d FROM region"),
    "integer_functions": q(
        "r(?k, POW(?k, 2), SQRT(?k), REM(?k, 4), ABS(?k - 10), BITAND(?k, 6), BITOR(?k, 8), BITXOR(?k, 5), BITSHL(?k, 2), BITSHR(?k, 1), LOG(?k + 1, 2), INVERTSIGN(?k), MIN(?k, 7), MAX(?k, 7)) :- nation(?k, _, _) .", "r", "k p s r a b o x l h g i n m",
        "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * n_nationkey AS BIGINT) AS p, CAST(floor(sqrt(n_nationkey)) AS BIGINT) AS s, CAST(n_nationkey % 4 AS BIGINT) AS r, CAST(abs(n_nationkey - 10) AS BIGINT) AS a, CAST(n_nationkey & 6 AS BIGINT) AS b, CAST(n_nationkey | 8 AS BIGINT) AS o, CAST(xor(n_nationkey, 5) AS BIGINT) AS x, CAST(n_nationkey * 4 AS BIGINT) AS l, CAST(n_nationkey // 2 AS BIGINT) AS h, CAST(floor(log2(n_nationkey + 1) + 1e-9) AS BIGINT) AS g, CAST(-n_nationkey AS BIGINT) AS i, CAST(least(n_nationkey, 7) AS BIGINT) AS n, CAST(greatest(n_nationkey, 7) AS BIGINT) AS m FROM nation",
    ),
    "double_functions": q(
        "r(?s, ROUND(?b / 100), CEIL(?b / 100), FLOOR(?b / 100), ABS(?b), SQRT(ABS(?b)), LUKA(0.75, 0.5)) :- supplier(?s, _, _, ?b) .", "r", "s r c f a q l",
        "SELECT DISTINCT s_suppkey AS s, sign(s_acctbal / 100) * floor(abs(s_acctbal / 100) + 0.5) AS r, ceil(s_acctbal / 100) AS c, floor(s_acctbal / 100) AS f, abs(s_acctbal) AS a, sqrt(abs(s_acctbal)) AS q, CAST(0.25 AS DOUBLE) AS l FROM supplier",
    ),
    "casts_and_types": q(
        'r(?k, INT(STR(?k)), DOUBLE(?k), INT("0x2B"), STR(2.0), isNumeric(?k), isString(?n), fullStr(?n)) :- nation(?k, ?n, _) .', "r", "k i d h s u t f",
        "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey AS DOUBLE) AS d, CAST(43 AS BIGINT) AS h, '2' AS s, true AS u, true AS t, '\"' || n_name || '\"' AS f FROM nation",
    ),
    "format_strings": q('r(f"{?n} no. {?k}") :- nation(?k, ?n, _) .', "r", "t", "SELECT DISTINCT n_name || ' no. ' || n_nationkey AS t FROM nation"),
    "language_strings": q('r(?n, LANG(?t), STR(?t)) :- region(_, ?n), ?t = STRLANG(?n, "en") .', "r", "n l s", "SELECT DISTINCT r_name AS n, 'en' AS l, r_name AS s FROM region"),
    "parameters": q("@parameter $least = 100 + 20 . r(?p) :- part(?p, _, _, _, _, _), ?p < $least .", "r", "p", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_partkey < 120"),
    "facts_with_arithmetic": q("f(5 * 2, 80 / 4) . f(1, 1 / 0) . f(0b101, 0x1F) . r(?a, ?b) :- f(?a, ?b) .", "r", "a b", "SELECT CAST(10 AS BIGINT) AS a, CAST(20 AS BIGINT) AS b UNION ALL SELECT 5, 31"),
    "event_funnel": q(
        "first(?u, #min(?e)) :- events(?e, ?u, _, _) . r(?t, #count(?u)) :- first(?u, ?e), events(?e, ?u, ?t, _) .", "r", "t n",
        "SELECT event_type AS t, count(DISTINCT user_id) AS n FROM events JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) USING (user_id, event_id) GROUP BY 1",
    ),
}


@dataclass(frozen=True)
class RoundTrip:
    """A program's exports, written to the shared folder, and a program over imports of them; ``{}`` stands for the folder."""

    write: str
    read: str
    output: str
    columns: tuple[str, ...]
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        first = Engine(spark, folder)
        for name, columns in TABLES.items():
            if f"{name}(" in self.write:
                first.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns)
        first.run(self.write)
        first.export()
        second = Engine(spark, folder)
        second.run(self.read, outputs=[self.output])
        return second.relation(self.output, list(self.columns))


def trip(write: str, read: str, columns: str, sql: str) -> RoundTrip:
    return RoundTrip(write, read, "r", tuple(columns.split()), sql)


SUPPLIERS = "SELECT DISTINCT s_suppkey AS k, s_name AS n, s_acctbal AS b FROM supplier"
STATEMENTS = 't(?s, <http://e/name>, ?n) :- supplier(?k, ?n, _, _), ?s = IRI(CONCAT("http://e/", STR(?k))) . t(?s, <http://e/nation>, ?g) :- supplier(?k, _, ?g, _), ?s = IRI(CONCAT("http://e/", STR(?k))) . '
FOUND = ' r(?k, STR(?n), INT(?g)) :- t(?s, <http://e/name>, ?n), t(?s, <http://e/nation>, ?g), ?k = STRAFTER(STR(?s), "http://e/") .'
FOUND_SQL = "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n, CAST(s_nationkey AS BIGINT) AS g FROM supplier"
IN_GRAPHS = STATEMENTS.replace("t(?s", "t(<http://e/graph>, ?s")

ROUND_TRIPS: dict[str, RoundTrip] = {
    "csv_round_trip": trip('t(?k, ?n, ?b) :- supplier(?k, ?n, _, ?b) . @export t :- csv{resource="t.csv", format=(int, string, double)} .', '@import t :- csv{resource="t.csv", format=(int, string, double)} . r(?k, ?n, ?b) :- t(?k, ?n, ?b) .', "k n b", SUPPLIERS),
    "csv_any_round_trip": trip('t(?k, ?n, ?b) :- supplier(?k, ?n, _, ?b) . @export t :- csv{resource="t.csv"} .', '@import t :- csv{resource="t.csv"} . r(STR(?k), STR(?n), isDouble(?b)) :- t(?k, ?n, ?b), isString(?n) .', "k n d", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n, true AS d FROM supplier"),
    "csv_line_breaks": trip('t(?k, CONCAT(?n, "\\n, \\"", STR(?k), "\\"")) :- supplier(?k, ?n, _, _) . @export t :- csv{resource="t.csv", format=(int, string)} .', '@import t :- csv{resource="t.csv", format=(int, string)} . r(?k, STRLEN(?n), CONTAINS(?n, "\\n")) :- t(?k, ?n) .', "k l c", "SELECT DISTINCT s_suppkey AS k, CAST(length(s_name) + 5 + length(CAST(s_suppkey AS VARCHAR)) AS BIGINT) AS l, true AS c FROM supplier"),
    "tsv_gzip_round_trip": trip('t(?k, ?b) :- supplier(?k, _, _, ?b) . @export t :- tsv{resource="t.tsv", compression=gzip, format=(int, double)} .', '@import t :- tsv{resource="t.tsv", format=(int, double)} . r(?k, ?b) :- t(?k, ?b) .', "k b", "SELECT DISTINCT s_suppkey AS k, s_acctbal AS b FROM supplier"),
    "dsv_skip_and_limit": trip('t(?k, ?g, ?b) :- supplier(?k, _, ?g, ?b) . @export t :- dsv{resource="t.dsv", delimiter=";", format=(int, int, double)} .', '@import t :- dsv{resource="t.dsv", delimiter=";", format=(int, skip, double)} . @import u :- dsv{resource="t.dsv", delimiter=";", format=(int, int, double), limit=7} . n(#count(?k)) :- u(?k, _, _) . r(?k, ?b, ?n) :- t(?k, ?b), n(?n) .', "k b n", "SELECT DISTINCT s_suppkey AS k, s_acctbal AS b, CAST(7 AS BIGINT) AS n FROM supplier"),
    "ntriples_round_trip": trip(STATEMENTS + '@export t :- ntriples{resource="t.nt"} .', '@import t :- ntriples{resource="t.nt"} .' + FOUND, "k n g", FOUND_SQL),
    "turtle_round_trip": trip(STATEMENTS + '@export t :- turtle{resource="t.ttl"} .', '@import t :- rdf{resource="t.ttl"} .' + FOUND, "k n g", FOUND_SQL),
    "rdfxml_round_trip": trip(STATEMENTS + '@export t :- rdfxml{resource="t.rdf"} .', '@import t :- rdf{resource="t.rdf"} .' + FOUND, "k n g", FOUND_SQL),
    "nquads_round_trip": trip(IN_GRAPHS + '@export t :- nquads{resource="t.nq"} .', '@import q :- nquads{resource="t.nq"} . t(?s, ?p, ?o) :- q(<http://e/graph>, ?s, ?p, ?o) .' + FOUND, "k n g", FOUND_SQL),
    "trig_round_trip": trip(IN_GRAPHS + '@export t :- trig{resource="t.trig"} .', '@import q :- rdf{resource="t.trig"} . t(?s, ?p, ?o) :- q(<http://e/graph>, ?s, ?p, ?o) .' + FOUND, "k n g", FOUND_SQL),
}


def json_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document of all nations, imported as triples."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))).alias("value"))
    rows.groupBy().agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]")).alias("value")).coalesce(1).write.text(f"{folder}/nations.json")
    engine = Engine(spark, folder)
    engine.run('@import j :- json{resource="nations.json"} . r(?n, ?k) :- j(0, _, ?row), j(?row, "name", ?a), j(?a, value, ?n), j(?row, "key", ?b), j(?b, value, ?k) . s(STR(?n), INT(?k)) :- r(?n, ?k) .', outputs=["s"])
    return engine.relation("s", ["n", "k"])


def parquet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    engine.run('@import s :- parquet{resource="region.parquet"} . r(?n, ?k) :- s(?k, ?n) .', outputs=["r"])
    return engine.relation("r", ["n", "k"])


def operator_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational operators on plain DataFrames: orders of customers without an urgent one, summed by customer."""
    orders = operators.rename(operators.fetch_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]), {"o_custkey": "c"})
    urgent = operators.project_reorder(operators.filter_rows(orders, F.col("o_orderpriority") == "1-URGENT"), ["c"])
    priced = operators.function(operators.subtract(orders, urgent), {"thousands": F.floor(F.col("o_totalprice") / 1000)})
    return operators.aggregate(priced, ["c"], "sum", "thousands", ["o_orderkey"], "t")


def operator_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One witness a group: which one is open, so its group and whether it belongs there are given."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    one = operators.single(nations, ["n_regionkey"]).select("n_regionkey", "n_nationkey")
    return operators.join(one, nations).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).select(F.col("n_regionkey").alias("g"), "n")


def operator_incremental_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only those customers that suppliers in debt share a nation with."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("k"))
    debts = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return operators.incremental_import(customers, debts).select(F.col("c_custkey").alias("c"))


def operator_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one empty row, beside every region."""
    return operators.zero(spark).crossJoin(spark.read.parquet(f"{sf_dir}/region.parquet")).select(F.col("r_name").alias("n"))


def trace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node of a two-edge derivation can hold: the path, its first edge and its second."""
    engine = Engine(spark, tracing=True).register("lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet"), TABLES["lineitem"])
    engine.run(EDGES + " two(?x, ?z) :- edge(?x, ?y), edge(?y, ?z) .", outputs=["two"])
    shape = Shape("two", next(r for r in engine.program.rules if r.head[0].pred == "two"), [Shape("edge"), Shape("edge")])
    tables = [df.select(F.lit(".".join(map(str, at)) or "root").alias("node"), F.col("c0").alias("x"), F.col("c1").alias("y")) for at, df in engine.trace_node(shape).items()]
    return reduce(DataFrame.unionByName, tables)


def trace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivations of every nation's region, found one by one: the fact, and the premises used."""
    engine = Engine(spark, tracing=True)
    for name in ("nation", "region"):
        engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLES[name])
    engine.run("lies(?n, ?m) :- region(?g, ?m), nation(_, ?n, ?g), ?g = 1 . in(?n) :- lies(?n, _) .", outputs=["in"])
    rows = [(t.fact.args[0].value, t.children[0].fact.args[1].value, t.size()) for t in engine.trace_predicates(["in"])]
    return spark.createDataFrame(rows, "n string, m string, size long")


#: Invalid programs and the codes they are refused with.
REFUSED = {
    "p(?x) :- q(?x, !y) .": 201, "p(?y) :- q(?x) .": 202, "p(_) :- q(?x) .": 203, "p(?x) :- q(?x), ?y < 3 .": 204, "p(?x) :- q(?x), ~r(?y), ~s(?y) .": 205, "p(?x, !x) :- q(?x) .": 207, "p(?x) .": 208,
    "__p(?x) :- q(?x) .": 211, 'p(?x, #sum("a")) :- q(?x) .': 212, "p(?x, #sum(?x)) :- q(?x) .": 214, "p(ABS(?x, ?x)) :- q(?x) .": 217, "p(?x) :- q(?x), q(?x, ?x) .": 219, "@import p :- csv{} . r(?x) :- p(?x) .": 220,
    '@import p :- csv{resource="a", oops=1} . r(?x) :- p(?x) .': 221, '@import p :- csv{resource="a", limit="x"} . r(?x) :- p(?x) .': 222, '@import p :- csv{resource="a", format=(odd)} . r(?x) :- p(?x) .': 223, '@import p :- csv{resource="a", limit=-1} . r(?x) :- p(?x) .': 224,
    '@import p :- dsv{resource="a", delimiter="ab"} . r(?x) :- p(?x) .': 225, '@import p :- csv{resource="a", compression=zip} . r(?x) :- p(?x) .': 226, '@import p :- rdf{resource="a"} . r(?x, ?y, ?z) :- p(?x, ?y, ?z) .': 229, '@import p :- rdf{resource="a.b"} . r(?x, ?y, ?z) :- p(?x, ?y, ?z) .': 230,
    '@import p :- odd{resource="a"} . r(?x) :- p(?x) .': 231, "@parameter $a = $b . @parameter $b = $a . p($a) .": 240, "p($a) .": 241, "p(?x) :- ~q(?x), ?x = 1 .": 994, "@export p :- json{} . p(1) .": 995, "p((1, 2)) .": 996, "p(!v, #sum(?y)) :- q(?y) .": 998, "p(?x, #sum(?y), #sum(?z)) :- q(?x, ?y, ?z) .": 999,
}


def refused_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code with which each invalid program is refused."""
    rows = []
    for text in REFUSED:
        try:
            Engine(spark, shared_folder(spark)).run(text)
            rows.append((text, None))
        except RuleError as e:
            rows.append((text, e.code))
    return spark.createDataFrame(rows, "program string, code long")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: queries with no rule program over registered tables, and their SQL
FILES = {
    **{name: (t, t.sql) for name, t in ROUND_TRIPS.items()},
    "json_import": (json_import, "SELECT n_name AS n, CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "operator_chain": (
        operator_chain,
        "SELECT o_custkey AS c, CAST(sum(t) AS BIGINT) AS t FROM (SELECT DISTINCT o_custkey, o_orderkey, floor(o_totalprice / 1000) AS t FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY 1",
    ),
    "operator_single": (operator_single, "SELECT DISTINCT n_regionkey AS g, CAST(1 AS BIGINT) AS n FROM nation"),
    "operator_incremental_import": (operator_incremental_import, "SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)"),
    "operator_zero": (operator_zero, "SELECT r_name AS n FROM region"),
    "trace_tables": (
        trace_tables,
        f"WITH {EDGES_SQL}, steps AS (SELECT a.x AS x, a.y AS y, b.y AS z FROM edge a JOIN edge b ON a.y = b.x) SELECT DISTINCT 'root' AS node, x, z AS y FROM steps UNION ALL SELECT DISTINCT '0', x, y FROM steps UNION ALL SELECT DISTINCT '1', y, z FROM steps",
    ),
    "trace_facts": (trace_facts, "SELECT DISTINCT n_name AS n, r_name AS m, CAST(4 AS BIGINT) AS size FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1"),
    "refused_programs": (refused_programs, "SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)}, CAST({c} AS BIGINT))" for t, c in REFUSED.items()) + ") v(program, code)"),
    "parquet_import": (parquet_import, "SELECT r_name AS n, CAST(r_regionkey AS BIGINT) AS k FROM region"),
}
HEADLINE = ("flagship_customer_spend", "join_aggregate_three_way", "aggregate_sum_told_apart", "self_join", "except_negation", "transitive_closure", "existential_restricted", "strings")
