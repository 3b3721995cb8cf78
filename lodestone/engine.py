"""The rule engine: parses a program, evaluates it stratum by stratum, and keeps its relations as DataFrames."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import checks
from .functions.encoding import ANY, Col, adopt, as_kind, canonical_text, join_kinds, python_value, raw_value, schema, to_any
from .lang.ast import Atom, Import, Not, Op, Program, Rule, RuleError, Var, substitute, variables
from .lang.parser import parse, parse_atom
from .lang.values import Value, canonical
from .plans import compile as plan
from .plans.compile import Bound, Relation, name_of
from .plans.pairs import paired
from .plans.storage import materialised
from .sources import load, parameters, sparql

COMPACT = 8  # deltas of a relation that are kept apart before they are written as one
LARGE = 4  # a relation of more rows than so many broadcasts isn't shuffled to find out what is new among few rows


@dataclass
class Stored:
    """A relation during evaluation: its rows so far, and what each step added."""

    kinds: list[str]
    df: DataFrame
    nullable: bool = False
    steps: list[tuple[int, DataFrame]] = field(default_factory=list)
    changed: int = 0
    pieces: int = 1
    rows: int = 0  # counted while rules add to it


class Engine:
    """Evaluates programs over registered DataFrames, facts and imports.

    broadcast_rows bounds what recursion broadcasts: a step's new rows are counted, and joined by broadcast only up to
    that many. max_steps stops existential recursion that doesn't end. With tracing, what each step added is kept.
    With skolem, an existential variable stands for a function of the frontier, whether or not the head holds already.
    """

    def __init__(self, spark: SparkSession, base_dir: str = ".", max_steps: int = 10_000, broadcast_rows: int = 20_000, tracing: bool = False, skolem: bool = False):
        self.spark, self.base_dir, self.max_steps, self.broadcast_rows, self.tracing, self.skolem = spark, base_dir, max_steps, broadcast_rows, tracing, skolem
        self.foreign: dict[str, DataFrame] = {}
        self.relations: dict[str, Stored] = {}
        self.program: Program | None = None
        self.step = 0
        self.timings: list[tuple[str, float, int]] = []

    # input

    def register(self, name: str, df: DataFrame, columns: list[str] | None = None) -> Engine:
        """Makes df a relation. Integers widen, strings are plain strings; rows whose used columns are NULL don't match."""
        self.foreign[name] = df.select(*columns) if columns else df
        return self

    def load(self, text: str, params: dict | None = None) -> Engine:
        program = checks.resolve_parameters(parse(text), params)
        self.program = checks.validate(program)
        return self

    def load_file(self, path: str, params: dict | None = None) -> Engine:
        import os

        self.base_dir = os.path.dirname(os.path.abspath(path))
        with open(path, encoding="utf-8") as f:
            return self.load(f.read(), params)

    # evaluation

    def run(self, text: str | None = None, params: dict | None = None, outputs: list[str] | None = None) -> dict[str, DataFrame]:
        """Evaluates the program and gives the output relations by name."""
        if text is not None:
            self.load(text, params)
        if self.program is None:
            raise RuleError("no program is loaded")
        wanted = outputs or checks.outputs(self.program)
        program = checks.needed(self.program, wanted)
        self.relations, self.step, self.timings = {}, 0, []
        groups = checks.strata(program)
        self.remote = self._bindable(program, groups, wanted)
        self._inputs(program)
        self._kinds(program, groups)
        self.uses: dict[str, int] = {}
        for r in program.rules:
            for x in r.body:
                if isinstance(x, (Atom, Not)):
                    p = x.atom.pred if isinstance(x, Not) else x.pred
                    self.uses[p] = self.uses.get(p, 0) + 1
        for p in wanted:
            self.uses[p] = self.uses.get(p, 0) + 1
        for group in groups:
            began = time.time()
            self._group(group)
            self.timings.append((", ".join(sorted({h.pred for r in group for h in r.head})), time.time() - began, self.step))
        return {p: self.relation(p) for p in wanted if p in self.relations}

    def _inputs(self, program: Program) -> None:
        parts: dict[str, list[tuple[DataFrame, list[str], bool]]] = {}
        for name, df in self.foreign.items():
            rows, kinds = adopt(df)
            parts.setdefault(name, []).append((rows, kinds, True))
        facts: dict[str, list[list[Value]]] = {}
        for atom in program.facts:
            row = self._ground(atom)
            if row is not None:
                facts.setdefault(atom.pred, []).append(row)
            else:
                facts.setdefault(atom.pred, [])
        arity = {a.pred: len(a.args) for a in program.facts}
        for r in program.rules:
            for x in (*r.head, *r.body):
                atom = x.atom if isinstance(x, Not) else x
                if isinstance(atom, Atom):
                    arity[atom.pred] = len(atom.args)
        for pred, rows in facts.items():
            kinds = [join_kinds(*(row[i].tag for row in rows)) or "s" for i in range(arity[pred])]
            data = [tuple(raw_value(v, k) for v, k in zip(row, kinds)) for row in rows]
            parts.setdefault(pred, []).append((self.spark.createDataFrame(data, schema(kinds)), kinds, False))
        for spec in program.imports:
            if spec.pred in self.remote:
                kinds = [ANY] * arity[spec.pred]
                parts.setdefault(spec.pred, []).append((self.spark.createDataFrame([], schema(kinds)), kinds, False))
                continue
            rows, kinds = load(self.spark, spec, self.base_dir, arity.get(spec.pred))
            arity.setdefault(spec.pred, len(kinds))
            if arity[spec.pred] != len(kinds):
                raise RuleError(f"{spec.pred} has {arity[spec.pred]} arguments but its import gives {len(kinds)}", 232)
            parts.setdefault(spec.pred, []).append((rows, kinds, False))
        for pred, found in parts.items():
            if pred in arity and any(len(k) != arity[pred] for _, k, _ in found):
                raise RuleError(f"{pred} is used with {arity[pred]} arguments but its data has another number of columns", 219)
            kinds = reduce(plan.merged, [k for _, k, _ in found])
            frames = [self._fit(df, own, kinds) for df, own, _ in found]
            whole = reduce(DataFrame.union, frames)
            self.relations[pred] = Stored(kinds, whole, any(n for *_, n in found), [(0, whole)])

    def _bindable(self, program: Program, groups: list[list[Rule]], wanted: list[str]) -> dict[str, Import]:
        """Remote imports of which each rule that reads them needs only what joins with the rest of its body."""
        found = {s.pred: s for s in program.imports if s.format == "sparql"}
        for pred in wanted + [f.pred for f in program.facts] + checks.derived(program) + list(self.foreign):
            found.pop(pred, None)
        for pred in [p for p, n in Counter(s.pred for s in program.imports).items() if n > 1]:
            found.pop(pred, None)
        for group in groups:
            heads = {h.pred for r in group for h in r.head}
            for rule in group:
                recursive = any(isinstance(x, Atom) and x.pred in heads for x in rule.body)
                creative = any(v.kind == "!" for h in rule.head for v in variables(h))
                for i, x in enumerate(rule.body):
                    atom = x.atom if isinstance(x, Not) else x
                    if not isinstance(atom, Atom) or atom.pred not in found:
                        continue
                    names = sparql.selected(sparql.endpoint_and_query(parameters(found[atom.pred]))[1])
                    if isinstance(x, Not) or recursive or creative or len(names or []) != len(atom.args) or not self._shared(rule, i, found):
                        found.pop(atom.pred)
        return found

    @staticmethod
    def _shared(rule: Rule, at: int, remote) -> list[int]:
        """The places of a body atom whose variables other atoms bind that aren't remote themselves."""
        others = {v for i, x in enumerate(rule.body) if i != at and isinstance(x, Atom) and x.pred not in remote for v in variables(x) if v.kind == "?"}
        return [k for k, t in enumerate(rule.body[at].args) if isinstance(t, Var) and t in others]

    def _fetched(self, rule: Rule) -> dict[int, Relation]:
        """For each remote atom of a rule, the rows that join with the rest of its body."""
        out = {}
        for at, x in enumerate(rule.body):
            if isinstance(x, Atom) and x.pred in self.remote:
                places = self._shared(rule, at, self.remote)
                rest = [y for y in rule.body if isinstance(y, Atom) and y.pred not in self.remote]
                known = {v for y in rest for v in variables(y)}
                bound = plan.body(Rule([], rest + [o for o in rule.body if isinstance(o, Op) and set(variables(o)) <= known]), lambda i, a: self._relation(a.pred), lambda a: self._relation(a.pred))
                params = parameters(self.remote[x.pred])
                names = sparql.selected(sparql.endpoint_and_query(params)[1])
                keys = bound.df.select(*[to_any(bound.col(x.args[k])).alias(f"k{k}") for k in places])
                rows, kinds = sparql.read(self.spark, params, len(x.args), ([names[k] for k in places], keys))
                out[at] = Relation(rows, kinds)
        return out

    def _fit(self, df: DataFrame, own: list[str], kinds: list[str]) -> DataFrame:
        if own == kinds:
            return df
        return df.select(*[as_kind(Col(F.col(f"c{i}"), a), b).alias(f"c{i}") for i, (a, b) in enumerate(zip(own, kinds))])

    def _ground(self, atom: Atom) -> list[Value] | None:
        """A fact's values, its operations evaluated; None where one is undefined."""
        if all(isinstance(a, Value) for a in atom.args):
            return list(atom.args)
        cols = [plan.expression(a, lambda v: None) for a in atom.args]
        row = self.spark.range(1).select(*[to_any(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return None if any(x is None for x in row) else [python_value(x, ANY) for x in row]

    def _kinds(self, program: Program, groups: list[list[Rule]]) -> None:
        """Infers every derived column's kind to a fixpoint; inputs that are also derived may need a wider encoding."""
        kinds = {p: r.kinds for p, r in self.relations.items()}
        for x in (x for r in program.rules for x in r.body):
            atom = x.atom if isinstance(x, Not) else x
            if isinstance(atom, Atom) and atom.pred not in kinds and atom.pred not in checks.derived(program):
                kinds[atom.pred] = ["s"] * len(atom.args)
        for group in groups:
            moved = True
            while moved:
                moved = False
                for rule in group:
                    rows = plan.kinds_of_head(rule, kinds)
                    for h, row in zip(rule.head, rows or []):
                        now = plan.merged(kinds.get(h.pred), row)
                        if now != kinds.get(h.pred):
                            kinds[h.pred], moved = now, True
            for rule in group:  # nothing ever reaches these
                for h in rule.head:
                    kinds.setdefault(h.pred, ["s"] * len(h.args))
        for pred, k in kinds.items():
            old = self.relations.get(pred)
            if old is None:
                empty = self.spark.createDataFrame([], schema(k))
                self.relations[pred] = Stored(k, empty, False, [], 0, 0)
            elif old.kinds != k:
                df = self._fit(old.df, old.kinds, k)
                self.relations[pred] = Stored(k, df, old.nullable, [(0, df)])

    def _relation(self, pred: str) -> Relation:
        s = self.relations[pred]
        return Relation(s.df, s.kinds, s.nullable)

    def _group(self, rules: list[Rule]) -> None:
        preds = {h.pred for r in rules for h in r.head}
        creative = any(v.kind == "!" for r in rules for h in r.head for v in variables(h))
        recursive = any(isinstance(x, Atom) and x.pred in preds for r in rules for x in r.body)
        if creative:
            self._chase(rules, preds)
        elif recursive:
            self._fixpoint(rules, preds)
        else:
            self.step += 1
            for pred in preds:
                old = self.relations[pred]
                df = self._pairs(rules[0]) if len(rules) == 1 and not old.pieces else None
                if df is None:
                    frames = [df for r in rules for p, df in self._heads(r, whole=True) if p == pred]
                    if old.pieces:
                        frames.append(self._known(old))
                    df = reduce(DataFrame.union, frames).distinct()
                if self.uses.get(pred, 0) > 1 or self.tracing:
                    df = materialised(df)
                self.relations[pred] = Stored(old.kinds, df, False, [*old.steps, (self.step, df)], self.step)

    def _known(self, s: Stored) -> DataFrame:
        """Rows of an input without SQL NULLs, which aren't values."""
        return s.df.na.drop() if s.nullable else s.df

    def _pairs(self, rule: Rule) -> DataFrame | None:
        """A rule's rows, each once, where it pairs so many values that they aren't to be shuffled; None for other rules."""
        if any(isinstance(x, Atom) and x.pred in self.remote for x in rule.body):
            return None
        bound = paired(rule, lambda i, a: self._relation(a.pred), lambda a: self._relation(a.pred), self.broadcast_rows)
        return bound and plan.project(rule.head[0], bound, self.relations[rule.head[0].pred].kinds)[0]

    def _heads(self, rule: Rule, first: int | None = None, relation=None, whole: bool = False) -> list[tuple[str, DataFrame]]:
        """The rows that one application of a rule derives, by predicate; whole where it is applied once, to all rows."""
        if relation is None:
            fetched = self._fetched(rule)
            relation = lambda i, a: fetched.get(i) or self._relation(a.pred)
        keep = {v for h in rule.head for v in variables(h)} if whole else None
        bound = plan.body(rule, relation, lambda a: self._relation(a.pred), first, keep)
        if any(plan.aggregate_of(t) for h in rule.head for t in h.args):
            rule, bound = plan.aggregate(rule, bound)
        return [(h.pred, plan.project(h, bound, self.relations[h.pred].kinds)[0]) for h in rule.head]

    def _add(self, pred: str, found: DataFrame) -> tuple[DataFrame, int]:
        """Materialises what is new in found, adds it to the relation, and gives it with its count."""
        s = self.relations[pred]
        fresh, known = found.distinct(), s.df
        keys = reduce(lambda x, y: x & y, [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(len(s.kinds))], F.lit(True))
        if s.pieces and s.rows > LARGE * self.broadcast_rows:
            fresh = materialised(fresh)
            if fresh.count() <= self.broadcast_rows:  # then what is known of it is looked up where it lies, and only that moves
                known = s.df.alias("a").join(F.broadcast(fresh.alias("b")), keys, "left_semi")
        if s.pieces:
            fresh = fresh.alias("a").join(known.alias("b"), keys, "left_anti")
        fresh = materialised(fresh)
        n = fresh.count()
        if n:
            s.rows += n
            s.pieces += 1
            s.df = s.df.union(fresh) if s.pieces > 1 else fresh
            if s.pieces > COMPACT:
                s.df, s.pieces = materialised(s.df), 1
            s.steps.append((self.step, fresh))
            s.changed = self.step
        return fresh, n

    def _fixpoint(self, rules: list[Rule], preds: set[str]) -> None:
        """Seminaive evaluation: each round joins what the last one added with all that was known."""
        for pred in preds:
            s = self.relations[pred]
            if s.pieces:
                s.df, s.nullable = materialised(self._known(s).distinct()), False
                s.pieces = 1
        for x in {x.pred for r in rules for x in r.body if isinstance(x, Atom)} - preds:
            s = self.relations[x]
            if s.pieces and s.changed == 0 and not s.nullable:
                s.df = materialised(s.df.distinct())
        self.step += 1
        found: dict[str, list[DataFrame]] = {}
        for r in rules:
            for p, df in self._heads(r):
                found.setdefault(p, []).append(df)
        old = {p: self.relations[p].df for p in preds}
        delta: dict[str, Relation] = {}
        for p, frames in found.items():
            fresh, n = self._add(p, reduce(DataFrame.union, frames))
            if n:
                delta[p] = Relation(fresh, self.relations[p].kinds, False, n <= self.broadcast_rows)
        while delta:
            self.step += 1
            if self.step > self.max_steps:
                raise RuleError(f"no fixpoint after {self.max_steps} steps")
            found = {}
            for r in rules:
                places = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.pred in preds]
                for at in places:
                    if r.body[at].pred not in delta:
                        continue

                    def pick(i: int, a: Atom, at: int = at, places: list[int] = places) -> Relation:
                        if i == at:
                            return delta[a.pred]
                        if i in places and i > at:
                            return Relation(old[a.pred], self.relations[a.pred].kinds)
                        return self._relation(a.pred)

                    for p, df in self._heads(r, at, pick):
                        found.setdefault(p, []).append(df)
            old = {p: self.relations[p].df for p in preds}
            delta = {}
            for p, frames in found.items():
                fresh, n = self._add(p, reduce(DataFrame.union, frames))
                if n:
                    delta[p] = Relation(fresh, self.relations[p].kinds, False, n <= self.broadcast_rows)

    def _chase(self, rules: list[Rule], preds: set[str]) -> None:
        """The restricted chase, one rule at a time in turn: a rule invents values only where its head isn't satisfied yet."""
        for pred in preds:
            s = self.relations[pred]
            if s.pieces:
                s.df, s.nullable, s.pieces = materialised(self._known(s).distinct()), False, 1
        last = [-1] * len(rules)
        idle = 0
        at = 0
        while idle < len(rules):
            rule = rules[at]
            reads = [x.atom.pred if isinstance(x, Not) else x.pred for x in rule.body if isinstance(x, (Atom, Not))]
            if last[at] >= 0 and all(self.relations[p].changed <= last[at] for p in reads):
                idle, at = idle + 1, (at + 1) % len(rules)
                continue
            self.step += 1
            if self.step > self.max_steps:
                raise RuleError(f"the chase hasn't ended after {self.max_steps} steps")
            since, last[at] = last[at], self.step - 1 if any(p in {h.pred for h in rule.head} for p in reads) else self.step
            if self._apply(rule, at, since):
                idle = 0
                if any(p in {h.pred for h in rule.head} for p in reads):
                    continue  # a rule that feeds itself goes on until it derives nothing
                last[at] = self.step
            else:
                idle += 1
            last[at] = self.step
            at = (at + 1) % len(rules)

    def _since(self, pred: str, step: int) -> Relation:
        """What was added to a relation after a step."""
        s = self.relations[pred]
        frames = [df for at, df in s.steps if at > step]
        return Relation(reduce(DataFrame.union, frames) if frames else s.df.where(F.lit(False)), s.kinds)

    def _apply(self, rule: Rule, number: int, since: int) -> int:
        """One application of a rule to what has come since its last one, at each place of the body in turn."""
        invents = [h for h in rule.head if any(v.kind == "!" for v in variables(h))]
        places: list[int | None] = [None]
        if since >= 0:
            places = [i for i, x in enumerate(rule.body) if isinstance(x, Atom) and self.relations[x.pred].changed > since]
        pickers = [lambda i, a, at=at: self._since(a.pred, since) if i == at else self._relation(a.pred) for at in places]
        if not invents:
            found: dict[str, list[DataFrame]] = {}
            for at, pick in zip(places, pickers):
                for p, df in self._heads(rule, at, pick):
                    found.setdefault(p, []).append(df)
            return sum(self._add(p, reduce(DataFrame.union, frames))[1] for p, frames in found.items())
        bodies = [plan.body(rule, pick, lambda a: self._relation(a.pred), at) for at, pick in zip(places, pickers)]
        frontier = [v for v in dict.fromkeys(v for h in rule.head for v in variables(h) if v.kind == "?")]
        kinds = {v: bodies[0].kinds[v] for v in frontier}
        frames = [b.df.select(*[name_of(v) for v in frontier], F.lit(1).alias("one_")) for b in bodies]
        matches = Bound(materialised(reduce(DataFrame.union, frames).distinct()), kinds)
        if since >= 0 and not matches.df.take(1):
            return 0
        # where the head already holds for some values of its existential variables
        plain = {v: Var(f"e_{v.name}", "?") for h in rule.head for v in variables(h) if v.kind == "!"}
        pattern = Rule([], [substitute(h, plain) for h in invents])
        fresh_ops = [v for v in frontier if any(v in variables(h) for h in invents)]
        simple = all(isinstance(t, (Var, Value)) for h in invents for t in h.args)
        todo = matches
        if simple and not self.skolem:
            satisfied = plan.body(pattern, lambda i, a: self._relation(a.pred), lambda a: self._relation(a.pred))
            seen = Bound(satisfied.df.select(*[name_of(v) for v in fresh_ops], F.lit(1).alias("two_")).distinct().drop("two_") if fresh_ops else satisfied.df, {v: satisfied.kinds[v] for v in fresh_ops})
            inventing = Bound(matches.df.select(*[name_of(v) for v in fresh_ops], "one_").distinct(), {v: matches.kinds[v] for v in fresh_ops})
            if since >= 0 and fresh_ops and matches.df.count() <= self.broadcast_rows:  # the head's rows are looked up where they lie
                seen = plan.join(seen, Bound(F.broadcast(inventing.df.drop("one_")), inventing.kinds), "left_semi")
            todo = plan.join(inventing, seen, "left_anti")
        key = [F.lit(f"{rule.name or ''}#{number}#{','.join(h.pred for h in rule.head)}")] + [canonical_text(Col(F.col(name_of(v)), todo.kinds[v])) for v in todo.kinds]
        df, kinds = todo.df, dict(todo.kinds)
        for v in plain:
            df = df.withColumn(name_of(v), F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(v.name), *key), 256), 1, 32)))
            kinds[v] = "z"
        new = Bound(materialised(df), kinds)
        total = 0
        for h in rule.head:
            source = new if h in invents else matches
            total += self._add(h.pred, plan.project(h, source, self.relations[h.pred].kinds)[0])[1]
        return total

    # results

    def relation(self, pred: str, columns: list[str] | None = None, strings: bool = False) -> DataFrame:
        """A relation as a set: native columns, or each value in the language's syntax with strings=True."""
        s = self.relations[pred]
        df = self._known(s)
        if s.changed == 0:
            df = df.distinct()
        names = columns or [f"c{i}" for i in range(len(s.kinds))]
        cols = [(canonical_text(Col(F.col(f"c{i}"), k)) if strings else F.col(f"c{i}")).alias(n) for i, (k, n) in enumerate(zip(s.kinds, names))]
        return df.select(*cols)

    def rows(self, pred: str) -> Iterator[tuple[Value, ...]]:
        s = self.relations[pred]
        for row in self.relation(pred).toLocalIterator():
            yield tuple(python_value(x, k) for x, k in zip(row, s.kinds))

    def result(self, pred: str) -> list[list]:
        """Rows as plain Python: numbers and booleans as such, all else as text in the language's syntax."""
        return [[v.value if v.tag in "ndfb" else canonical(v) for v in row] for row in self.rows(pred)]

    def arity(self, pred: str) -> int:
        return len(self.relations[pred].kinds)

    def output_predicates(self) -> list[str]:
        return checks.outputs(self.program)

    def edb_predicates(self) -> list[str]:
        idb = set(checks.derived(self.program))
        used = {x.atom.pred if isinstance(x, Not) else x.pred for r in self.program.rules for x in r.body if isinstance(x, (Atom, Not))}
        return sorted((used | {f.pred for f in self.program.facts} | {i.pred for i in self.program.imports}) - idb)

    def explain(self, pred: str) -> str:
        df = self.relation(pred)
        return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def export(self, folder: str | None = None, overwrite: bool = True, gzip: bool = False) -> list[str]:
        """Writes what the program exports (or, to folder, all outputs as CSV)."""
        from .sources.export import write_export, write_table

        written = [write_export(self, spec, folder or self.base_dir, overwrite, gzip) for spec in self.program.exports]
        if not self.program.exports and folder:
            written = [write_table(self, p, f"{folder}/{checks.safe_name(p)}.csv", ",", overwrite, gzip) for p in checks.outputs(self.program)]
        return written

    def trace(self, fact: str | Atom):
        from .plans.trace import trace

        return trace(self, self._fact(fact))

    def _fact(self, fact: str | Atom) -> Atom:
        return parse_atom(fact, self.program) if isinstance(fact, str) else fact

    def trace_predicates(self, preds: list[str]):
        """Derivations of all facts of the predicates, one at a time."""
        from .plans.trace import trace_predicates

        return trace_predicates(self, preds)

    def trace_tree(self, facts: list[str | Atom]):
        """The shape that the derivations of several facts share; see plans.trace."""
        from .plans.trace import trace_tree

        return trace_tree(self, [self._fact(f) for f in facts])

    def trace_node(self, shape) -> dict[tuple[int, ...], DataFrame]:
        """What each node of a derivation's shape can hold, as tables."""
        from .plans.trace import trace_node

        return trace_node(self, shape)


def evaluate(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """The output relations of a program over the given tables."""
    engine = Engine(spark, **options)
    for name, df in (tables or {}).items():
        engine.register(name, df)
    return engine.run(text)

