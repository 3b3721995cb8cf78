"""Why a fact holds: derivation trees found backwards through the steps of an evaluation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import Col, equal, literal, python_value
from ..lang.ast import Atom, Not, Op, Rule, RuleError, Var, substitute, variables
from ..lang.values import Value, canonical
from . import compile as plan
from .compile import Relation, name_of
from .storage import materialised


UNNAMED = "__unnamed_"


def atom_text(atom: Atom) -> str:
    return f"{atom.pred}({', '.join(canonical(a) if isinstance(a, Value) else str(a) for a in atom.args)})"


@dataclass
class Trace:
    """A fact, the rule that derived it (None for a given fact), its variables' values and the facts it used."""

    fact: Atom
    rule: Rule | None = None
    assignment: dict[str, Value] = field(default_factory=dict)
    children: list[Trace] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def ascii(self, depth: int = 0) -> str:
        how = "" if self.rule is None else f"   [{self.rule.name or 'rule'}: {', '.join(f'?{k} = {canonical(v)}' for k, v in self.assignment.items())}]"
        return "\n".join(["  " * depth + atom_text(self.fact) + how, *(c.ascii(depth + 1) for c in self.children)])

    def to_dict(self) -> dict:
        return {"fact": atom_text(self.fact), "rule": None if self.rule is None else self.rule.name or f"rule for {self.fact.pred}", "assignment": {k: canonical(v) for k, v in self.assignment.items()}, "premises": [c.to_dict() for c in self.children]}

    def json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def graphml(self) -> str:
        from xml.sax.saxutils import escape

        nodes, edges = [], []

        def walk(t: Trace) -> int:
            number = len(nodes)
            nodes.append(f'<node id="n{number}"><data key="label">{escape(atom_text(t.fact))}</data></node>')
            for c in t.children:
                edges.append(f'<edge source="n{walk(c)}" target="n{number}"/>')
            return number

        walk(self)
        return '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">' + "".join(nodes + edges) + "</graph></graphml>"


def matches(df, kinds: list[str], fact: Atom):
    for i, (v, k) in enumerate(zip(fact.args, kinds)):
        df = df.where(equal(Col(F.col(f"c{i}"), k), literal(v)))
    return df


def first_step(engine, fact: Atom) -> int | None:
    """The step at which a fact appeared; None if it doesn't hold."""
    stored = engine.relations.get(fact.pred)
    if stored is None:
        return None
    for step, df in stored.steps:
        if matches(df, stored.kinds, fact).take(1):
            return step
    return None


def unify(head: Atom, fact: Atom) -> dict[Var, Value] | None:
    map_: dict[Var, Value] = {}
    for t, v in zip(head.args, fact.args):
        if isinstance(t, Value):
            if t != v:
                return None
        elif isinstance(t, Var) and t.kind == "?":
            if map_.setdefault(t, v) != v:
                return None
    return map_


def trace(engine, fact: Atom) -> Trace | None:
    """A derivation of a fact, or None if it doesn't hold. The engine must have run with tracing=True."""
    if not engine.tracing:
        raise RuleError("run the engine with tracing=True to trace facts")
    step = first_step(engine, fact)
    return None if step is None else derive(engine, fact, step)


def derive(engine, fact: Atom, step: int) -> Trace:
    if step == 0:
        return Trace(fact)
    for rule in engine.program.rules:
        for head in rule.head:
            if head.pred != fact.pred:
                continue
            known = unify(head, fact)
            if known is None:
                continue
            found = premises(engine, rule, head, known, fact, step)
            if found is not None:
                assignment, atoms = found
                derived = {h.pred for r in engine.program.rules for h in r.head}
                # what no rule derives is given: its step needs no looking up
                children = [derive(engine, a, s) for a in atoms if (s := first_step(engine, a) if a.pred in derived else 0) is not None]
                return Trace(fact, rule, assignment, children)
    return Trace(fact)


def premises(engine, rule: Rule, head: Atom, known: dict[Var, Value], fact: Atom, step: int):
    """The first match of a rule's body that derives the fact, over what was there before (or, unrecursively, at) its step."""
    own = {h.pred for h in rule.head}

    def before(i: int, atom: Atom) -> Relation:
        s = engine.relations[atom.pred]
        frames = [df for at, df in s.steps if at < step or atom.pred not in own and at <= step]
        if not frames:
            return Relation(s.df.where(F.lit(False)), s.kinds)
        out = frames[0]
        for df in frames[1:]:
            out = out.union(df)
        return Relation(out, s.kinds, s.nullable)

    # what has no name gets one here, so that premises are whole facts
    plain = [Atom(x.pred, tuple(Var(f"{UNNAMED}{i}_{k}", "?") if isinstance(t, Var) and t.kind == "_" else t for k, t in enumerate(x.args))) if isinstance(x, Atom) else x for i, x in enumerate(rule.body)]
    if any(plan.aggregate_of(t) for t in head.args):
        groups = {v: known[v] for v in known}
        body = [substitute(x, groups) for x in plain]
        whole = [Op("EQUALITY", (substitute(t, groups), v)) for t, v in zip(head.args, fact.args) if isinstance(t, Op) and not plan.aggregate_of(t)]
        bound = plan.body(Rule([], body + whole), before, lambda a: engine._relation(a.pred))
        rows, atoms = 0, {}
        for r in bound.df.toLocalIterator():  # every row of the group, a partition at a time
            rows += 1
            atoms.update(dict.fromkeys(ground(body, bound, r)))
        return ({v.name: x for v, x in known.items()}, list(atoms)) if rows else None
    body = [substitute(x, known) for x in plain]
    extra = []
    for t, v in zip(head.args, fact.args):
        if isinstance(t, Op):
            extra.append(Op("EQUALITY", (substitute(t, known), v)))
    bound = plan.body(Rule([], body + [o for o in extra]), before, lambda a: engine._relation(a.pred))
    rows = bound.df.select(*[name_of(v) for v in bound.kinds], F.lit(1).alias("one_")).take(1)
    if not rows:
        return None
    values = {v: python_value(rows[0][name_of(v)], k) for v, k in bound.kinds.items()}
    return {v.name: x for v, x in {**known, **values}.items() if not v.name.startswith(UNNAMED)}, ground(body, bound, rows[0])


def ground(body: list, bound, row) -> list[Atom]:
    values = {v: python_value(row[name_of(v)], k) for v, k in bound.kinds.items()}
    out = []
    for x in body:
        if isinstance(x, Atom) and not isinstance(x, Not):
            atom = substitute(x, values)
            if not variables(atom) and all(isinstance(a, Value) for a in atom.args):
                out.append(atom)
    return out


def trace_predicates(engine, preds: list[str]) -> Iterator[Trace]:
    """A derivation of every fact of the given predicates, one after the other."""
    for pred in preds:
        for row in engine.rows(pred):
            found = trace(engine, Atom(pred, row))
            if found is not None:
                yield found


@dataclass
class Shape:
    """How a table of facts is derived: the rule (None: given) and, for each positive atom of its body, how that is."""

    pred: str
    rule: Rule | None = None
    children: list[Shape] = field(default_factory=list)
    facts: list[Atom] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"predicate": self.pred, "rule": None if self.rule is None else self.rule.name or f"rule for {self.pred}", "facts": [atom_text(f) for f in self.facts], "children": [c.to_dict() for c in self.children]}


def trace_tree(engine, facts: list[Atom]) -> Shape | None:
    """The derivation that all given facts of one predicate share, as deep as they share it, with each node's facts in their order.

    None where a fact doesn't hold. A node at which derivations part, or whose rule aggregates, ends its branch.
    """
    traces = [trace(engine, f) for f in facts]
    return None if not facts or None in traces or len({f.pred for f in facts}) > 1 else shared_shape(traces)


def shared_shape(traces: list[Trace]) -> Shape:
    first = traces[0]
    out = Shape(first.fact.pred, facts=[t.fact for t in traces])
    whole = first.rule is not None and all(t.rule is first.rule for t in traces) and not any(plan.aggregate_of(a) for h in first.rule.head for a in h.args)
    if whole and all([c.fact.pred for c in t.children] == [c.fact.pred for c in first.children] for t in traces):
        out.rule = first.rule
        out.children = [shared_shape(list(level)) for level in zip(*(t.children for t in traces))]
    return out


def trace_node(engine, shape: Shape) -> dict[tuple[int, ...], DataFrame]:
    """All rows that a node can hold in a derivation of a shape, by the node's address (the root's is ()).

    Upwards, each rule is applied to what its children can hold; downwards, children keep what their parent uses. Both
    are joins of whole tables; nothing is collected. Columns are c0, c1, ... Pages are DataFrame.offset and limit.
    """
    made: dict[tuple[int, ...], DataFrame] = {}
    matches: dict[tuple[int, ...], tuple] = {}

    def up(node: Shape, at: tuple[int, ...]) -> Relation:
        stored = engine.relations[node.pred]
        if node.rule is None or not node.children:
            made[at] = engine._known(stored).distinct()
            return Relation(made[at], stored.kinds)
        places = [i for i, x in enumerate(node.rule.body) if isinstance(x, Atom)]
        below = {i: up(c, (*at, j)) for j, (i, c) in enumerate(zip(places, node.children))}
        bound = plan.body(node.rule, lambda i, a: below[i], lambda a: engine._relation(a.pred))
        head = next(h for h in node.rule.head if h.pred == node.pred)
        rows = plan.project(head, bound, stored.kinds)[0].distinct()
        # invented values can't be told from the body: of such a head, the rows that hold are kept
        if any(v.kind == "!" for v in variables(head)):
            rows = engine._known(stored).distinct()
        made[at] = materialised(rows)
        matches[at] = (head, bound, places)
        return Relation(made[at], stored.kinds)

    def down(node: Shape, at: tuple[int, ...]) -> None:
        if at not in matches:
            return
        head, bound, places = matches[at]
        stored = engine.relations[node.pred]
        used = bound
        if not any(v.kind == "!" for v in variables(head)):
            cells = [plan.as_kind(plan.expression(t, bound.col), k).alias(f"h{i}") for i, (t, k) in enumerate(zip(head.args, stored.kinds))]
            kept = made[at].select(*[F.col(f"c{i}").alias(f"h{i}") for i in range(len(stored.kinds))])
            used = plan.Bound(bound.df.select("*", *cells).join(kept, [f"h{i}" for i in range(len(cells))], "left_semi"), bound.kinds)
        for j, (i, child) in enumerate(zip(places, node.children)):
            below = engine.relations[child.pred]
            atom = node.rule.body[i]
            known = {k: plan.as_kind(plan.expression(t, used.col), below.kinds[k]) for k, t in enumerate(atom.args) if not any(v.kind == "_" for v in variables(t))}
            if known:
                keys = used.df.select(*[c.alias(f"c{k}") for k, c in known.items()]).distinct()
                made[(*at, j)] = materialised(made[(*at, j)].join(keys, [f"c{k}" for k in known], "left_semi"))
            down(child, (*at, j))

    up(shape, ())
    down(shape, ())
    return made
