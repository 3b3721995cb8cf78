"""Rules to DataFrames. Variables become columns ``v_<name>``; an environment knows each one's kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import ANY, TYPES, Col, as_kind, equal, join_kinds, literal, to_any
from ..functions.library import apply, regex_is_valid
from ..lang.ast import Agg, Atom, Not, Op, Rule, RuleError, Var, variables
from ..lang.values import Value


@dataclass
class Relation:
    """A set of rows in columns c0, c1, ... of known kinds; nullable where a foreign table may hold NULLs."""

    df: DataFrame
    kinds: list[str]
    nullable: bool = False
    small: bool = False  # counted, and below the engine's broadcast bound

    def hinted(self) -> DataFrame:
        return F.broadcast(self.df) if self.small else self.df


@dataclass
class Bound:
    """Rows under way in a rule, and the kind of each variable bound so far."""

    df: DataFrame
    kinds: dict[Var, str]

    def col(self, v: Var) -> Col:
        return Col(F.col(name_of(v)), self.kinds[v])


def name_of(v: Var) -> str:
    return f"v_{v.name}"


def expression(term, env: Callable[[Var], Col]) -> Col:
    if isinstance(term, Value):
        return literal(term)
    if isinstance(term, Var):
        return env(term)
    if isinstance(term, Op):
        if term.name == "REGEX" and not regex_is_valid(term.args[1]):
            return Col(F.lit(False), "b")
        return apply(term.name, [expression(a, env) for a in term.args])
    raise RuleError("this term isn't supported in a rule", 996)


def scan(relation: Relation, atom: Atom) -> tuple[Bound, list[tuple[str, Op | Value]]]:
    """An atom's matches: constants and repeated variables filter, ``_`` is pruned; operations are left as (column, term)."""
    df, first, keep, later = relation.hinted(), {}, [], []
    where: Column | None = None
    also = lambda a, b: b if a is None else a & b
    for i, (term, kind) in enumerate(zip(atom.args, relation.kinds)):
        c = Col(F.col(f"c{i}"), kind)
        if isinstance(term, Var) and term.kind == "_":
            continue
        if relation.nullable:
            where = also(where, c.c.isNotNull())
        if isinstance(term, Value):
            where = also(where, equal(c, literal(term)))
        elif isinstance(term, Var):
            if term in first:
                where = also(where, c.c == F.col(f"c{first[term]}") if kind == relation.kinds[first[term]] else equal(c, Col(F.col(f"c{first[term]}"), relation.kinds[first[term]])))
            else:
                first[term] = i
                keep.append(c.c.alias(name_of(term)))
        else:
            name = f"t_{i}"
            keep.append(c.c.alias(name))
            later.append((name, term, kind))
    if where is not None:
        df = df.where(where)
    return Bound(df.select(*keep), {v: relation.kinds[i] for v, i in first.items()}), later


def join(left: Bound | None, right: Bound, how: str = "inner") -> Bound:
    """A natural join on shared variables; variables of different kinds meet in the encoding that holds both."""
    if left is None:
        return right
    shared = [v for v in right.kinds if v in left.kinds]
    kinds = {**left.kinds} if how != "inner" else {**right.kinds, **left.kinds}
    ldf, rdf = left.df, right.df
    for v in shared:
        a, b = left.kinds[v], right.kinds[v]
        if a != b:
            if ANY not in (a, b):  # values of two domains are never equal
                rdf = rdf.where(F.lit(False))
                rdf = rdf.withColumn(name_of(v), F.lit(None).cast(TYPES[a]))
            else:
                if a != ANY:
                    ldf = ldf.withColumn(name_of(v), to_any(Col(F.col(name_of(v)), a)))
                if b != ANY:
                    rdf = rdf.withColumn(name_of(v), to_any(Col(F.col(name_of(v)), b)))
                kinds[v] = ANY
    if shared:
        return Bound(ldf.join(rdf, [name_of(v) for v in shared], how), kinds)
    if how == "left_anti":  # any match at all leaves nothing
        one = rdf.limit(1).select(F.lit(1).alias("one_"))
        return Bound(ldf.withColumn("one_", F.lit(1)).join(F.broadcast(one), "one_", "left_anti").drop("one_"), kinds)
    return Bound(ldf.crossJoin(rdf), kinds)


def settle(bound: Bound, ops: list[Op]) -> tuple[Bound, list[Op]]:
    """Uses every operation whose variables are bound: assignments first, then filters."""
    ops = list(ops)
    moved = True
    while moved:
        moved = False
        for o in ops:
            if o.name != "EQUALITY":
                continue
            for target, source in (o.args, o.args[::-1]):
                if isinstance(target, Var) and target not in bound.kinds and all(v in bound.kinds for v in variables(source)):
                    got = expression(source, bound.col)
                    bound = Bound(bound.df.withColumn(name_of(target), got.c).where(F.col(name_of(target)).isNotNull()), {**bound.kinds, target: got.k})
                    ops.remove(o)
                    moved = True
                    break
            if moved:
                break
    rest = []
    for o in ops:
        if all(v in bound.kinds for v in variables(o)):
            got = expression(o, bound.col)
            bound = Bound(bound.df.where(got.c if got.k == "b" else got.c["n"] == 1 if got.k == ANY else F.lit(False)), bound.kinds)
        else:
            rest.append(o)
    return bound, rest


def narrowed(bound: Bound, found: Bound, needed: set[Var]) -> Bound | None:
    """A join as a semi-join, where one side brings nothing that is needed and the other hasn't."""
    shared = [v for v in found.kinds if v in bound.kinds]
    for main, other in ((bound, found), (found, bound)):
        if shared and set(other.kinds) & needed <= set(main.kinds):
            got = join(main, Bound(other.df.select(*[name_of(v) for v in shared]).distinct(), {v: other.kinds[v] for v in shared}), "left_semi")
            return Bound(got.df, {v: got.kinds[v] for v in main.kinds})
    return None


def body(rule: Rule, relation: Callable[[int, Atom], Relation], negative: Callable[[Atom], Relation], first: int | None = None, keep: set[Var] | None = None) -> Bound:
    """All matches of a rule's body. Atoms join in an order that stays connected, from ``first`` on if given.

    With keep, other variables may be missing, and matches that differ in these alone may come as one."""
    atoms = [(i, x) for i, x in enumerate(rule.body) if isinstance(x, Atom)]
    ops = [x for x in rule.body if isinstance(x, Op)]
    positive = {v for _, a in atoms for v in variables(a)}
    assigned: set[Var] = set()
    for _ in ops:
        for o in ops:
            if o.name == "EQUALITY":
                for target, source in (o.args, o.args[::-1]):
                    if isinstance(target, Var) and set(variables(source)) <= positive | assigned:
                        assigned.add(target)
    known = positive | assigned
    inner = [o for o in ops if any(v not in known for v in variables(o))]  # on variables of negated atoms alone
    ops = [o for o in ops if o not in inner]
    bound: Bound | None = None
    left = sorted(atoms, key=lambda x: x[0] != first)
    later: list[tuple[str, object, str]] = []
    while left:
        reach = set(bound.kinds) if bound else set()
        pick = 0 if bound is None else max(range(len(left)), key=lambda j: (len(reach & set(variables(left[j][1]))), any(isinstance(t, Value) for t in left[j][1].args), -j))
        i, atom = left.pop(pick)
        found, more = scan(relation(i, atom), atom)
        names = [(n, f"t_{i}_{n}", t, k) for n, t, k in more]
        for old, new, t, k in names:
            found = Bound(found.df.withColumnRenamed(old, new), found.kinds)
            later.append((new, t, k))
        narrow = None
        if keep is not None and bound is not None and not later:
            own = [o for o in ops if variables(o) and set(variables(o)) <= set(found.kinds)]
            found, ops = settle(found, own)[0], [o for o in ops if o not in own]
            narrow = narrowed(bound, found, keep.union(*(variables(x) for x in [*(a for _, a in left), *ops, *inner, *(y for y in rule.body if isinstance(y, Not))])))
        bound = narrow or join(bound, found)
        bound, ops = settle(bound, ops)
        for entry in list(later):
            name, term, kind = entry
            if all(v in bound.kinds for v in variables(term)):
                value = expression(term, bound.col)
                bound = Bound(bound.df.where(equal(Col(F.col(name), kind), value)).drop(name), bound.kinds)
                later.remove(entry)
    if ops:
        raise RuleError(f"can't order the operations of a rule for {rule.head[0].pred}")
    for x in rule.body:
        if not isinstance(x, Not):
            continue
        found, more = scan(negative(x.atom), x.atom)
        own = [o for o in inner if set(variables(o)) <= set(found.kinds) | set(bound.kinds) and set(variables(o)) & set(found.kinds)]
        outside = {v for o in own for v in variables(o)} - set(found.kinds)
        if outside:
            raise RuleError("an operation on a negated atom's own variables may use only variables of that atom")
        for name, term, kind in more:
            if not all(v in found.kinds for v in variables(term)):
                value = expression(term, bound.col)
                fresh = Var(f"neg_{name}", "?")
                bound = Bound(bound.df.withColumn(name_of(fresh), value.c), {**bound.kinds, fresh: value.k})
                found = Bound(found.df.withColumnRenamed(name, name_of(fresh)), {**found.kinds, fresh: kind})
            else:
                found = Bound(found.df.where(equal(Col(F.col(name), kind), expression(term, found.col))).drop(name), found.kinds)
        found, _ = settle(found, own)
        shared = [v for v in found.kinds if v in bound.kinds]
        bound = join(bound, Bound(found.df.select(*[name_of(v) for v in shared]).distinct() if shared else found.df, {v: found.kinds[v] for v in shared}), "left_anti")
    return bound


def aggregate_of(term):
    if isinstance(term, Agg):
        return term
    if isinstance(term, Op):
        for a in term.args:
            found = aggregate_of(a)
            if found:
                return found
    return None


def replace_aggregate(term, by: Var):
    if isinstance(term, Agg):
        return by
    if isinstance(term, Op):
        return Op(term.name, tuple(replace_aggregate(a, by) for a in term.args))
    return term


def aggregated(kind: str, name: str, c: Column) -> tuple[Column, str]:
    """The aggregate over a column of distinct values, and its kind; what isn't a number doesn't count in sums, minima and maxima."""
    if name == "count":
        return F.count(F.lit(1)), "n"
    if kind == ANY:
        whole, part, single = (F.when(c["t"] == "n", c["n"]), F.when(c["t"] == "d", c["d"]), F.when(c["t"] == "f", c["d"]))
        make = lambda k, v: to_any(Col(v.cast(TYPES[k]), k))
        if name == "sum":
            mixed = (F.count(whole) > 0).cast("int") + (F.count(part) > 0).cast("int") + (F.count(single) > 0).cast("int") > 1
            total = F.coalesce(F.sum(whole).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(part), F.lit(0.0)) + F.coalesce(F.sum(single), F.lit(0.0))
            return F.when(mixed, make("d", total)).when(F.count(whole) > 0, make("n", F.sum(whole))).when(F.count(part) > 0, make("d", F.sum(part))).when(F.count(single) > 0, make("f", F.sum(single))), ANY
        op = F.min if name == "min" else F.max
        order = (("n", whole), ("f", single), ("d", part)) if name == "min" else (("d", part), ("f", single), ("n", whole))
        return F.coalesce(*[make(k, op(v)) for k, v in order]), ANY
    if kind not in "ndf":
        return F.max(F.lit(None).cast("bigint")), "n"
    value = {"sum": F.sum, "min": F.min, "max": F.max}[name](c)
    return value.cast(TYPES[kind]), kind


def aggregate(rule: Rule, bound: Bound) -> tuple[Rule, Bound]:
    """Groups by the other head terms' values (and variables around the aggregate) over the *set* of (group, value, told-apart)."""
    head = rule.head[0]
    at = next(i for i, t in enumerate(head.args) if aggregate_of(t))
    agg = aggregate_of(head.args[at])
    columns, kinds, terms = [], {}, []
    for i, t in enumerate(head.args):
        if i == at:
            terms.append(None)
            continue
        got = expression(t, bound.col)
        v = Var(f"g{i}", "?")
        columns.append(got.c.alias(name_of(v)))
        kinds[v] = got.k
        terms.append(v)
    around = [v for v in dict.fromkeys(variables(replace_aggregate(head.args[at], Value("n", 0)))) if v in bound.kinds]
    for v in around:
        columns.append(F.col(name_of(v)).alias(name_of(v)))
        kinds[v] = bound.kinds[v]
    value = expression(agg.arg, bound.col)
    extra = [F.col(name_of(v)).alias(f"x_{v.name}") for v in dict.fromkeys(agg.distinct) if isinstance(v, Var)]  # a variable equal to a constant tells nothing apart
    rows = bound.df.select(*columns, value.c.alias("a_"), *extra)
    for c in [name_of(v) for v in kinds] + ["a_"]:
        rows = rows.where(F.col(c).isNotNull())
    if agg.name != "min" and agg.name != "max":
        rows = rows.distinct()  # sets; least and greatest are the same over bags
    out, kind = aggregated(value.k, agg.name, F.col("a_"))
    groups = [F.col(name_of(v)) for v in kinds] or [F.lit(1).alias("one_")]
    result = Var("a_", "?")
    grouped = rows.groupBy(*groups).agg(out.alias(name_of(result))).where(F.col(name_of(result)).isNotNull())
    terms[at] = replace_aggregate(head.args[at], result)
    return Rule([Atom(head.pred, tuple(terms))], rule.body, rule.name, rule.display), Bound(grouped, {**kinds, result: kind})


def project(atom: Atom, bound: Bound, kinds: list[str] | None) -> tuple[DataFrame, list[str]]:
    """A head atom's rows; kinds of None are found, otherwise rows are encoded to fit."""
    made = [expression(t, bound.col) for t in atom.args]
    kinds = kinds or [m.k for m in made]
    df = bound.df.select(*[as_kind(m, k).alias(f"c{i}") for i, (m, k) in enumerate(zip(made, kinds))])
    for i, t in enumerate(atom.args):
        if not isinstance(t, (Var, Value)):
            df = df.where(F.col(f"c{i}").isNotNull())
    return df, kinds


def kinds_of_head(rule: Rule, kinds: dict[str, list[str]]) -> list[list[str]] | None:
    """Kinds of a rule's head columns, from those of its body's relations; None while one of these is unknown."""
    env: dict[Var, str] = {}
    for x in rule.body:
        if isinstance(x, Atom):
            if x.pred not in kinds:
                return None
            for t, k in zip(x.args, kinds[x.pred]):
                if isinstance(t, Var):
                    env[t] = k if t not in env or env[t] == k else (ANY if ANY in (k, env[t]) else env[t])
    look = lambda v: Col(F.col("x").cast(TYPES[env[v]]), env[v])
    ops = [x for x in rule.body if isinstance(x, Op) and x.name == "EQUALITY"]
    for _ in ops:
        for o in ops:
            for target, source in (o.args, o.args[::-1]):
                if isinstance(target, Var) and target not in env and all(v in env for v in variables(source)):
                    env[target] = expression(source, look).k
    for h in rule.head:
        for v in variables(h):
            if v.kind == "!":
                env[v] = "z"
    out = []
    for h in rule.head:
        row = []
        for t in h.args:
            agg = aggregate_of(t)
            if agg:
                result = Var("a_", "?")
                env[result] = aggregated(expression(agg.arg, look).k, agg.name, F.col("x"))[1] if agg.name != "count" else "n"
                t = replace_aggregate(t, result)
            row.append(expression(t, look).k)
        out.append(row)
    return out


def merged(a: list[str] | None, b: list[str]) -> list[str]:
    return b if a is None else [join_kinds(x, y) for x, y in zip(a, b)]
