"""Rules whose head pairs values of one body atom with values of the others, where many meet many.

Such a result can be far larger than its inputs, so it is never shuffled. Head values that meet partners by the same set of
values are one class. Which classes meet is found among classes, once each; their members are then paired in cells of at
most about BLOCK by BLOCK rows, dealt over as many tasks as the count of pairs asks for. A value is in one class and one
block, so no pair comes twice and none has to be told from its like.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Atom, Not, Op, Rule, Var, variables
from ..lang.values import Value
from .compile import Bound, Relation, body, join, name_of, scan, settle
from .storage import materialised

MANY = 4_000_000  # up to so many pairs a rule is joined as it stands
SPREAD = 4  # ... as it is where pairs aren't more than so many times the rows that meet, or classes spare less than that
BLOCK = 4096  # rows of a side in a cell
TASK = 1 << 25  # pairs made by a task, on average


@dataclass
class Sides:
    """The two sides of a rule: the places of their atoms, operations on one side alone, between what meets, and on pairs."""

    left: list[int]
    right: int
    heads: tuple[list[Var], list[Var]]
    meets: tuple[list[Var], list[Var]]
    own: tuple[list[Op], list[Op]]
    inner: list[Op]
    outer: list[Op]


def bound_by(atoms: list[Atom]) -> set[Var]:
    return {v for a in atoms for v in variables(a) if v.kind == "?"}


def connected(atoms: list[Atom]) -> bool:
    seen, left = bound_by(atoms[:1]), atoms[1:]
    while left:
        at = next((i for i, a in enumerate(left) if seen & bound_by([a])), None)
        if at is None:
            return False
        seen |= bound_by([left.pop(at)])
    return True


def sides(rule: Rule) -> Sides | None:
    """How a rule falls into sides that each bring values to the head; None where it doesn't, or computes values."""
    places = [i for i, x in enumerate(rule.body) if isinstance(x, Atom)]
    ops = [x for x in rule.body if isinstance(x, Op)]
    atoms = [rule.body[i] for i in places]
    plain = all(isinstance(t, (Var, Value)) for a in [*rule.head, *atoms] for t in a.args)
    if len(rule.head) != 1 or len(atoms) < 2 or not plain or any(isinstance(x, Not) for x in rule.body) or any(not set(variables(o)) <= bound_by(atoms) for o in ops):
        return None
    head = list(dict.fromkeys(variables(rule.head[0])))
    for right in reversed(places):
        others = [rule.body[i] for i in places if i != right]
        l, r = bound_by(others), bound_by([rule.body[right]])
        heads = [v for v in head if v in l], [v for v in head if v in r - l]
        if not heads[1] or not set(heads[0]) - r or not connected(others):
            continue
        own = [o for o in ops if set(variables(o)) <= l], [o for o in ops if set(variables(o)) <= r and not set(variables(o)) <= l]
        cross = [o for o in ops if not set(variables(o)) <= l and not set(variables(o)) <= r]
        outer = [o for o in cross if set(variables(o)) <= set(head)]
        inner = [o for o in cross if o not in outer]
        asked = (l & r) | {v for o in inner for v in variables(o)}
        order = sorted(asked, key=lambda v: v.name)
        return Sides([i for i in places if i != right], right, heads, ([v for v in order if v in l], [v for v in order if v in r]), own, inner, outer)
    return None


def weigh(left: Bound, right: Bound) -> tuple[float, float]:
    """How many pairs of rows meet on the shared variables, and how many rows of both sides do."""
    shared = [v for v in right.kinds if v in left.kinds]
    count = lambda side, name: Bound(side.df.groupBy(*[name_of(v) for v in shared]).agg(F.count(F.lit(1)).cast("double").alias(name)), {v: side.kinds[v] for v in shared})
    met = join(count(left, "l_"), count(right, "r_")).df
    row = met.agg(F.sum(F.col("l_") * F.col("r_")), F.sum(F.col("l_") + F.col("r_"))).first()
    return row[0] or 0.0, row[1] or 0.0


def only(side: Bound, keep: list[Var]) -> Bound:
    keep = list(dict.fromkeys(keep))
    return Bound(side.df.select(*[name_of(v) for v in keep]), {v: side.kinds[v] for v in keep})


def classes(side: Bound, head: list[Var], meets: list[Var], at: str) -> tuple[DataFrame, Bound]:
    """Each head value with its class and block; and the classes: their number, size, and the values that they meet by."""
    names = [name_of(v) for v in head]
    what = F.struct(*[F.col(name_of(v)).alias(f"m{i}") for i, v in enumerate(meets)] or [F.lit(0).alias("m0")])
    sets = materialised(side.df.groupBy(*names).agg(F.sort_array(F.collect_set(what)).alias("s_")))
    known = materialised(sets.groupBy("s_").agg(F.count(F.lit(1)).alias(f"n{at}")).withColumn(f"c{at}", F.monotonically_increasing_id()))
    members = sets.join(known, "s_").select(f"c{at}", F.expr(f"pmod(xxhash64({', '.join(names)}), {blocks(at)})").alias(f"b{at}"), *names)
    each = known.select(f"c{at}", f"n{at}", F.explode("s_").alias("e_"))
    return materialised(members), Bound(each.select(f"c{at}", f"n{at}", *[F.col(f"e_.m{i}").alias(name_of(v)) for i, v in enumerate(meets)]), {v: side.kinds[v] for v in meets})


def blocks(at: str) -> str:
    return f"CAST(ceil(n{at} / {BLOCK}) AS BIGINT)"


def paired(rule: Rule, relation: Callable[[int, Atom], Relation], negative: Callable[[Atom], Relation], broadcast_rows: int) -> Bound | None:
    """The distinct values of a rule's head variables; None where the rule is as well joined as it stands."""
    found = sides(rule)
    if found is None:
        return None
    part = [rule.body[i] for i in found.left] + found.own[0]
    left = body(Rule([], part), lambda i, a: relation(found.left[i], a), negative, keep={*found.heads[0], *found.meets[0]})
    right, _ = settle(scan(relation(found.right, rule.body[found.right]), rule.body[found.right])[0], found.own[1])
    left, right = (only(s, h + m) for s, h, m in zip((left, right), found.heads, found.meets))
    pairs, rows = weigh(left, right)
    if pairs <= max(MANY, SPREAD * rows):
        return None
    (lm, lc), (rm, rc) = (classes(s, h, m, at) for s, h, m, at in zip((left, right), found.heads, found.meets, "lr"))
    if weigh(lc, rc)[0] * SPREAD > pairs:
        return None
    meeting = settle(join(lc, rc), found.inner)[0].df.select("cl", "nl", "cr", "nr").distinct()
    each = lambda at: F.explode(F.expr(f"sequence(0L, {blocks(at)} - 1)")).alias(f"b{at}")
    cells = meeting.select("*", each("l")).select("*", each("r"))
    cells = materialised(cells.withColumn("cell_", F.monotonically_increasing_id()))
    n, total = cells.agg(F.count(F.lit(1)), F.sum(F.expr(f"nl / {blocks('l')} * nr / {blocks('r')}"))).first()
    tasks = max(left.df.sparkSession.sparkContext.defaultParallelism, ceil((total or 0) / TASK))

    def dealt(members: DataFrame, at: str, names: list[str]) -> DataFrame:
        where = cells.select(f"c{at}", f"b{at}", "cell_")
        return members.join(F.broadcast(where) if n <= broadcast_rows else where, [f"c{at}", f"b{at}"]).select("cell_", *names).repartition(tasks, "cell_")

    (ln, rn) = ([name_of(v) for v in h] for h in found.heads)
    out = dealt(lm, "l", ln).hint("merge").join(dealt(rm, "r", rn), "cell_").select(*ln, *rn)
    kinds = {**{v: right.kinds[v] for v in found.heads[1]}, **{v: left.kinds[v] for v in found.heads[0]}}
    return settle(Bound(out, kinds), found.outer)[0]
