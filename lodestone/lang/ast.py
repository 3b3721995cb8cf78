"""The program as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from .values import Value


class RuleError(ValueError):
    """A program that can't be read or isn't valid; code is the number of the violated check, if it has one."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(f"[{code}] {message}" if code else message)
        self.code = code


@dataclass(frozen=True)
class Var:
    name: str
    kind: str = "?"  # ? universal, ! existential, _ anonymous, $ parameter


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: object
    distinct: tuple


@dataclass(frozen=True)
class Tuple_:
    """A tuple or map: allowed in directives, rejected in rules."""

    items: tuple
    tag: str | None = None


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple


@dataclass(frozen=True)
class Not:
    atom: Atom


@dataclass
class Rule:
    head: list[Atom]
    body: list  # Atom, Not or Op
    name: str | None = None
    display: str | None = None


@dataclass
class Import:
    pred: str
    format: str
    params: dict
    guards: list = field(default_factory=list)


@dataclass
class Export(Import):
    pass


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    facts: list[Atom] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    exports: list[Export] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    base: str | None = None
    prefixes: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def variables(term) -> list[Var]:
    """Variables of a term, atom or literal, in order, with repeats."""
    if isinstance(term, Var):
        return [term]
    if isinstance(term, Op):
        return [v for a in term.args for v in variables(a)]
    if isinstance(term, Agg):
        return variables(term.arg) + [v for d in term.distinct for v in variables(d)]
    if isinstance(term, Atom):
        return [v for a in term.args for v in variables(a)]
    if isinstance(term, Not):
        return variables(term.atom)
    if isinstance(term, Tuple_):
        return [v for a in term.items for v in variables(a)]
    return []


def substitute(term, map_: dict):
    """term with variables replaced; map_ goes from Var to any term."""
    if isinstance(term, Var):
        return map_.get(term, term)
    if isinstance(term, Op):
        return Op(term.name, tuple(substitute(a, map_) for a in term.args))
    if isinstance(term, Agg):
        return Agg(term.name, substitute(term.arg, map_), tuple(substitute(d, map_) for d in term.distinct))
    if isinstance(term, Atom):
        return Atom(term.pred, tuple(substitute(a, map_) for a in term.args))
    if isinstance(term, Not):
        return Not(substitute(term.atom, map_))
    if isinstance(term, Tuple_):
        return Tuple_(tuple(substitute(a, map_) for a in term.items), term.tag)
    return term


def constant(term) -> bool:
    return isinstance(term, Value)
