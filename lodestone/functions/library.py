"""The language's scalar functions as Column builders.

A builder gets columns of single domains and gives a column, or None where the function isn't defined for
those domains. ``apply`` lifts builders to columns of several domains by cases on their tags. Undefined
results are NULL; rules drop such rows. Everything stays inside Catalyst: no Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import RuleError
from ..lang.values import Value
from .encoding import ANY, TYPES, Col, as_kind, canonical_text, datatype, equal, from_any, join_kinds, lexical, to_any

NUMERIC = "ndf"
TEXT = "sl"
BIG = (1 << 63) - 1


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def both(*cols: Col) -> Column:
    out = cols[0].c.isNotNull()
    for x in cols[1:]:
        out = out & x.c.isNotNull()
    return out


def numbers(*cols: Col) -> tuple[list[Column], str] | None:
    """Numeric arguments in one domain: their own if they share it, double otherwise."""
    if any(x.k not in NUMERIC for x in cols):
        return None
    kinds = {x.k for x in cols}
    k = kinds.pop() if len(kinds) == 1 else "d"
    return [x.c.cast(TYPES[k]) for x in cols], k


def real(c: Column, k: str) -> Col:
    return Col(finite(c).cast(TYPES[k]), k)


def arithmetic(whole: Callable[[Column, Column], Column], part: Callable[[Column, Column], Column]):
    def build(a: Col, b: Col) -> Col | None:
        got = numbers(a, b)
        if got is None:
            return None
        (x, y), k = got
        return Col(whole(x, y), "n") if k == "n" else real(part(x, y), k)

    return build


def folded(step):
    """A function of any number of arguments, from one of two; none gives nothing."""

    def build(*cols: Col) -> Col | None:
        if not cols:
            return None
        if len(cols) == 1:
            return cols[0] if cols[0].k in NUMERIC else None
        kinds = {x.k for x in cols}
        if any(k not in NUMERIC for k in kinds):
            return None
        if len(kinds) > 1:
            cols = tuple(Col(x.c.cast("double"), "d") for x in cols)
        out = cols[0]
        for x in cols[1:]:
            out = step(out, x)
        return out

    return build


def whole_division(x: Column, y: Column) -> Column:
    ok = (y != 0) & ~((x == -BIG - 1) & (y == -1))
    return F.when(ok, F.call_function("div", x, F.when(ok, y)))


def whole_power(x: Column, y: Column) -> Column:
    """Exact in 64 bits; undefined for negative exponents and where the result doesn't fit."""
    unit = F.when(x == 1, F.lit(1)).when(x == 0, F.when(y == 0, 1).otherwise(0)).when(x == -1, F.when(y % 2 == 0, 1).otherwise(-1)).cast("bigint")
    times = F.array_repeat(x, F.when(y.between(0, 63), y).otherwise(0).cast("int"))
    product = F.aggregate(times, F.lit(1).cast("bigint"), lambda total, factor: F.try_multiply(total, factor))
    return F.when(y < 0, F.lit(None)).when(x.isin(-1, 0, 1), unit).when(y < 64, product)


def whole_log(x: Column, base: Column) -> Column:
    ok = (x > 0) & (base >= 2)
    guess = F.floor(F.log(F.when(ok, x).cast("double")) / F.log(F.when(ok, base).cast("double"))).cast("bigint")
    up, same = whole_power(base, guess + 1), whole_power(base, guess)
    return F.when(ok, F.when(up <= x, guess + 1).when(same > x, guess - 1).otherwise(guess))


def whole_root(x: Column) -> Column:
    guess = F.floor(F.sqrt(F.when(x >= 0, x).cast("double"))).cast("bigint")
    return F.when(x >= 0, F.when(F.try_multiply(guess, guess) > x, guess - 1).when(F.try_multiply(guess + 1, guess + 1) <= x, guess + 1).otherwise(guess))


def unary(whole: Callable[[Column], Column] | None, part: Callable[[Column], Column]):
    def build(a: Col) -> Col | None:
        if a.k not in NUMERIC or a.k == "n" and whole is None:
            return None
        return Col(whole(a.c), "n") if a.k == "n" else real(part(a.c.cast("double")), a.k)

    return build


def rounding(op: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """op, which goes through 64-bit integers, on doubles that have a fraction; from 2^52 on none has."""
    return lambda c: F.when(F.abs(c) < float(1 << 52), op(c).cast("double")).otherwise(c)


half_away = rounding(lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5))


def comparison(op: Callable[[Column, Column], Column]):
    def build(a: Col, b: Col) -> Col | None:
        got = numbers(a, b)
        return None if got is None else Col(op(*got[0]), "b")

    return build


def truth(start: bool, op):
    def build(*cols: Col) -> Col | None:
        if any(x.k != "b" for x in cols):
            return None
        if not cols:
            return Col(F.lit(start), "b")
        out = cols[0].c
        for x in cols[1:]:
            out = op(out, x.c)
        return Col(F.when(both(*cols), out), "b")

    return build


def bits(op: Callable[[Column, Column], Column], start: int):
    def build(*cols: Col) -> Col | None:
        if any(x.k != "n" for x in cols) or not cols:
            return None
        out = F.lit(start).cast("bigint")
        for x in cols:
            out = op(out, x.c)
        return Col(out, "n")

    return build


def shift(op):
    def build(a: Col, b: Col) -> Col | None:
        return Col(F.when(b.c.between(0, 63), F.call_function(op, a.c, b.c.cast("int"))), "n") if a.k == b.k == "n" else None

    return build


def least_or_greatest(op):
    def build(*cols: Col) -> Col | None:
        if not cols:
            return None
        got = numbers(*cols)
        if got is None:
            return None
        values, k = got
        return Col(F.when(both(*cols), op(*values) if len(values) > 1 else values[0]), k)

    return build


def luka(*cols: Col) -> Col | None:
    if not cols or any(x.k not in "df" for x in cols):
        return None
    values, k = numbers(*cols)
    total = values[0]
    for x in values[1:]:
        total = total + x
    return real(F.when(both(*cols), F.greatest(F.lit(0.0), total - (len(values) - 1))), k)


def text_of(a: Col) -> Column:
    return a.c["v"] if a.k == "l" else a.c


def compatible(a: Col, b: Col) -> Column | None:
    """Both plain, the first tagged and the second plain, or both of one tag."""
    if a.k not in TEXT or b.k not in TEXT or a.k == "s" and b.k == "l":
        return None
    return a.c["x"] == b.c["x"] if a.k == b.k == "l" else F.lit(True)


def on_texts(op: Callable[[Column, Column], Column], kind: str):
    def build(a: Col, b: Col) -> Col | None:
        ok = compatible(a, b)
        return None if ok is None else Col(F.when(ok, op(text_of(a), text_of(b))), kind)

    return build


def tagged(text: Column, like: Col) -> Col:
    return Col(text, "s") if like.k == "s" else Col(F.when(text.isNotNull(), F.struct(text.alias("v"), like.c["x"].alias("x"))), "l")


def cut(after: bool):
    def build(a: Col, b: Col) -> Col | None:
        ok = compatible(a, b)
        if ok is None:
            return None
        text, mark = text_of(a), text_of(b)
        at = F.call_function("locate", mark, text)
        part = F.substring(text, at + F.length(mark), F.lit(1 << 30)) if after else F.substring(text, F.lit(1), at - 1)
        if a.k == "s":
            return Col(F.when(at > 0, part).when(at == 0, ""), "s")
        found = F.when(ok & (at > 0), tagged(part, a).c)
        # without a match the result is the plain empty string, so the domain differs by row
        return Col(F.when(found.isNotNull(), to_any(Col(found, "l"))).when(ok & (at == 0), to_any(Col(F.lit(""), "s"))), ANY)

    return build


CLUSTER = r"\X"


def has_clusters(c: Column) -> Column:
    """Whether a text may hold signs of several code points; ASCII texts have none but line ends of two."""
    return c.rlike(r"[^\x00-\x7F]|\r\n")


def clusters(c: Column) -> Column:
    """The signs of a text as readers see them: grapheme clusters."""
    return F.regexp_extract_all(c, F.lit(CLUSTER), F.lit(0))


def part_of(c: Column, first: Column, size: Column) -> Column:
    """size signs from the first-th on."""
    return F.when(has_clusters(c), F.array_join(F.slice(clusters(c), first.cast("int"), size.cast("int")), "")).otherwise(F.substring(c, first.cast("int"), size.cast("int")))


def substring(a: Col, start: Col, length: Col | None = None) -> Col | None:
    if a.k not in TEXT or start.k not in NUMERIC or length is not None and length.k not in NUMERIC:
        return None
    text, begin = text_of(a), start.c.cast("bigint") if start.k == "n" else half_away(start.c.cast("double")).cast("bigint")
    first = F.greatest(begin, F.lit(1).cast("bigint"))
    if length is None:
        part = part_of(text, first, F.lit(1 << 30))
        return tagged(F.when(begin.isNotNull(), F.when(first > F.length(text), "").otherwise(part)), a)
    size = length.c.cast("bigint") if length.k == "n" else half_away(length.c.cast("double")).cast("bigint")
    end = begin + size
    part = F.when(end <= first, "").otherwise(part_of(text, first, F.least(end - first, F.lit(1 << 30))))
    return tagged(F.when(begin.isNotNull() & size.isNotNull(), part), a)


def concat(*cols: Col) -> Col | None:
    if any(x.k not in TEXT for x in cols):
        return None
    text = F.concat(*map(text_of, cols)) if cols else F.lit("")
    if not cols or any(x.k == "s" for x in cols):
        return Col(text, "s")
    same = F.lit(True)
    for x in cols[1:]:
        same = same & (x.c["x"] == cols[0].c["x"])
    if len(cols) == 1:
        return cols[0]
    return Col(F.when(same, to_any(tagged(text, cols[0]))).otherwise(to_any(Col(text, "s"))), ANY)


def regex(a: Col, b: Col) -> Col | None:
    ok = compatible(a, b)
    if ok is None:
        return None
    return Col(F.when(ok, F.call_function("regexp_like", text_of(a), text_of(b))), "b")


def of_text(op: Callable[[Column], Column], kind: str | None = None):
    def build(a: Col) -> Col | None:
        if a.k not in TEXT:
            return None
        out = op(text_of(a))
        return Col(out, kind) if kind else tagged(out, a)

    return build


def uri_encode(c: Column) -> Column:
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def uri_decode(c: Column) -> Column:
    whole = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(~whole.contains("�") | c.contains("�"), whole)


WHOLE = r"^[+-]?\d+$"


def whole_text(c: Column) -> Column:
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    bare = F.regexp_replace(c, r"^[+-]", "")
    out = F.when(c.rlike(WHOLE), c.try_cast("bigint"))
    for mark, base in (("0b", 2), ("0o", 8), ("0x", 16)):
        digits = {2: "[01]+", 8: "[0-7]+", 16: "[0-9A-Fa-f]+"}[base]
        out = F.when(bare.rlike(f"^{mark}{digits}$"), F.conv(F.substring(bare, 3, 80), base, 10).try_cast("bigint") * sign).otherwise(out)
    return out


def to_int(a: Col) -> Col | None:
    if a.k == "n":
        return a
    if a.k in "df":
        d = a.c.cast("double")
        return Col(F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.cast("bigint")), "n")
    if a.k == "b":
        return Col(a.c.cast("bigint"), "n")
    return Col(whole_text(a.c if a.k == "s" else a.c["v"]), "n") if a.k in "so" else None


def to_real(k: str):
    def build(a: Col) -> Col | None:
        if a.k in NUMERIC:
            return real(a.c.cast(TYPES[k]), k)
        if a.k in "so":
            text = a.c if a.k == "s" else a.c["v"]
            return real(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast(TYPES[k])), k)
        return None

    return build


def check(kinds: str):
    return lambda a: Col(F.when(a.c.isNotNull(), F.lit(a.k in kinds)), "b")


BUILDERS: dict[str, Callable[..., Col | None]] = {
    "EQUALITY": lambda a, b: Col(equal(a, b), "b"),
    "UNEQUALITY": lambda a, b: Col(~equal(a, b), "b"),
    "FULLSTR": lambda a: Col(canonical_text(a), "s"),
    "STR": lambda a: None if a.k == "z" else Col(lexical(a), "s"),
    "DATATYPE": lambda a: None if a.k == "z" else Col(datatype(a), "i"),
    "ISINTEGER": check("n"),
    "ISFLOAT": check("f"),
    "ISDOUBLE": check("d"),
    "ISNUMERIC": check(NUMERIC),
    "ISNULL": check("z"),
    "ISIRI": check("i"),
    "ISSTRING": check("s"),
    "INT": to_int,
    "DOUBLE": to_real("d"),
    "FLOAT": to_real("f"),
    "IRI": lambda a: Col(a.c, "i") if a.k in "si" else None,
    "LANG": lambda a: Col(a.c["x"], "s") if a.k == "l" else Col(F.when(a.c.isNotNull(), F.lit("")), "s") if a.k == "s" else None,
    "STRLANG": lambda a, b: Col(F.when(both(a, b), F.struct(a.c.alias("v"), b.c.alias("x"))), "l") if a.k == b.k == "s" else None,
    "AND": truth(True, lambda x, y: x & y),
    "OR": truth(False, lambda x, y: x | y),
    "NOT": lambda a: Col(~a.c, "b") if a.k == "b" else None,
    "NUMLESS": comparison(lambda x, y: x < y),
    "NUMLESSEQ": comparison(lambda x, y: x <= y),
    "NUMGREATER": comparison(lambda x, y: x > y),
    "NUMGREATEREQ": comparison(lambda x, y: x >= y),
    "SUM": folded(arithmetic(F.try_add, lambda x, y: x + y)),
    "PRODUCT": folded(arithmetic(F.try_multiply, lambda x, y: x * y)),
    "SUBTRACTION": arithmetic(F.try_subtract, lambda x, y: x - y),
    "DIVISION": arithmetic(whole_division, lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))),
    "REM": arithmetic(lambda x, y: F.when(y != 0, F.try_mod(x, y)), lambda x, y: F.when(y != 0, F.try_mod(x, y))),
    "POW": arithmetic(whole_power, lambda x, y: F.pow(x, y)),
    "LOG": arithmetic(whole_log, lambda x, y: F.try_divide(F.log(x.cast("double")), F.log(y.cast("double")))),
    "SQRT": unary(whole_root, lambda c: F.when(c >= 0, F.sqrt(c))),
    "ABS": unary(lambda c: F.when(c != -BIG - 1, F.abs(F.when(c != -BIG - 1, c))), F.abs),
    "INVERTSIGN": unary(lambda c: F.try_subtract(F.lit(0).cast("bigint"), c), lambda c: -c),
    "SIN": unary(None, F.sin),
    "COS": unary(None, F.cos),
    "TAN": unary(None, F.tan),
    "ROUND": unary(lambda c: c, half_away),
    "CEIL": unary(lambda c: c, rounding(F.ceil)),
    "FLOOR": unary(lambda c: c, rounding(F.floor)),
    "MIN": least_or_greatest(F.least),
    "MAX": least_or_greatest(F.greatest),
    "LUKA": luka,
    "BITAND": bits(lambda x, y: x.bitwiseAND(y), BIG),
    "BITOR": bits(lambda x, y: x.bitwiseOR(y), 0),
    "BITXOR": bits(lambda x, y: x.bitwiseXOR(y), 0),
    "BITSHL": shift("shiftleft"),
    "BITSHR": shift("shiftright"),
    "BITSHRU": shift("shiftrightunsigned"),
    "COMPARE": on_texts(lambda x, y: F.when(x < y, -1).when(x == y, 0).when(x > y, 1).cast("bigint"), "n"),
    "CONCAT": concat,
    "CONTAINS": on_texts(lambda x, y: F.contains(x, y), "b"),
    "STRSTARTS": on_texts(lambda x, y: F.startswith(x, y), "b"),
    "STRENDS": on_texts(lambda x, y: F.endswith(x, y), "b"),
    "STRBEFORE": cut(False),
    "STRAFTER": cut(True),
    "SUBSTR": substring,
    "REGEX": regex,
    "LEVENSHTEIN": on_texts(lambda x, y: F.levenshtein(x, y).cast("bigint"), "n"),
    "STRLEN": of_text(lambda c: F.when(has_clusters(c), F.regexp_count(c, F.lit(CLUSTER))).otherwise(F.length(c)).cast("bigint"), "n"),
    "STRREV": of_text(lambda c: F.when(has_clusters(c), F.array_join(F.reverse(clusters(c)), "")).otherwise(F.reverse(c))),
    "UCASE": of_text(F.upper),
    "LCASE": of_text(F.lower),
    "URIENCODE": of_text(uri_encode, "s"),
    "URIDECODE": of_text(uri_decode, "s"),
}
#: How many arguments the functions take that don't take any number.
ARITY = {name: (1, 1) for name in "FULLSTR STR DATATYPE ISINTEGER ISFLOAT ISDOUBLE ISNUMERIC ISNULL ISIRI ISSTRING INT DOUBLE FLOAT IRI LANG NOT SQRT ABS INVERTSIGN SIN COS TAN ROUND CEIL FLOOR STRLEN STRREV UCASE LCASE URIENCODE URIDECODE".split()}
ARITY |= {name: (2, 2) for name in "EQUALITY UNEQUALITY STRLANG NUMLESS NUMLESSEQ NUMGREATER NUMGREATEREQ SUBTRACTION DIVISION REM POW LOG BITSHL BITSHR BITSHRU COMPARE CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER REGEX LEVENSHTEIN".split()}
ARITY["SUBSTR"] = (2, 3)
#: What takes values of several domains as they are.
DIRECT = ("EQUALITY", "UNEQUALITY", "FULLSTR", "STR", "DATATYPE")
#: The domains in which a function can be defined, where few are: fewer cases for mixed columns.
DOMAINS = {n: NUMERIC for n in "NUMLESS NUMLESSEQ NUMGREATER NUMGREATEREQ SUM PRODUCT SUBTRACTION DIVISION REM POW LOG SQRT ABS INVERTSIGN SIN COS TAN ROUND CEIL FLOOR MIN MAX LUKA".split()}
DOMAINS |= {n: "n" for n in "BITAND BITOR BITXOR BITSHL BITSHR BITSHRU".split()} | {n: "b" for n in ("AND", "OR", "NOT")} | {"SUBSTR": "slndf"}
DOMAINS |= {n: TEXT for n in "LANG STRLANG COMPARE CONCAT CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER REGEX LEVENSHTEIN STRLEN STRREV UCASE LCASE URIENCODE URIDECODE".split()}


def undefined(k: str = "s") -> Col:
    return Col(F.lit(None).cast(TYPES[k]), k)


def apply(name: str, args: list[Col]) -> Col:
    """The function's value for arguments of any kind, by cases where an argument's domain differs by row."""
    low, high = ARITY.get(name, (0, 99))
    if not low <= len(args) <= high:
        raise RuleError(f"{name} doesn't take {len(args)} arguments", 217)
    build = BUILDERS[name]
    if name in DIRECT or all(a.k != ANY for a in args):
        if name == "STR" and args[0].k == ANY:
            return Col(F.when(args[0].c["t"] != "z", lexical(args[0])), "s")
        return build(*args) or undefined()
    if name.startswith("IS"):
        kinds = {"ISINTEGER": "n", "ISFLOAT": "f", "ISDOUBLE": "d", "ISNUMERIC": NUMERIC, "ISNULL": "z", "ISIRI": "i", "ISSTRING": "s"}[name]
        return Col(args[0].c["t"].isin(*kinds), "b")
    if len(args) > 2 and name in ("SUM", "PRODUCT", "MIN", "MAX", "AND", "OR", "BITAND", "BITOR", "BITXOR"):
        out = args[0]
        for a in args[1:]:
            out = apply(name, [out, a])
        return out
    cases: list[tuple[Column, Col]] = []

    def choose(i: int, chosen: list[Col], where: Column | None) -> None:
        if i == len(args):
            got = build(*chosen)
            if got is not None:
                cases.append((where, got))
            return
        if args[i].k != ANY:
            choose(i + 1, [*chosen, args[i]], where)
            return
        for k in DOMAINS.get(name, "ndfsibzlou"):
            is_k = args[i].c["t"] == k
            choose(i + 1, [*chosen, Col(from_any(args[i].c, k), k)], is_k if where is None else where & is_k)

    choose(0, [], None)
    if not cases:
        return undefined()
    kind = join_kinds(*(c.k for _, c in cases))
    out = F.lit(None).cast(TYPES[kind])
    for where, c in reversed(cases):
        out = F.when(where, as_kind(c, kind)).otherwise(out)
    return Col(out, kind)


def regex_is_valid(pattern: object) -> bool:
    """Whether a constant pattern can be used; an invalid one matches nothing."""
    import re

    if not isinstance(pattern, Value):
        return True
    try:
        re.compile(str(pattern.value))
        return True
    except re.error:
        return False
