"""Ground values of the rule language: a domain tag, a payload and, for some, a language tag or datatype."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

#: Domain tags. n integer, d double, f float, s string, i IRI or name, b boolean, z labelled null,
#: l language-tagged string, o literal of another datatype, u unsigned integer beyond 63 bits.
TAGS = "ndfsibzlou"


@dataclass(frozen=True)
class Value:
    tag: str
    value: object
    extra: str | None = None

    def __str__(self) -> str:
        return canonical(self)


def integer(text: str) -> Value:
    v = int(text)
    if -(1 << 63) <= v < 1 << 63:
        return Value("n", v)
    return Value("o", str(v), XSD + "integer")


def typed_literal(text: str, datatype: str) -> Value:
    """A quoted literal with a datatype, in the domain that the datatype names if the text fits it."""
    name = datatype[len(XSD) :] if datatype.startswith(XSD) else None
    try:
        if name == "string":
            return Value("s", text)
        if name == "anyURI":
            return Value("i", text)
        if name == "boolean" and text in ("true", "1", "false", "0"):
            return Value("b", text in ("true", "1"))
        if name == "double":
            v = float(text)
            if math.isfinite(v):
                return Value("d", v)
        if name in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger", "nonPositiveInteger", "negativeInteger"):
            if re.fullmatch(r"[+-]?\d+", text):
                v = int(text)
                low, high = {"byte": (-128, 127), "short": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, (1 << 32) - 1), "unsignedLong": (0, (1 << 64) - 1), "nonNegativeInteger": (0, 1 << 200), "positiveInteger": (1, 1 << 200), "nonPositiveInteger": (-(1 << 200), 0), "negativeInteger": (-(1 << 200), -1)}.get(name, (-(1 << 200), 1 << 200))
                if low <= v <= high:
                    if -(1 << 63) <= v < 1 << 63:
                        return Value("n", v)
                    if name == "unsignedLong":
                        return Value("u", v)
        if name == "decimal" and re.fullmatch(r"[+-]?\d+(\.0*)?", text):
            v = int(text.split(".")[0])
            if -(1 << 63) <= v < 1 << 63:
                return Value("n", v)
    except ValueError:
        pass
    return Value("o", text, datatype)


def double_text(v: float) -> str:
    """Integral doubles print without a fraction."""
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return repr(v)


def datatype_of(v: Value) -> str:
    if v.tag == "n":
        return XSD + ("int" if -(1 << 31) <= v.value < 1 << 31 else "long")
    return {"d": XSD + "double", "f": XSD + "float", "s": XSD + "string", "i": XSD + "anyURI", "b": XSD + "boolean", "l": RDF + "langString", "u": XSD + "unsignedLong"}.get(v.tag) or v.extra or ""


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def is_name(text: str) -> bool:
    return re.fullmatch(r"[^\W\d_][\w%]*", text) is not None


def canonical(v: Value) -> str:
    """The compact syntax in which exports and results show a value."""
    if v.tag == "n":
        return str(v.value)
    if v.tag == "d":
        return f'"{double_text(v.value)}"^^<{XSD}double>'
    if v.tag == "f":
        return f'"{double_text(v.value)}"^^<{XSD}float>'
    if v.tag == "s":
        return quoted(v.value)
    if v.tag == "i":
        return v.value if is_name(v.value) else f"<{v.value}>"
    if v.tag == "b":
        return f'"{"true" if v.value else "false"}"^^<{XSD}boolean>'
    if v.tag == "z":
        return v.value
    if v.tag == "l":
        return f"{quoted(v.value)}@{v.extra}"
    if v.tag == "u":
        return f'"{v.value}"^^<{XSD}unsignedLong>'
    return f"{quoted(v.value)}^^<{v.extra}>"
