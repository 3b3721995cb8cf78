import pytest

from lodestone.functions.encoding import ANY, Col, literal, python_value, to_any
from lodestone.functions.library import BUILDERS, apply
from lodestone.lang.ast import Op
from lodestone.lang.parser import FUNCTIONS, Parser

CASES = """7/2 => 3 | -7/2 => -3 | 1/0 => None | 2.5*2 => 5.0 | POW(2,62) => 4611686018427387904 | POW(2,63) => None | POW(-3,3) => -27 | POW(2,-1) => None
LOG(8,2) => 3 | LOG(7,2) => 2 | SQRT(17) => 4 | SQRT(-1) => None | REM(-7,3) => -1 | REM(1,0) => None | ROUND(-2.5) => -3.0 | CEIL(2.1) => 3.0 | FLOOR(-2.1) => -3.0
SIN(1) => None | SIN(0.0) => 0.0 | COS(0.0) => 1.0 | TAN(0.0) => 0.0 | MIN(1,2.5) => 1.0 | MAX(3,2) => 3 | LUKA(0.5,0.75) => 0.25 | LUKA(1,1) => None | ABS(-3) => 3
BITAND(6,3) => 2 | BITOR(6,3) => 7 | BITXOR(6,3) => 5 | BITSHL(1,64) => None | BITSHL(1,3) => 8 | BITSHR(-8,1) => -4 | BITSHRU(8,1) => 4 | 9223372036854775807+1 => None | -(3) => -3
CONCAT("a"@en,"b"@en) => ab | STRBEFORE("hello","l") => he | STRAFTER("hello","zz") => | SUBSTR("hello",0,3) => he | SUBSTR("hello",2) => ello | SUBSTR("hello",9) => | STRREV("abc") => cba
REGEX("hello","l+") => True | REGEX("hello","^l") => False | STRLEN("héllo") => 5 | URIENCODE("a b*~") => a%20b%2A~ | URIDECODE("a%20b+") => a b+ | STRLEN("👨‍👩‍👧éx") => 3 | STRREV("éx") => xé | SUBSTR("aéxy",2,2) => éx | STRLEN("🇩🇪🇫🇷") => 2 | UCASE("é") => É | LCASE("É") => é
INT("0x2B") => 43 | INT("0b101001") => 41 | INT(4.2) => None | INT(3.0) => 3 | DOUBLE("4.5") => 4.5 | DOUBLE(true) => None | IRI("a") => a | STR(2.0) => 2 | STR("x"@en) => x | LANG("x"@en) => en
1 = 1.0 => False | 1 = 1 => True | 1 < 1.5 => True | "a" < 1 => None | 1 != "1" => True | isNumeric(1) => True | isInteger(1.0) => False | isIri(a) => True | isString("a"@en) => False
COMPARE("a","b") => -1 | CONTAINS("abc","b") => True | STRSTARTS("abc","ab") => True | STRENDS("abc","ab") => False | LEVENSHTEIN("kitten","sitting") => 3 | STRLANG("a","en") => a
AND(true,false) => False | OR(true,false) => True | NOT(true) => False | AND(true,1) => None | DATATYPE(5) => http://www.w3.org/2001/XMLSchema#int | CONTAINS("a"@en,"a"@de) => None"""


def value(text, mixed):
    def go(x):
        if isinstance(x, Op):
            return apply(x.name, [go(a) for a in x.args])
        c = literal(x)
        return Col(to_any(c), ANY) if mixed else c

    return go(Parser(text).guard())


@pytest.mark.parametrize("mixed", [False, True])
def test_functions(spark, mixed):
    cases = [c.split("=>") for line in CASES.splitlines() for c in line.split(" | ")]
    for at in range(0, len(cases), 12):
        part = cases[at : at + 12]
        row = spark.range(1).select(*[to_any(value(t.strip(), mixed)).alias(f"x{i}") for i, (t, _) in enumerate(part)]).first()
        for i, (text, expected) in enumerate(part):
            got = row[f"x{i}"]
            assert ("None" if got is None else str(python_value(got, ANY).value)) == expected.strip(), text


def test_all_are_built():
    assert len(FUNCTIONS) == 66 and {f.upper() for f in FUNCTIONS} == set(BUILDERS)
