"""A small functional surface: load a program, reason, read, write and explain its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .analysis import checks
from .engine import Engine
from .lang.ast import Program
from .lang.parser import parse
from .lang.values import Value


def load_string(text: str, params: dict | None = None) -> Program:
    """A checked program; raises RuleError where the text isn't a valid one."""
    return checks.validate(checks.resolve_parameters(parse(text), params))


def load_file(path: str, params: dict | None = None) -> Program:
    with open(path, encoding="utf-8") as f:
        return load_string(f.read(), params)


def output_predicates(program: Program) -> list[str]:
    return checks.outputs(program)


class Reasoner:
    """An engine over one program."""

    def __init__(self, spark: SparkSession, program: Program, base_dir: str = ".", tables: dict[str, DataFrame] | None = None, tracing: bool = True):
        self.engine = Engine(spark, base_dir, tracing=tracing)
        self.engine.program = program
        for name, df in (tables or {}).items():
            self.engine.register(name, df)

    def reason(self) -> Reasoner:
        self.engine.run()
        return self

    def result(self, pred: str) -> list[list]:
        return self.engine.result(pred)

    def rows(self, pred: str) -> list[tuple[Value, ...]]:
        return list(self.engine.rows(pred))

    def dataframe(self, pred: str, columns: list[str] | None = None) -> DataFrame:
        return self.engine.relation(pred, columns)

    def write_result(self, pred: str, path: str, delimiter: str = ",") -> str:
        from .sources.export import write_table

        return write_table(self.engine, pred, path, delimiter)

    def trace(self, fact: str):
        return self.engine.trace(fact)

    def timing(self) -> dict[str, float]:
        """Seconds by group of predicates."""
        return {name: seconds for name, seconds, _ in self.engine.timings}
