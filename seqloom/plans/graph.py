"""Operators as named SQL over named relations.

An operator is one statement whose inputs, other operators or the canonical
relations, stand in braces.  `Graph.frame` binds them to DataFrames (the plan
stays one lazy Catalyst tree); `Graph.duckdb` writes the same graph as common
table expressions for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import bucketed, collect, materialize, materialize_tidily
from ..sources.tables import read_table
from .dialect import DUCKDB, SPARK, expand

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
INPUT = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Operator:
    """sql: for both engines, or for Spark only where `oracle` gives DuckDB's text.
    row: the result is one row by definition (cutoffs, thresholds); it is computed once
    and enters further plans as a literal relation.
    function, takes: a DataFrame function of the named inputs instead of SQL.
    instead: SQL by the name of a relation, used where that relation is given; for operators
    whose own SQL gets the same result from something nearer to the tables.
    beside: SQL with the same result by the name of an operator, used where a plan needs that one anyway.
    tidy: plans that need it are many; the driver's garbage is collected after each statement and written table."""

    sql: str = ""
    oracle: str | None = None
    row: bool = False
    function: Callable[..., DataFrame] | None = None
    takes: tuple[str, ...] = ()
    instead: tuple[tuple[str, str], ...] = ()
    beside: tuple[tuple[str, str], ...] = ()
    tidy: bool = False


class Graph:
    """keep: operators that are written to the shared folder where a plan needs them more
    than once (Spark has no common table expressions that are computed once).
    buckets: operators that are always written, in buckets of these keys, so that an
    equi-join on the keys reads them without a shuffle.
    columns_of: operators that only select from another one, and aren't written where that one is."""

    def __init__(self, operators: Mapping[str, Operator | str], keep: frozenset[str] = frozenset(), buckets: Mapping[str, tuple[str, ...]] | None = None, columns_of: Mapping[str, str] | None = None):
        self.keep, self.buckets, self.columns_of = keep, dict(buckets or {}), dict(columns_of or {})
        self.operators = {k: o if isinstance(o, Operator) else Operator(o) for k, o in operators.items()}

    def with_given(self, given: Mapping[str, DataFrame]) -> Graph:
        """This graph, with the SQL that operators have for given relations."""
        changed = {k: Operator(sql) for k, o in self.operators.items() for name, sql in o.instead if name in given}
        return Graph(self.operators | changed, self.keep, self.buckets, self.columns_of) if changed else self

    def needed(self, name: str, given: Mapping[str, DataFrame]) -> dict[str, int]:
        """How often a plan names each relation that it needs; relations that are given need nothing."""
        uses: dict[str, int] = {}

        def count(node: str) -> None:
            for x in self.inputs(node):
                seen = x in uses
                # a function counts its inputs before it reads them
                times = 2 if self.operators[node].function else len(re.findall(rf"\{{{x}\}}", self.operators[node].sql))
                uses[x] = uses.get(x, 0) + max(1, times)
                if not seen and x in self.operators and x not in given:
                    count(x)

        if name in self.operators:
            count(name)
        return uses

    def with_neighbors(self, name: str, given: Mapping[str, DataFrame]) -> Graph:
        """This graph, with the SQL that operators have beside others that the plan needs and that aren't given."""
        uses = self.needed(name, given)
        changed = {k: Operator(sql) for k in uses if k in self.operators and k not in given for x, sql in self.operators[k].beside if x in uses and x not in given}
        return Graph(self.operators | changed, self.keep, self.buckets, self.columns_of) if changed else self

    def inputs(self, name: str, oracle: bool = False) -> list[str]:
        op = self.operators[name]
        if op.function and not oracle:
            return list(op.takes)
        return list(dict.fromkeys(INPUT.findall(op.oracle if oracle and op.oracle else op.sql)))

    def frame(self, spark: SparkSession, name: str, root: str | None = None, **given: DataFrame) -> DataFrame:
        """The operator's result over the tables under root; relations in `given` replace
        the ones of that name, so any operator applies to any DataFrame."""
        return self.with_given(given).with_neighbors(name, given)._frame(spark, name, root, given)

    def _frame(self, spark: SparkSession, name: str, root: str | None, given: Mapping[str, DataFrame]) -> DataFrame:
        done: dict[str, DataFrame] = dict(given)
        uses = self.needed(name, given)
        kept = lambda x: x in self.keep and uses.get(x, 0) > 1
        covered = lambda x: kept(x) and x not in given

        tidy = any(self.operators[x].tidy for x in (name, *uses) if x in self.operators and x not in given)
        write = materialize_tidily if tidy else materialize

        def build(node: str) -> DataFrame:
            if node not in done:
                if node in self.operators:
                    op = self.operators[node]
                    frames = {x: build(x) for x in self.inputs(node)}
                    df = op.function(**frames) if op.function else spark.sql(expand(op.sql, SPARK), **frames)
                    if op.row:
                        df = spark.createDataFrame(df.limit(2).collect(), df.schema)
                    elif node in self.buckets and node != name:
                        df = bucketed(df, node, self.buckets[node])
                    elif kept(node) and not covered(self.columns_of.get(node)):
                        df = write(df, node)
                    done[node] = df
                    if tidy:  # analysing a statement over all that it stands on leaves garbage, too
                        collect(spark)
                elif root is None or node not in TABLES:
                    raise KeyError(f"{node} is neither an operator nor given")
                else:
                    done[node] = read_table(spark, root, node)
            return done[node]

        return build(name)

    def duckdb(self, name: str) -> str:
        order: list[str] = []

        def visit(node: str) -> None:
            if node in self.operators and node not in order:
                for x in self.inputs(node, oracle=True):
                    visit(x)
                order.append(node)

        visit(name)
        text = lambda op: INPUT.sub(lambda m: m[1] if m[1] in TABLES else f"n_{m[1]}", expand(op.oracle or op.sql, DUCKDB))
        parts = [f"n_{x} as ({text(self.operators[x]).strip()})" for x in order]
        return "with " + ",\n".join(parts) + f"\nselect * from n_{name}"

    def query(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return self.frame(spark, name, sf_dir)

        run.__name__ = name
        return run
