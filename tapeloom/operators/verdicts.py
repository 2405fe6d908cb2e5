"""Verdicts as a table of rules over one row of named measures.

A rule has an id, ordered branches (decision, conditions that must all hold) and a decision for the rest;
a condition is (measure, comparison, limit), so alternatives are branches of the same decision.  A measure
that is null meets no condition.  The same table gives the Spark columns and the SQL text.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    id: str
    wording: str
    branches: tuple[tuple[str, tuple[Condition, ...]], ...] = ()
    otherwise: str = "weak"
    evidence: tuple[str, ...] = ()  # measures reported beside those of the conditions

    def measures(self) -> list[str]:
        named = [m for _, conditions in self.branches for m, _, _ in conditions]
        return list(dict.fromkeys([*named, *self.evidence]))

    def decision(self) -> Column:
        out = F.lit(self.otherwise)
        for name, conditions in reversed(self.branches):
            holds = F.lit(True)
            for measure, compare, limit in conditions:
                holds = holds & F.coalesce(_COMPARE[compare](F.col(measure), F.lit(float(limit))), F.lit(False))
            out = F.when(holds, name).otherwise(out)
        return out

    def decision_sql(self) -> str:
        parts = [f"when {' and '.join(f'{m} {c} {float(x)!r}e0' for m, c, x in conditions) or 'true'} then '{name}'" for name, conditions in self.branches]
        return f"case {' '.join(parts)} else '{self.otherwise}' end" if parts else f"'{self.otherwise}'"


def one_row(measures: DataFrame, names: Sequence[str]) -> DataFrame:
    """(measure, value) rows as one row with a column for each name; a measure without a row is null."""
    return measures.agg(*[F.max(F.when(F.col("measure") == n, F.col("value"))).alias(n) for n in names])


def evaluate(row: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """id, decision, wording, measure, value: a row for each measure that a rule looks at."""
    cells = [
        F.struct(F.lit(r.id).alias("id"), r.decision().alias("decision"), F.lit(r.wording).alias("wording"), F.lit(m).alias("measure"), F.col(m).alias("value"))
        for r in rules for m in r.measures()
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def evaluate_sql(rules: Sequence[Rule], source: str) -> str:
    """The same rows in SQL; ``source`` is a one-row frame with a column for each measure."""
    return " union all ".join(
        f"select '{r.id}' as id, {r.decision_sql()} as decision, '{r.wording}' as wording, '{m}' as measure, {m} as value from {source}"
        for r in rules for m in r.measures()
    )
