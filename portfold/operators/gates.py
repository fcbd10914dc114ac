"""Gates: bounds on what a table holds, measured while it is written."""

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Bound = int | float | Decimal | str | dt.date | None


class GateError(ValueError):
    """A table broke a gate; ``found`` has all measured values."""

    def __init__(self, problems: list[str], found: dict[str, object]) -> None:
        super().__init__("; ".join(problems))
        self.problems, self.found = problems, found


@dataclass(frozen=True)
class Gate:
    """An aggregate over the whole table, and the least and greatest value that it may have. Null breaks any bound."""

    name: str
    value: Column
    least: Bound = None
    greatest: Bound = None

    def problem(self, found: object) -> str | None:
        if self.least is None and self.greatest is None:
            return None
        if found is None or (self.least is not None and found < self.least) or (self.greatest is not None and found > self.greatest):
            return f"{self.name} is {found}, not between {self.least} and {self.greatest}"
        return None


def observed(df: DataFrame, gates: list[Gate]) -> tuple[DataFrame, Observation]:
    """``df``, whose next full evaluation measures the gates on the way: no second scan."""
    observation = Observation()
    return df.observe(observation, *[gate.value.alias(gate.name) for gate in gates]), observation


def check(gates: list[Gate], found: dict[str, object]) -> dict[str, object]:
    """The measured values, if all gates hold; else ``GateError``."""
    problems = [p for p in (gate.problem(found.get(gate.name)) for gate in gates) if p]
    if problems:
        raise GateError(problems, found)
    return found


def share(condition: Column) -> Column:
    """The share of rows for which the condition is true; null without rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def snapshot_gates(
    *, least_rows: int = 1, newest: dt.date | None = None, worth: Decimal | None = None, change: float = 0.5, unpriced: float = 0.05,
) -> list[Gate]:
    """The checklist of a monthly run.

    There are rows; the newest date is not before ``newest``; at most the share ``unpriced`` of lines has no value; no line is worth
    less than nothing; the value from ``newest`` on is within the share ``change`` of ``worth``, that of the run before.
    """
    value, day = F.col("market_value"), F.col("as_of_date")
    gates = [
        Gate("rows", F.count(F.lit(1)), least=least_rows), Gate("newest", F.max(day), least=newest),
        Gate("unpriced", share(value.isNull()), greatest=unpriced), Gate("negative", F.count(F.when(value < 0, 1)), greatest=0),
    ]
    if worth is not None and newest is not None:
        now = F.sum(F.when(day >= F.lit(newest), value))
        gates.append(Gate("worth", now, least=worth * (1 - Decimal(str(change))), greatest=worth * (1 + Decimal(str(change)))))
    return gates
