"""Calculations over the rows of a finished result.

A result has no order of its own in Spark, so calculations that follow rows take
``order_by``. They run over aggregated rows; without ``partition_by`` those are ordered
in one task, as many as the result has."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DefinitionError
from ..plans.text import lenient


@dataclass
class TableCalculation:
    name: str
    type: str
    field: str | None = None
    expression: str | None = None
    partition_by: list[str] = dataclasses.field(default_factory=list)
    order_by: list[str] = dataclasses.field(default_factory=list)
    window_size: int = 1
    percentile: float = 0.5


ORDERED = ("percent_of_previous", "running_total", "row_number", "moving_average", "lag", "lead", "difference")
TYPES = ("formula", "percent_of_total", "percent_of_column_total", "rank", "dense_rank", "percentile", *ORDERED)


def _order(names: list[str]) -> list[Column]:
    out = []
    for text in names:
        name, _, way = text.partition(" ")
        out.append(F.col(f"`{name}`").desc_nulls_last() if way.strip().lower() == "desc" else F.col(f"`{name}`").asc_nulls_last())
    return out


def _column(calc: TableCalculation) -> Column:
    if calc.type not in TYPES:
        raise DefinitionError(f"unknown table calculation {calc.type}")
    if calc.type in ORDERED and not calc.order_by:
        raise DefinitionError(f"{calc.name}: {calc.type} needs order_by")
    if calc.type == "formula":
        # ${x}: a missing value counts as 0; what can't be evaluated is NULL
        return F.expr(re.sub(r"\$\{(\w+)\}", r"coalesce(`\1`, 0)", calc.expression or ""))
    x = F.col(f"`{calc.field}`") if calc.field else F.lit(1)
    whole = Window.partitionBy(*calc.partition_by)
    ordered = whole.orderBy(*_order(calc.order_by))
    if calc.type in ("percent_of_total", "percent_of_column_total"):
        total = F.sum(x).over(whole if calc.type == "percent_of_column_total" else Window.partitionBy())
        return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0)) / total * 100)
    if calc.type == "percent_of_previous":
        before = F.lag(x).over(ordered)
        return (x - before) / F.nullif(before, F.lit(0)) * 100
    if calc.type == "running_total":
        return F.sum(F.coalesce(x, F.lit(0))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    if calc.type in ("rank", "dense_rank"):
        return getattr(F, calc.type)().over(whole.orderBy(x.desc_nulls_last()))
    if calc.type == "row_number":
        return F.row_number().over(ordered)
    if calc.type == "moving_average":
        return F.avg(F.coalesce(x, F.lit(0))).over(ordered.rowsBetween(-(calc.window_size - 1), 0))
    if calc.type == "percentile":
        return F.percentile(x, F.lit(calc.percentile)).over(Window.partitionBy())
    if calc.type == "difference":
        return x - F.lag(x).over(ordered)
    return getattr(F, calc.type)(x, calc.window_size).over(ordered)


def apply(df: DataFrame, calcs: list[TableCalculation | dict]) -> DataFrame:
    """``df`` with a column for each calculation; later ones see earlier ones."""
    with lenient(df.sparkSession):
        for calc in calcs:
            calc = TableCalculation(**calc) if isinstance(calc, dict) else calc
            df = df.select("*", _column(calc).alias(calc.name))
    return df
