"""Cumulative metrics, period comparisons and ratios to an earlier period.

They run over the aggregated result, so a window without PARTITION BY orders as many
rows as the result has groups, never the base rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AGGREGATES, DefinitionError, Metric
from .live import Compiler, Context, Field

#: Fixed: months, or days, that a comparison looks back.
LOOK_BACK = {"yoy": ("month", 12), "qoq": ("month", 3), "mom": ("month", 1), "wow": ("day", 7), "dod": ("day", 1)}


def needs(metric: Metric) -> bool:
    return metric.type in ("cumulative", "time_comparison") or bool(metric.offset_window) or bool(metric.window_expression)


@dataclass
class Asked:
    metric: Metric
    output: str
    base: str | None
    bottom: str | None = None


class Windows:
    def __init__(self, ctx: Context, compiler: Compiler, fields: list[Field]):
        self.ctx, self.compiler, self.fields, self.asked = ctx, compiler, fields, []

    def ask(self, owner: str | None, metric: Metric, output: str, outputs: list[tuple[str, str]]) -> None:
        """Note a window metric; the metrics it stands on become outputs, too."""

        def base(ref: str | None) -> str | None:
            if ref is None:
                return None
            name = ref.split(".")[-1]
            if name not in {o for o, _ in outputs}:
                outputs.append((name, self.compiler.reference(owner, ref, (output,))))
            return name

        if metric.offset_window:
            self.asked.append(Asked(metric, output, base(metric.numerator), base(metric.denominator)))
        elif metric.window_expression:
            self.asked.append(Asked(metric, output, None))
            for name in re.findall(r"[A-Za-z_]\w*", metric.window_expression):
                if self.ctx.graph.find_metric(f"{owner}.{name}") or name in self.ctx.graph.metrics:
                    base(name)
        elif metric.type == "time_comparison":
            self.asked.append(Asked(metric, output, base(metric.base_metric)))
        else:
            ref = metric.sql or metric.base_metric
            found = ref and (self.ctx.graph.find_metric(f"{owner}.{ref}") or self.ctx.graph.find_metric(ref))
            if found:
                self.asked.append(Asked(metric, output, base(ref)))
            else:  # a measure of its own under the window
                inner = Metric(name=f"{metric.name}_base", agg=metric.agg or "sum", sql=metric.sql, filters=metric.filters)
                outputs.append((inner.name, self.compiler.metric(owner, inner)))
                self.asked.append(Asked(metric, output, inner.name))

    def time(self) -> Field:
        for f in self.fields:
            dimension = self.ctx.graph.model(f.model).dimension(f.name)
            if f.grain or (dimension and dimension.type == "time"):
                return f
        raise DefinitionError("window metrics need a time dimension in the query")

    def apply(self, df: DataFrame) -> DataFrame:
        made = []
        for asked in self.asked:
            m = asked.metric
            if m.window_expression:
                made.append(F.expr(self.raw(m)).alias(asked.output))
            elif m.offset_window:
                earlier = self.earlier(asked.bottom, *interval(m.offset_window))
                made.append(F.expr(f"`{asked.base}` / nullif({earlier}, 0)").alias(asked.output))
            elif m.type == "time_comparison":
                made.append(F.expr(self.compared(asked)).alias(asked.output))
            else:
                made.append(F.expr(self.running(asked)).alias(asked.output))
        return df.select("*", *made)

    def raw(self, m: Metric) -> str:
        if " over " in f" {m.window_expression.lower()} ":
            return m.window_expression
        order = m.window_order or f"`{self.time().output}`"
        return f"{m.window_expression} OVER (ORDER BY {order}{' ' + m.window_frame if m.window_frame else ''})"

    def others(self) -> list[str]:
        return [f"`{f.output}`" for f in self.fields if f is not self.time()]

    def running(self, asked: Asked) -> str:
        m, time = asked.metric, f"`{self.time().output}`"
        # other dimensions don't part a running total unless the metric asks for it
        parts = self.others() if m.partition else []
        if m.grain_to_date:
            parts = [f"date_trunc('{m.grain_to_date}', {time})", *parts]
        frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        if m.window and not m.grain_to_date:
            n, unit = interval(m.window)
            frame = f"RANGE BETWEEN INTERVAL '{n}' {unit.upper()} PRECEDING AND CURRENT ROW"
        if m.window_frame:
            frame = m.window_frame
        by = f"PARTITION BY {', '.join(parts)} " if parts else ""
        over = f"OVER ({by}ORDER BY {m.window_order or time} {frame})"
        if m.agg == "count_distinct":
            return f"size(collect_set(`{asked.base}`) {over})"
        agg = "sum({x})" if m.agg is None else AGGREGATES.get(m.agg, "")
        if not re.fullmatch(r"\w+\(\{x\}\)", agg) or m.agg in ("count_distinct", "product", "entropy", "mode"):
            raise DefinitionError(f"metric {m.name}: {m.agg} can't run over a window")
        return f"{agg.replace('{x}', f'`{asked.base}`')} {over}"

    def earlier(self, base: str, n: int, unit: str) -> str:
        """The value exactly so long before, by the calendar; NULL where there is no such row."""
        by = f"PARTITION BY {', '.join(self.others())} " if self.others() else ""
        time = f"`{self.time().output}`"
        back = f"INTERVAL '{n}' {unit.upper()}"
        return f"max(`{base}`) OVER ({by}ORDER BY {time} RANGE BETWEEN {back} PRECEDING AND {back} PRECEDING)"

    def compared(self, asked: Asked) -> str:
        m, base = asked.metric, f"`{asked.base}`"
        kind = m.comparison_type or "prior_period"
        if m.time_offset:
            n, unit = interval(m.time_offset)
        elif kind == "prior_period":
            grain = self.time().grain or "day"
            n, unit = {"quarter": (3, "month"), "week": (7, "day")}.get(grain, (1, grain))
        elif kind in LOOK_BACK:
            unit, n = LOOK_BACK[kind]
        else:
            raise DefinitionError(f"metric {m.name}: unknown comparison {kind}")
        earlier = self.earlier(asked.base, n, unit)
        how = m.calculation or "percent_change"
        if how == "difference":
            return f"{base} - {earlier}"
        if how == "ratio":
            return f"{base} / nullif({earlier}, 0)"
        return f"({base} - {earlier}) / nullif({earlier}, 0) * 100"


def interval(text: str) -> tuple[int, str]:
    """``7 days`` -> (7, day); weeks and quarters in units that Spark's frames take."""
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week|month|quarter|year)s?\s*", text, re.IGNORECASE)
    if not m:
        raise DefinitionError(f"{text!r} is no interval")
    n, unit = int(m[1]), m[2].lower()
    return {"week": (7 * n, "day"), "quarter": (3 * n, "month"), "year": (12 * n, "month")}.get(unit, (n, unit))
