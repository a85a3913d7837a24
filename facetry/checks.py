"""Golden queries and validation: pinned results, and definitions against the live schema."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.errors import AnalysisException

from .model import DefinitionError
from .plans.live import Compiler, Context, dimension_sql, resolve_names
from .plans.text import lenient


@dataclass
class Outcome:
    name: str
    passed: bool
    message: str = ""


def _same(a: Any, b: Any, tolerance: float) -> bool:
    try:
        return abs(float(a) - float(b)) <= tolerance if not isinstance(a, bool) and a is not None and b is not None else a == b
    except (TypeError, ValueError):
        return str(a) == str(b)


def run_golden(layer, path: str) -> list[Outcome]:
    """Outcomes of the ``tests`` of a YAML file or a folder of them. A test has a name, ``sql`` or
    ``query`` and ``expect`` with value, rows, row_count, columns or tolerance."""
    where = Path(path)
    files = sorted(where.rglob("*.y*ml")) if where.is_dir() else [where]
    return [run_one(layer, t) for f in files for t in (yaml.safe_load(f.read_text()) or {}).get("tests", [])]


def run_one(layer, test: dict) -> Outcome:
    name, expect = test.get("name", "unnamed"), test.get("expect", {})
    tolerance = float(expect.get("tolerance", 1e-9))
    try:
        df = layer.sql(test["sql"]) if "sql" in test else layer.query(**test["query"])
        if "columns" in expect and df.columns != list(expect["columns"]):
            return Outcome(name, False, f"columns are {df.columns}")
        if "row_count" in expect and (n := df.count()) != expect["row_count"]:
            return Outcome(name, False, f"{n} rows")
        if "value" in expect:
            rows = df.limit(2).collect()
            if len(rows) != 1 or len(rows[0]) != 1 or not _same(rows[0][0], expect["value"], tolerance):
                return Outcome(name, False, f"got {[tuple(r) for r in rows]}")
        if "rows" in expect:
            rows = [tuple(r) for r in df.limit(len(expect["rows"]) + 1).collect()]
            if len(rows) != len(expect["rows"]) or not all(len(a) == len(b) and all(_same(x, y, tolerance) for x, y in zip(a, b)) for a, b in zip(rows, expect["rows"])):
                return Outcome(name, False, f"got {rows}")
    except (DefinitionError, PermissionError, AnalysisException) as error:
        return Outcome(name, False, f"{type(error).__name__}: {str(error).splitlines()[0]}")
    return Outcome(name, True)


def validate(layer) -> list[str]:
    """What is wrong with a layer's definitions, read against the schemas of its sources; nothing is run."""
    wrong: list[str] = []
    ctx = Context(layer.spark, layer.graph, secure=False)
    for model in layer.graph.models.values():
        try:
            frame = ctx.load(model)
        except AnalysisException as error:
            wrong.append(f"{model.name}: its source can't be read ({str(error).splitlines()[0]})")
            continue
        columns = set(frame.columns)
        wrong += [f"{model.name}: primary key {k} is no column" for k in model.key if k not in columns]
        for r in model.relationships:
            if r.name not in layer.graph.models:
                wrong.append(f"{model.name}: relationship to the unknown model {r.name}")
        with lenient(layer.spark):
            for d in model.dimensions:
                try:
                    frame.selectExpr(resolve_names(ctx, dimension_sql(ctx, model, d.name), model, columns))
                except AnalysisException as error:
                    wrong.append(f"{model.name}.{d.name}: {str(error).splitlines()[0]}")
            for m in model.metrics:
                if m.agg and m.sql:
                    try:
                        frame.selectExpr(resolve_names(ctx, m.sql, model, columns))
                    except AnalysisException as error:
                        wrong.append(f"{model.name}.{m.name}: {str(error).splitlines()[0]}")
                elif m.type in (None, "derived", "ratio") and not m.agg:
                    try:
                        Compiler(ctx).metric(model.name, m)
                    except DefinitionError as error:
                        wrong.append(f"{model.name}.{m.name}: {error}")
    for m in layer.graph.metrics.values():
        try:
            Compiler(ctx).metric(None, m)
        except DefinitionError as error:
            wrong.append(f"{m.name}: {error}")
    return wrong
