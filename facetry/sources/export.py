"""Definitions of a layer as YAML of other tools. What the other format can't say raises."""

from __future__ import annotations

import re

import yaml

from ..model import DefinitionError, Metric, Model

CUBE_AGGS = {"count": "count", "sum": "sum", "avg": "avg", "min": "min", "max": "max", "count_distinct": "count_distinct", "approx_count_distinct": "count_distinct_approx"}
FLOW_AGGS = {"count": "count", "sum": "sum", "avg": "average", "min": "min", "max": "max", "count_distinct": "count_distinct", "median": "median", "sum_boolean": "sum_boolean", "percentile": "percentile"}


def _kept(x: dict) -> dict:
    return {k: v for k, v in x.items() if v not in (None, [], {})}


def _names(keys: str | list[str] | None) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def cube(layer) -> str:
    """Cube YAML of all models."""
    own = lambda s: s.replace("{model}.", "{CUBE}.") if s else s

    def measure(model: Model, m: Metric) -> dict:
        filters = [{"sql": own(f)} for f in m.filters or []]
        if m.type is None and m.agg in CUBE_AGGS:
            return _kept({"name": m.name, "type": CUBE_AGGS[m.agg], "sql": own(m.sql if m.sql or m.agg == "count" else m.name), "filters": filters, "description": m.description})
        names = {x.name for x in model.metrics}
        linked = lambda s: re.sub(r"(?<![\w.{])(\w+)(?![\w(}])", lambda w: f"{{{w[1]}}}" if w[1] in names else w[0], s)
        if m.type == "ratio" and not m.offset_window and {m.numerator, m.denominator} <= names:
            return {"name": m.name, "type": "number", "sql": f"1.0 * {{{m.numerator}}} / NULLIF({{{m.denominator}}}, 0)"}
        if (m.type == "derived" or (m.type is None and m.agg is None)) and not filters:
            return _kept({"name": m.name, "type": "number", "sql": linked(own(m.sql)), "description": m.description})
        base = m.type == "cumulative" and not m.grain_to_date and next((x for x in model.metrics if x.name == m.sql), None)
        if base and base.agg in CUBE_AGGS and base.type is None:
            return _kept({"name": m.name, "type": CUBE_AGGS[base.agg], "sql": own(base.sql), "filters": [{"sql": own(f)} for f in base.filters or []], "rolling_window": {"trailing": m.window or "unbounded"}})
        raise DefinitionError(f"{model.name}.{m.name} can't be expressed in Cube")

    cubes = []
    for model in layer.graph.models.values():
        joins = []
        for r in model.relationships:
            if r.type not in ("many_to_one", "one_to_many", "one_to_one"):
                raise DefinitionError(f"the {r.type} relationship of {model.name} to {r.name} can't be expressed in Cube")
            if r.sql:
                sql = re.sub(r"\{from\}\.", "{CUBE}.", re.sub(r"\{to\}\.", f"{{{r.name}}}.", r.sql))
            else:
                other = layer.graph.models[r.name] if r.name in layer.graph.models else None
                fk, pk = _names(r.foreign_key), _names(r.primary_key)
                if r.type == "one_to_many":
                    here, there = pk or model.key, fk or [f"{model.name}_id"]
                else:
                    here, there = fk or [f"{r.name}_id"], pk or (other.key if other else ["id"])
                sql = " AND ".join(f"{{CUBE}}.{a} = {{{r.name}}}.{b}" for a, b in zip(here, there))
            joins.append({"name": r.name, "relationship": r.type, "sql": sql})
        types = {"categorical": "string", "numeric": "number", "time": "time", "boolean": "boolean"}
        dimensions = [_kept({"name": d.name, "type": types[d.type], "sql": own(d.sql) or d.name, "primary_key": True if d.name in model.key else None, "public": None if d.public else False, "description": d.description}) for d in model.dimensions]
        dimensions += [{"name": k, "type": "string", "sql": k, "primary_key": True, "public": False} for k in model.key if not model.dimension(k)]
        rollups = [_kept({"name": p.name, "type": p.type, "measures": p.measures, "dimensions": p.dimensions, "time_dimension": p.time_dimension, "granularity": p.granularity, "partition_granularity": p.partition_granularity}) for p in model.pre_aggregations]
        cubes.append(_kept({
            "name": model.name, "sql_table": model.table, "sql": model.sql, "description": model.description, "joins": joins, "dimensions": dimensions,
            "measures": [measure(model, m) for m in model.metrics], "segments": [{"name": s.name, "sql": own(s.sql)} for s in model.segments], "pre_aggregations": rollups,
        }))
    return yaml.safe_dump({"cubes": cubes}, sort_keys=False)


def metricflow(layer) -> str:
    """MetricFlow semantic models, and a metric for each measure and formula."""
    models, metrics = [], []
    own = lambda s: s.replace("{model}.", "") if s else s
    for model in layer.graph.models.values():
        if not model.table:
            raise DefinitionError(f"model {model.name} isn't a table and can't be expressed in MetricFlow")
        entities = [{"name": model.name, "type": "primary", "expr": model.key[0]}] if len(model.key) == 1 else []
        for r in model.relationships:
            if r.type != "many_to_one" or r.sql or len(_names(r.foreign_key)) > 1:
                raise DefinitionError(f"the relationship of {model.name} to {r.name} can't be expressed in MetricFlow")
            entities.append({"name": r.name, "type": "foreign", "expr": _names(r.foreign_key)[0] if r.foreign_key else f"{r.name}_id"})
        measures = []
        for m in model.metrics:
            if m.type is None and m.agg in FLOW_AGGS and not m.filters and not m.distinct_key:
                semi = _kept({"name": m.non_additive_dimension, "window_choice": m.non_additive_choice if m.non_additive_dimension else None, "window_groupings": m.non_additive_groupings})
                measures.append(_kept({"name": m.name, "agg": FLOW_AGGS[m.agg], "expr": own(m.sql) or ("1" if m.agg == "count" else m.name), "non_additive_dimension": semi, "agg_params": {"percentile": m.percentile} if m.percentile is not None else None}))
                metrics.append({"name": m.name, "type": "simple", "type_params": {"measure": m.name}})
            elif m.type == "ratio" and not m.offset_window:
                metrics.append({"name": m.name, "type": "ratio", "type_params": {"numerator": m.numerator, "denominator": m.denominator}})
            elif m.type == "derived":
                used = sorted({n for n in re.findall(r"[A-Za-z_]\w*", m.sql) if model.metric(n)})
                metrics.append({"name": m.name, "type": "derived", "type_params": {"expr": own(m.sql), "metrics": [{"name": n} for n in used]}})
            elif m.type == "cumulative" and m.sql and model.metric(m.sql):
                metrics.append({"name": m.name, "type": "cumulative", "type_params": _kept({"measure": m.sql, "window": m.window, "grain_to_date": m.grain_to_date})})
            else:
                raise DefinitionError(f"{model.name}.{m.name} can't be expressed in MetricFlow")
        times = [d for d in model.dimensions if d.type == "time"]
        dimensions = [_kept({"name": d.name, "type": "time" if d.type == "time" else "categorical", "expr": own(d.sql), "type_params": {"time_granularity": d.granularity or "day"} if d.type == "time" else None}) for d in model.dimensions]
        default = model.default_time_dimension
        if times and not default:  # a default would become a dimension of every query
            for x in measures:
                x["agg_time_dimension"] = times[0].name
        models.append(_kept({"name": model.name, "model": model.table, "description": model.description, "defaults": {"agg_time_dimension": default} if default else None, "entities": entities, "dimensions": dimensions, "measures": measures}))
    for m in layer.graph.metrics.values():
        if m.type == "ratio":
            metrics.append({"name": m.name, "type": "ratio", "type_params": {"numerator": m.numerator.split(".")[-1], "denominator": m.denominator.split(".")[-1]}})
        elif m.type == "derived":
            sql = re.sub(r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)", r"\1", m.sql)
            metrics.append({"name": m.name, "type": "derived", "type_params": {"expr": sql}})
        else:
            raise DefinitionError(f"{m.name} can't be expressed in MetricFlow")
    return yaml.safe_dump(_kept({"semantic_models": models, "metrics": metrics}), sort_keys=False)
