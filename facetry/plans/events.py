"""Metrics over event streams kept as rows: conversion, funnel, retention, cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AGGREGATES, DefinitionError, Metric, Model
from .exact import grouped
from .live import Context, Field, Leaf, Planner, dimension_sql, inline_refs, resolve_names, strip_model
from .text import dotted, lenient, native
from .windows import interval


def plan(ctx: Context, owner: str | None, metric: Metric, fields: list[Field], filters: list[str]) -> DataFrame:
    if owner is None:
        raise DefinitionError(f"metric {metric.name} must belong to a model")
    foreign = [a for f in filters for a, _ in dotted(f) if a in ctx.graph.models and a != owner] + [f.model for f in fields if f.model != owner]
    if foreign and metric.type != "cohort":
        raise DefinitionError(f"metric {metric.name} takes dimensions and filters of {owner} only")
    kinds = {"conversion": funnel if metric.steps else conversion, "retention": retention, "cohort": cohort}
    with lenient(ctx.spark):
        return kinds[metric.type](ctx, ctx.graph.model(owner), metric, fields, filters)


def rows_of(ctx: Context, model: Model, fields: list[Field], filters: list[str], made: dict[str, str]) -> DataFrame:
    """The model's filtered rows as dimensions (by output) and ``made`` columns."""
    planner = Planner(ctx, fields, [])
    leaves = [Leaf(model.name, "max({x})", sql, name) for name, sql in made.items()]
    frame = planner.frame(model.name, set(), leaves, filters, {(f.name, f.grain) for f in fields})
    return frame.select(*[F.col(f.internal).alias(f.output) for f in fields], *[F.col(f"__m{i}").alias(n) for i, n in enumerate(made)])


def event_type(model: Model) -> str:
    """The dimension that names events."""
    for d in model.dimensions:
        if "event" in d.name.lower() and "type" in d.name.lower():
            return d.name
    raise DefinitionError(f"model {model.name} has no dimension named like an event type")


def event_time(model: Model) -> str:
    if model.default_time_dimension:
        return model.default_time_dimension
    for d in model.dimensions:
        if d.type == "time":
            return d.name
    raise DefinitionError(f"model {model.name} has no time dimension")


def test_of(ctx: Context, model: Model, text: str) -> str:
    """An event as a condition: a bare word is a value of the event type, all else is SQL."""
    if text.replace("_", "").replace("-", "").replace(" ", "").isalnum():
        return f"({dimension_sql(ctx, model, event_type(model))}) = '{text}'"
    return resolve_names(ctx, inline_refs(ctx, strip_model(text, model.name), model), model, set(ctx.load(model).columns))


def sql_of(ctx: Context, model: Model, name: str) -> str:
    return dimension_sql(ctx, model, name) if model.dimension(name) else name


def conversion(ctx: Context, model: Model, metric: Metric, fields: list[Field], filters: list[str]) -> DataFrame:
    """Share of base entities with a conversion within the window after a base event.

    Base and conversion events are tagged in one pass and brought together by entity; per
    entity and dimensions only times are compared, so no pair of events is ever a row."""
    time = dimension_sql(ctx, model, event_time(model))
    rows = rows_of(ctx, model, fields, filters, {
        "__entity": sql_of(ctx, model, metric.entity), "__time": f"cast({time} as timestamp)",
        "__base": test_of(ctx, model, metric.base_event), "__conversion": test_of(ctx, model, metric.conversion_event),
    })
    rows = rows.filter("__base OR __conversion")
    dims = [f.output for f in fields]
    n, unit = interval(metric.conversion_window or "7 days")
    # the first conversion at or after each event of the entity: a minimum that grows from the latest event
    # back, which takes one step a row (a frame with unbounded following would take one for each pair)
    following = "min(CASE WHEN __conversion THEN __time END) OVER (PARTITION BY __entity ORDER BY __time DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    marked = rows.withColumn("__next", F.expr(following)).filter("__base")
    done = F.expr(f"__next <= __time + INTERVAL '{n}' {unit.upper()}")
    each = marked.groupBy(*dims, "__entity").agg(F.max(F.coalesce(done, F.lit(False))).alias("__done"))
    share = (F.count(F.when(F.col("__done"), F.col("__entity"))) / F.nullif(F.count("__entity"), F.lit(0))).cast("double")
    return each.groupBy(*dims).agg(share.alias(metric.name))


def funnel(ctx: Context, model: Model, metric: Metric, fields: list[Field], filters: list[str]) -> DataFrame:
    """Entities that pass each step at or after the step before, by earliest times."""
    time = dimension_sql(ctx, model, event_time(model))
    steps = list(metric.steps or [])
    made = {"__entity": sql_of(ctx, model, metric.entity), "__time": f"cast({time} as timestamp)"}
    made |= {f"__is{i}": test_of(ctx, model, s) for i, s in enumerate(steps)}
    rows = rows_of(ctx, model, fields, filters, made)
    rows = rows.filter(F.expr(" OR ".join(f"__is{i}" for i in range(len(steps)))))
    keys = [*(f.output for f in fields), "__entity"]
    # every step's first time at or after the step before, over rows that one shuffle brings together
    over = Window.partitionBy(*keys)
    for i in range(len(steps)):
        due = F.col(f"__is{i}") if i == 0 else F.col(f"__is{i}") & (F.col("__time") >= F.col(f"__at{i - 1}"))
        rows = rows.withColumn(f"__at{i}", F.min(F.when(due, F.col("__time"))).over(over))
    reached = rows.groupBy(*keys).agg(*[F.min(f"__at{i}").alias(f"__at{i}") for i in range(len(steps))])
    counts = [F.count("__at0").alias("total_entities")]
    counts += [F.count(f"__at{i}").alias(f"step_{i + 1}_count") for i in range(len(steps))]
    counts.append(F.count(f"__at{len(steps) - 1}").alias(metric.name))
    return reached.groupBy(*[f.output for f in fields]).agg(*counts)


def retention(ctx: Context, model: Model, metric: Metric, fields: list[Field], filters: list[str]) -> DataFrame:
    """Of each cohort (entities by the period of their first cohort event), the share active so many periods later."""
    grain = metric.retention_granularity
    time = f"cast({dimension_sql(ctx, model, event_time(model))} as timestamp)"
    entity = sql_of(ctx, model, metric.entity)
    made = {"__entity": entity, "__period": f"cast(date_trunc('{grain}', {time}) as date)", "__starts": test_of(ctx, model, metric.cohort_event or "true"), "__active": test_of(ctx, model, metric.activity_event or "true")}
    rows = rows_of(ctx, model, fields, filters, made)
    dims = [f.output for f in fields]
    cohorts = rows.filter("__starts").groupBy(*dims, "__entity").agg(F.min("__period").alias("cohort_date"))
    sizes = cohorts.groupBy(*dims, "cohort_date").agg(F.count("__entity").alias("cohort_size"))
    active = rows.filter("__active").select(*dims, "__entity", "__period").distinct()
    gap = {"day": "datediff(__period, cohort_date)", "week": "cast(datediff(__period, cohort_date) / 7 as int)", "month": "cast(months_between(__period, cohort_date) as int)"}[grain]
    started = cohorts.select(*[F.col(d).alias(f"__c_{d}") for d in dims], F.col("__entity").alias("__who"), "cohort_date")
    condition = F.col("__entity") == F.col("__who")
    for d in dims:
        condition = condition & F.col(d).eqNullSafe(F.col(f"__c_{d}"))
    met = active.join(started, condition).withColumn(f"{grain}s_since" if grain != "day" else "days_since", F.expr(gap))
    since = f"{grain}s_since" if grain != "day" else "days_since"
    met = met.filter((F.col(since) >= 0) & (F.col(since) <= metric.periods))
    kept = met.groupBy(*dims, "cohort_date", since).agg(F.count_distinct("__entity").alias("active_users"))
    named = sizes.select(*[F.col(d).alias(f"__s_{d}") for d in dims], F.col("cohort_date").alias("__s_date"), "cohort_size")
    condition = F.col("cohort_date") == F.col("__s_date")
    for d in dims:
        condition = condition & F.col(d).eqNullSafe(F.col(f"__s_{d}"))
    out = kept.join(named, condition)
    share = F.round(F.col("active_users") * 100.0 / F.nullif(F.col("cohort_size"), F.lit(0)), 1).alias("retention_pct")
    return out.select(*dims, "cohort_date", since, "active_users", "cohort_size", share)


def cohort(ctx: Context, model: Model, metric: Metric, fields: list[Field], filters: list[str]) -> DataFrame:
    """Two levels: entities by inner metrics under HAVING, then the entities aggregated."""
    extra = [Field(model.name, d, None, d) for d in metric.entity_dimensions or [] if d not in {f.name for f in fields}]
    fields = [*extra, *fields]
    inner = [Metric.of(m) if isinstance(m, dict) else m for m in metric.inner_metrics or []]
    made = {"__entity": sql_of(ctx, model, metric.entity)}
    for i, m in enumerate(inner):
        raw = m.sql or ("1" if m.agg == "count" else m.name)
        made[f"__x{i}"] = f"CASE WHEN {' AND '.join(f'({strip_model(f, model.name)})' for f in m.filters)} THEN {raw} END" if m.filters else raw
    rows = rows_of(ctx, model, fields, filters, made)
    dims = [f.output for f in fields]
    aggs = [F.expr(native(AGGREGATES[m.agg or "sum"]).replace("{x}", f"`__x{i}`")).alias(m.name) for i, m in enumerate(inner)]
    entities = rows.groupBy(*dims, "__entity").agg(*aggs) if aggs else rows.select(*dims, "__entity").distinct()
    if metric.having:
        entities = entities.filter(metric.having)
    agg = metric.agg or "count"
    x = metric.sql or ("`__entity`" if agg in ("count", "count_distinct") else f"`{inner[0].name}`")
    text = AGGREGATES[agg].replace("{x}", x)
    return grouped(entities, dims, [(text, metric.name, F.expr(text))])
