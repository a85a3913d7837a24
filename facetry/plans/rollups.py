"""Materialised roll-ups: build, refresh, match, route, recommend."""

from __future__ import annotations

import copy
import math
import uuid
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DefinitionError, Model, PreAggregation
from .live import Compiler, Context, Field, Leaf, Planner, split_grain
from .text import dotted

#: What a stored measure becomes when it is aggregated again.
AGAIN = {"sum({x})": "sum({x})", "count({x})": "sum({x})", "min({x})": "min({x})", "max({x})": "max({x})", "sum(cast({x} as int))": "sum({x})", "count_if({x})": "sum({x})"}
#: Grains that each grain adds up to; weeks make no months.
COARSER = {
    "second": {"second", "minute", "hour", "day", "week", "month", "quarter", "year"},
    "minute": {"minute", "hour", "day", "week", "month", "quarter", "year"},
    "hour": {"hour", "day", "week", "month", "quarter", "year"},
    "day": {"day", "week", "month", "quarter", "year"},
    "week": {"week"},
    "month": {"month", "quarter", "year"},
    "quarter": {"quarter", "year"},
    "year": {"year"},
}


@dataclass(frozen=True)
class Asked:
    """A query as the recommender sees it."""

    models: tuple[str, ...]
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]


def table_name(model: Model, rollup: PreAggregation) -> str:
    return f"{model.name}_preagg_{rollup.name}"


def stored(layer, model: Model, rollup: PreAggregation) -> tuple[dict[str, Leaf], dict[str, str]]:
    """(stored column -> the leaf that it holds, measure -> why it can't be stored).

    A formula is stored as the leaves it is made of, an average as its sum and its count."""
    found: dict[str, Leaf] = {}
    wrong: dict[str, str] = {}

    def keep(leaf: Leaf, suffix: str = "raw") -> None:
        if leaf.identity in {x.identity for x in found.values()}:
            return
        name, n = f"{leaf.name}_{suffix}", 2
        while name in found:
            name, n = f"{leaf.name}_{suffix}{n}", n + 1
        found[name] = leaf

    for name in rollup.measures:
        metric = model.metric(name.split(".")[-1])
        if metric is None:
            wrong[name] = "there is no such measure"
            continue
        compiler = Compiler(Context(layer.spark, layer.graph, secure=False))
        try:
            compiler.metric(model.name, metric)
        except DefinitionError as e:
            wrong[name] = str(e)
            continue
        bad = next((x for x in compiler.leaves if x.model != model.name or x.raw is None or x.semi or x.distinct_key), None)
        if bad:
            wrong[name] = f"{bad.name} of {bad.model} can't be stored"
            continue
        for leaf in compiler.leaves:
            if leaf.agg == "avg({x})":
                keep(Leaf(leaf.model, "sum({x})", leaf.raw, leaf.name, leaf.filters))
                keep(Leaf(leaf.model, "count({x})", leaf.raw, leaf.name, leaf.filters), "count_raw")
            else:
                keep(leaf)
    return found, wrong


def definition(layer, model: Model, rollup: PreAggregation, since: str | None = None, until: str | None = None) -> DataFrame:
    """The roll-up's rows: time at its grain, dimensions, raw measures."""
    if rollup.type == "original_sql":
        return layer.spark.sql(rollup.sql or model.sql or f"SELECT * FROM {model.table}")
    found, wrong = stored(layer, model, rollup)
    if wrong:
        raise DefinitionError(f"roll-up {rollup.name}: {'; '.join(f'{k}: {v}' for k, v in wrong.items())}")
    ctx = Context(layer.spark, layer.graph, secure=False)
    fields = [Field(model.name, rollup.time_dimension, rollup.granularity, f"{rollup.time_dimension}_{rollup.granularity}")] if rollup.time_dimension else []
    fields += [Field(model.name, d.split(".")[-1], None, d.split(".")[-1]) for d in rollup.dimensions]
    filters = []
    if rollup.time_dimension:
        column = f"{model.name}.{rollup.time_dimension}"
        filters += [f"{column} >= '{since}'"] * bool(since) + [f"{column} < '{until}'"] * bool(until)
    out = Planner(ctx, fields, filters).part(model.name, list(found.values()), list(found))
    return out.select(*[F.col(f.internal).alias(f.output) for f in fields], *found)


MODES = ("full", "incremental", "merge")


def refresh(layer, model_name: str, rollup_name: str, mode: str = "full", lookback: str | None = None) -> str:
    """Build or renew a roll-up; gives the name of its view.

    full: written anew. incremental: buckets from the last stored one (less ``lookback``, as
    '2 days') on are computed again and replace theirs; earlier ones aren't read. merge: buckets
    whose rows differ from what the base rows now give are replaced, so late and withdrawn rows
    count whenever they come; with a ``lookback`` only buckets from there on are compared. Both
    write only what they replace."""
    if mode not in MODES:
        raise DefinitionError(f"unknown refresh mode {mode!r}; there are {', '.join(MODES)}")
    model = layer.graph.model(model_name)
    rollup = next((p for p in model.pre_aggregations if p.name == rollup_name), None)
    if rollup is None:
        raise DefinitionError(f"no roll-up {model_name}.{rollup_name}")
    name, spark = table_name(model, rollup), layer.spark
    if mode == "full" or not spark.catalog.tableExists(name) or not rollup.time_dimension:
        return publish(spark, name, definition(layer, model, rollup, rollup.build_range_start, rollup.build_range_end), rollup)
    time = f"{rollup.time_dimension}_{rollup.granularity}"
    old = spark.table(name)
    if sorted(old.columns) != sorted(definition(layer, model, rollup).columns):  # its measures changed
        return refresh(layer, model_name, rollup_name)
    start = None
    if mode == "incremental" or lookback:
        mark = old.agg(F.max(time)).first()[0]
        if mark is None:
            return refresh(layer, model_name, rollup_name)
        since = f"timestamp'{mark}'" + (f" - INTERVAL '{lookback.split()[0]}' {lookback.split()[1].rstrip('s').upper()}" if lookback else "")
        start = spark.sql(f"SELECT cast(date_trunc('{rollup.granularity}', {since}) as string) AS s").first()[0]
    fresh = definition(layer, model, rollup, start or rollup.build_range_start, rollup.build_range_end)
    if mode == "incremental":
        return publish(spark, name, fresh, rollup, replaces=f"`{time}` >= timestamp'{start}'")
    seen = old.select(*fresh.columns) if start is None else old.select(*fresh.columns).filter(F.col(time) >= F.lit(start).cast("timestamp"))
    # rows that only one side has name the buckets to replace; doubles are compared to 12 digits, as sums in other orders differ
    close = lambda df: df.select(*[F.format_string("%.11e", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    fresh = fresh.persist()
    try:
        apart = close(fresh).exceptAll(close(seen)).select(time).union(close(seen).exceptAll(close(fresh)).select(time)).distinct()
        version = f"{name}__{uuid.uuid4().hex[:12]}"
        apart.write.saveAsTable(f"{version}_buckets")
        if spark.table(f"{version}_buckets").isEmpty():
            spark.sql(f"DROP TABLE {version}_buckets")
            return name
        touched = spark.table(f"{version}_buckets").select(F.col(time).alias("__touched"))
        rows = fresh.join(touched, F.col(time).eqNullSafe(F.col("__touched")), "left_semi")
        return publish(spark, name, rows, rollup, replaces=f"EXISTS (SELECT 1 FROM {version}_buckets b WHERE b.`{time}` <=> o.`{time}`)", version=version)
    finally:
        fresh.unpersist()


#: Layers of a roll-up's view after which its rows are written as one table.
LAYERS = 8


def layers_of(spark, name: str) -> list[str]:
    """The queries that the view ``name`` is the union of."""
    if not spark.catalog.tableExists(name):
        return []
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return [found[f"layer{i}"] for i in range(int(found.get("layers", 0)))]


def publish(spark, name: str, rows: DataFrame, rollup: PreAggregation, replaces: str | None = None, version: str | None = None) -> str:
    """Write rows as a new table, then point the view ``name`` to it: readers see one state or the
    other. With ``replaces`` (a condition on the rows ``o`` of earlier layers) the new table is a
    layer over the earlier ones. Tables of the state before stay for those who still read it."""
    version = version or f"{name}__{uuid.uuid4().hex[:12]}"
    earlier = layers_of(spark, name)
    writer = rows.write
    if rollup.partition_granularity and rollup.time_dimension:
        bucket = F.date_format(F.date_trunc(rollup.partition_granularity, f"{rollup.time_dimension}_{rollup.granularity}"), "yyyy-MM-dd")
        writer = rows.withColumn("_bucket", bucket).write.partitionBy("_bucket")
    writer.saveAsTable(version)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    layers = [f"SELECT {columns} FROM {version}"]
    if replaces:
        layers = [f"SELECT {columns} FROM ({q}) o WHERE NOT coalesce({replaces}, false)" for q in earlier] + layers
    properties = ", ".join(f"'{k}' = '{v}'" for k, v in {"layers": len(layers), **{f"layer{i}": q.replace("\\", "\\\\").replace("'", "\\'") for i, q in enumerate(layers)}}.items())
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({properties}) AS {' UNION ALL '.join(layers)}")
    used = " ".join([*layers, *earlier])
    for t in spark.catalog.listTables(pattern=f"{name}__*"):
        if t.name not in used and not t.name.startswith(version):
            spark.sql(f"DROP TABLE {t.name}")
    if len(layers) > LAYERS:
        return publish(spark, name, spark.table(name), rollup)
    return name


def drop(spark, name: str) -> None:
    """Remove a roll-up and its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for t in spark.catalog.listTables(pattern=f"{name}__*"):
        spark.sql(f"DROP TABLE {t.name}")


def check(layer, model: Model, rollup: PreAggregation, dims: list[Field], leaves: list[Leaf], filters: list[str]) -> list[str]:
    """Why a roll-up can't answer; empty if it can."""
    if rollup.type not in ("rollup", "lambda"):
        return [f"type {rollup.type} isn't routed to"]
    wrong = []
    has = {d.split(".")[-1] for d in rollup.dimensions}
    found, unstored = stored(layer, model, rollup)
    by_identity = {x.identity: n for n, x in found.items()}
    exact = {(f.name, f.grain) for f in dims} == {(d, None) for d in has} | ({(rollup.time_dimension, rollup.granularity)} if rollup.time_dimension else set())
    for f in dims:
        if f.name == rollup.time_dimension and f.grain:
            if f.grain not in COARSER.get(rollup.granularity or "", ()):
                wrong.append(f"grain {f.grain} doesn't follow from {rollup.granularity}")
        elif f.name not in has or f.grain:
            wrong.append(f"dimension {f.column} isn't stored")
    for leaf in leaves:
        if leaf.semi or leaf.distinct_key or leaf.raw is None:
            wrong.append(f"{leaf.name} can't come from a roll-up")
        elif leaf.agg == "avg({x})":
            parts = [Leaf(leaf.model, a, leaf.raw, leaf.name, leaf.filters).identity for a in ("sum({x})", "count({x})")]
            if any(p not in by_identity for p in parts):
                wrong.append(f"average {leaf.name} needs a stored sum and a stored count of the same rows")
        elif leaf.identity not in by_identity:
            why = next((w for m, w in unstored.items() if m.split(".")[-1] == leaf.name), None)
            wrong.append(f"measure {leaf.name} isn't stored" + (f": {why}" if why else ""))
        elif leaf.agg not in AGAIN and not exact:
            wrong.append(f"{leaf.name} can't be aggregated again")
    for text in filters:
        for a, b in dotted(text):
            base, grain = split_grain(layer.graph, a, b) if a in layer.graph.models else (b, None)
            if a == model.name and base not in has and not (base == rollup.time_dimension and grain and grain in COARSER.get(rollup.granularity or "", ())):
                wrong.append(f"filter column {b} isn't stored")
    return wrong


def score(rollup: PreAggregation, dims: list[Field]) -> int:
    asked = {f.name for f in dims}
    has = {d.split(".")[-1] for d in rollup.dimensions} | ({rollup.time_dimension} if rollup.time_dimension else set())
    grain = next((f.grain for f in dims if f.name == rollup.time_dimension), None)
    # fixed values: what an exact match, an unused dimension and the very grain weigh
    return 1000 * (asked == has) - 10 * len(has - asked) + 100 * (grain is not None and grain == rollup.granularity)


def candidates(layer, planner: Planner, leaves: list[Leaf]) -> list[tuple[int, PreAggregation, list[str]]]:
    """Roll-ups of the leaves' model with what speaks against each, best first."""
    model = layer.graph.model(leaves[0].model)
    own = [f for f in planner.dimensions if f.model == model.name]
    keys = [Field(model.name, k, None, k) for h in planner.hops(model.name) if h.left == model.name for k in h.left_keys]
    asked = own + [k for k in keys if k.name not in {f.name for f in own}]
    return sorted(((score(p, asked), p, check(layer, model, p, asked, leaves, planner.filters)) for p in model.pre_aggregations), key=lambda x: -x[0])


def explain(layer, metrics: list[str], dimensions: list[str], filters: list[str] | None = None) -> list[dict]:
    """Each roll-up with its score and the reasons against it."""
    compiler = Compiler(Context(layer.spark, layer.graph))
    for m in metrics:
        compiler.metric(*layer._metric(m))
    planner = Planner(compiler.ctx, layer._fields(dimensions, [], {}), layer._staged(filters or [], [])[0])
    return [{"rollup": p.name, "score": s, "usable": not why, "reasons": why} for s, p, why in candidates(layer, planner, compiler.leaves)]


def route(layer, planner: Planner, leaves: list[Leaf], strict: bool) -> DataFrame | None:
    """The leaves with every model's part from its best roll-up that can answer, other parts from
    base rows; None if no part comes from a roll-up (an error if ``strict`` and any part doesn't).

    A roll-up takes its model's place: its columns carry the names of the model's
    dimensions, so joins to other models, filters and grains work as on base rows."""
    ctx, graph = planner.ctx, layer.graph
    taken: list[bool] = []

    def part(name: str, own: list[Leaf], names: list[str]) -> DataFrame | None:
        model = graph.model(name)
        closed = any(graph.model(m).security and graph.model(m).security.row_filters for m in {name, *(h.right for h in planner.hops(name))})
        fits = []
        if not closed and not planner.multiplies(name):
            fits = [p for _, p, why in candidates(layer, planner, own) if not why and ctx.spark.catalog.tableExists(table_name(model, p))]
        taken.append(bool(fits))
        return from_rollup(layer, planner, model, fits[0], own, names) if fits else None

    out = planner.aggregate(leaves, instead=part)
    if strict and not all(taken):
        raise DefinitionError("no roll-up answers this query")
    return out if any(taken) else None


def from_rollup(layer, planner: Planner, model: Model, rollup: PreAggregation, leaves: list[Leaf], outputs: list[str]) -> DataFrame:
    ctx = planner.ctx
    rows = ctx.spark.table(table_name(model, rollup))
    if rollup.type == "lambda" and rollup.build_range_end:
        # stored buckets up to the boundary, fresh rows from there on
        time = f"{rollup.time_dimension}_{rollup.granularity}"
        fresh = definition(layer, model, rollup, since=rollup.build_range_end)
        rows = rows.filter(F.col(time) < F.lit(rollup.build_range_end).cast("timestamp")).select(*fresh.columns).unionByName(fresh)
    if rollup.time_dimension:
        rows = rows.withColumnRenamed(f"{rollup.time_dimension}_{rollup.granularity}", rollup.time_dimension)
    names = {x.identity: n for n, x in stored(layer, model, rollup)[0].items()}
    kept = [d for d in model.dimensions if d.name in rows.columns]
    plain = Model(model.name, table=table_name(model, rollup), primary_key=model.primary_key, dimensions=[type(d)(d.name, d.type, granularity=d.granularity) for d in kept])
    again: list[Leaf] = []
    exact = {}
    for leaf in leaves:
        if leaf.agg == "avg({x})":
            total, n = (names[Leaf(leaf.model, a, leaf.raw, leaf.name, leaf.filters).identity] for a in ("sum({x})", "count({x})"))
            again += [Leaf(model.name, "sum({x})", total, total), Leaf(model.name, "sum({x})", n, n)]
        else:
            column = names[leaf.identity]
            again.append(Leaf(model.name, AGAIN.get(leaf.agg, "max({x})"), column, column))  # others stand at the exact grain
        exact[id(leaf)] = len(again)
    graph = copy.copy(layer.graph)  # in which the roll-up is the model; joins stay as they are
    graph._hops = layer.graph.hops()
    graph.models = layer.graph.models | {model.name: plain}
    own = Planner(replace(ctx, graph=graph, frames=ctx.frames | {model.name: rows}), planner.dimensions, planner.filters)
    own.preferred = planner.preferred
    out = own.part(model.name, again, [f"__again{i}" for i in range(len(again))])
    made = []
    for i, leaf in enumerate(leaves):
        at = exact[id(leaf)]
        if leaf.agg == "avg({x})":
            made.append(F.expr(f"try_divide(__again{at - 2}, __again{at - 1})").alias(outputs[i]))
        elif leaf.agg in ("count({x})", "count_if({x})"):
            made.append(F.expr(f"coalesce(__again{at - 1}, 0)").alias(outputs[i]))
        else:
            made.append(F.col(f"__again{at - 1}").alias(outputs[i]))
    return out.select(*[d.internal for d in planner.dimensions], *made)


def recommend(log: list[Asked], least: int = 2) -> list[dict]:
    """Roll-ups for frequent query shapes of one model, best first."""
    shapes = Counter((a.models[0], frozenset(a.metrics), frozenset(a.dimensions)) for a in log if len(a.models) == 1)
    found = []
    for (model, metrics, dims), n in shapes.items():
        if n >= least:
            # fixed weights
            value = 0.5 * math.log10(n + 1) / 6 + 0.25 / (1 + len(dims)) + 0.25 / (1 + len(metrics))
            time = next((d for d in sorted(dims) if "__" in d), None)
            found.append({
                "model": model, "queries": n, "score": round(value, 6), "measures": sorted(m.split(".")[-1] for m in metrics),
                "dimensions": sorted(d.split(".")[-1] for d in dims if d != time),
                "time_dimension": time.split(".")[-1].rsplit("__", 1)[0] if time else None, "granularity": time.rsplit("__", 1)[1] if time else None,
            })
    return sorted(found, key=lambda x: -x["score"])


