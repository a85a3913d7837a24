"""Metric queries over base tables: joins, safe aggregation, formulas.

A query becomes parts, one for each model whose metrics it asks for. A part projects
what it needs from each model, joins the models by their paths, and aggregates at the
query's dimensions. A part whose joins multiply its model's rows first keeps one row for
each (dimensions, primary key). Parts meet in a null-safe full join on the dimensions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.templates import allowed, render_secure
from ..graph import Graph, Hop
from ..model import AGGREGATES, GRAINS, DefinitionError, Metric, Model
from .exact import apart, grouped
from .text import aggregate_calls, bare, dotted, lenient, native, replace_bare, replace_dotted


#: Bytes of base tables for each task that groups multiplied rows, and the least size that stands for an unknown one.
PIECE, UNKNOWN = 8 << 20, 1 << 50


@dataclass(frozen=True)
class Field:
    """A dimension of a query: its model, name and grain, and the output column."""

    model: str
    name: str
    grain: str | None
    output: str

    @property
    def column(self) -> str:
        return f"{self.name}__{self.grain}" if self.grain else self.name

    @property
    def internal(self) -> str:
        return f"__d_{self.model}__{self.column}"


@dataclass
class Leaf:
    """An aggregate over one model's rows: ``agg`` has {x} for the measured column, or raw columns by name."""

    model: str
    agg: str
    raw: str | None
    name: str
    filters: tuple[str, ...] = ()
    distinct_key: str | None = None
    semi: tuple | None = None
    columns: tuple[str, ...] = ()

    @property
    def identity(self) -> tuple:
        return (self.model, self.agg, self.raw, self.filters, self.distinct_key, self.semi)


@dataclass
class Context:
    """What a query is planned against."""

    spark: SparkSession
    graph: Graph
    timezone: str | None = None
    user: dict | None = None
    secure: bool = True
    frames: dict[str, DataFrame] = field(default_factory=dict)  # models replaced, as by roll-ups
    render: object = None  # renders templates

    def admit(self, model: Model) -> None:
        """Raise unless the model's policy, if it has one, lets this user in. A policy can't be
        got round by giving no user attributes."""
        if not self.secure or model.security is None:
            return
        if self.user is None:
            raise PermissionError(f"model {model.name} needs user attributes")
        if not allowed(model.security.access, self.user):
            raise PermissionError(f"model {model.name} is closed to this user")

    def load(self, model: Model) -> DataFrame:
        if model.name in self.frames:
            return self.frames[model.name]
        if model.sql:
            return self.spark.sql(strip_model(model.sql, model.name))
        if model.table:
            return self.spark.table(model.table)
        reader = self.spark.read.format(model.source_format) if model.source_format else self.spark.read
        uri = model.source_uri
        if model.source_format or not uri.rsplit(".", 1)[-1] in ("parquet", "csv", "json", "orc"):
            return reader.load(uri)
        return reader.options(header=True, inferSchema=True).csv(uri) if uri.endswith(".csv") else getattr(reader, uri.rsplit(".", 1)[-1])(uri)


def strip_model(sql: str, name: str) -> str:
    """``{model}.x`` and ``model.x`` as ``x``."""
    sql = sql.replace("{model}.", "").replace("{model}", name)
    return replace_dotted(sql, lambda a, b: b if a == name else None)


def dimension_sql(ctx: Context, model: Model, name: str, grain: str | None = None) -> str:
    """SQL of a dimension or raw column over the model's rows."""
    dimension = model.dimension(name)
    sql = strip_model(dimension.expression, model.name) if dimension else f"`{name}`"
    if grain:
        if grain not in GRAINS:
            raise DefinitionError(f"{model.name}.{name}: unknown grain {grain}")
        if dimension and dimension.supported_granularities and grain not in dimension.supported_granularities:
            raise DefinitionError(f"{model.name}.{name} doesn't support the grain {grain}")
        if ctx.timezone:
            sql = f"from_utc_timestamp({sql}, '{ctx.timezone}')"
        sql = f"date_trunc('{grain}', {sql})"
    return sql


def split_grain(graph: Graph, model: str, name: str) -> tuple[str, str | None]:
    """``created_at__month`` -> (created_at, month), unless a dimension has that whole name."""
    if graph.model(model).dimension(name) is None and "__" in name:
        base, grain = name.rsplit("__", 1)
        if grain in GRAINS:
            return base, grain
    return name, None


def is_window(model: Model, name: str) -> bool:
    dimension = model.dimension(name)
    return bool(dimension and (dimension.window or " over (" in f" {dimension.sql or ''}".lower().replace("over(", "over (")))


def inline_refs(ctx: Context, text: str, model: Model) -> str:
    """A fragment over the model's own rows: its fields by their SQL."""
    text = text.replace("{model}.", f"{model.name}.")

    def by(owner: str, name: str) -> str | None:
        if owner != model.name:
            return None
        base, grain = split_grain(ctx.graph, owner, name)
        return f"({dimension_sql(ctx, model, base, grain)})"

    return replace_dotted(text, by)


def resolve_names(ctx: Context, sql: str, model: Model, columns: set[str]) -> str:
    """Names that are no columns but dimensions of the model become their SQL."""
    sql = inline_refs_raw(sql, model, columns)
    return replace_bare(sql, lambda n: f"({strip_model(model.dimension(n).expression, model.name)})" if n not in columns and model.dimension(n) else None)


def inline_refs_raw(sql: str, model: Model, columns: set[str]) -> str:
    """``{model}.x``: the raw column if there is one, else the dimension's SQL."""
    sql = sql.replace("{model}.", f"{model.name}.")

    def by(owner: str, name: str) -> str | None:
        if owner != model.name:
            return None
        found = model.dimension(name)
        return f"`{name}`" if name in columns or not found else f"({strip_model(found.expression, model.name)})"

    return replace_dotted(sql, by)


class Compiler:
    """Metrics to formulas over leaves."""

    def __init__(self, ctx: Context):
        self.ctx, self.leaves, self._known = ctx, [], {}
        #: Gives the column of a window metric that stands in a formula.
        self.windowed: Callable[[str | None, Metric], str | None] = lambda owner, metric: None

    def leaf(self, leaf: Leaf) -> str:
        if leaf.identity not in self._known:
            self._known[leaf.identity] = f"__leaf{len(self.leaves)}"
            self.leaves.append(leaf)
        return self._known[leaf.identity]

    def metric(self, owner: str | None, metric: Metric, trail: tuple[str, ...] = ()) -> str:
        """The formula; leaf columns by name."""
        tag = f"{owner}.{metric.name}"
        if tag in trail:
            raise DefinitionError(f"metric {metric.name} depends on itself: {' -> '.join((*trail, tag))}")
        trail = (*trail, tag)
        formula = self._formula(owner, metric, trail)
        if metric.fill_nulls_with is not None:
            value = metric.fill_nulls_with
            formula = f"coalesce({formula}, {value!r})" if not isinstance(value, str) else f"coalesce({formula}, '{value}')"
        return formula

    def _formula(self, owner: str | None, metric: Metric, trail: tuple[str, ...]) -> str:
        column = self.windowed(owner, metric) if len(trail) > 1 else None
        if column:
            return column
        if metric.type == "ratio":
            top, bottom = (self.reference(owner, r, trail) for r in (metric.numerator, metric.denominator))
            return f"(({top}) / nullif({bottom}, 0))"
        if metric.type == "derived" or (metric.agg is None and metric.type is None):
            return f"({self.expression(owner, metric.sql or '', metric, trail)})"
        if metric.type == "cumulative" and metric.agg and metric.sql and not self.ctx.graph.find_metric(f"{owner}.{metric.sql}"):
            return self.simple(owner, metric)
        if metric.type is not None:
            raise DefinitionError(f"metric {metric.name} of type {metric.type} can't be part of a formula")
        return self.simple(owner, metric)

    def reference(self, owner: str | None, ref: str, trail: tuple[str, ...]) -> str:
        found = (self.ctx.graph.find_metric(f"{owner}.{ref}") if owner and "." not in ref else None) or self.ctx.graph.find_metric(ref)
        if not found:
            raise DefinitionError(f"no metric {ref}")
        return self.metric(found[0], found[1], trail)

    def expression(self, owner: str | None, sql: str, metric: Metric, trail: tuple[str, ...]) -> str:
        """A formula with metrics by name, their totals as ``_.all(metric)``, and inline aggregates."""
        totals = lambda m: re.sub(r"__leaf(\d+)", r"__total\1", f"({self.reference(owner, m[1], trail)})")
        sql = re.sub(r"(?<![\w.])_\.all\(\s*([\w.]+)\s*\)", totals, sql)
        pieces, at = [], 0
        for start, end in aggregate_calls(sql):
            pieces += [self._names(owner, sql[at:start], trail), self.opaque(owner, sql[start:end], metric)]
            at = end
        return "".join([*pieces, self._names(owner, sql[at:], trail)])

    def _names(self, owner: str | None, sql: str, trail: tuple[str, ...]) -> str:
        graph = self.ctx.graph
        sql = sql.replace("{model}.", f"{owner}." if owner else "")
        sql = replace_dotted(sql, lambda a, b: self.metric(a, graph.models[a].metric(b), trail) if a in graph.models and graph.models[a].metric(b) else None)

        def by(name: str) -> str | None:
            if name.startswith(("__leaf", "__total")):
                return None
            found = (graph.find_metric(f"{owner}.{name}") if owner else None) or graph.find_metric(name)
            return self.metric(found[0], found[1], trail) if found else None

        return replace_bare(sql, by)

    def opaque(self, owner: str | None, call: str, metric: Metric) -> str:
        """An inline aggregate: its raw columns are projected and named in place."""
        graph = self.ctx.graph
        if owner is None:
            owners = {a for a, _ in dotted(call) if a in graph.models}
            if len(owners) != 1:
                raise DefinitionError(f"metric {metric.name}: can't tell the model of {call}")
            owner = owners.pop()
        model = graph.model(owner)
        columns = set(self.ctx.load(model).columns)
        text = resolve_names(self.ctx, call, model, columns).replace("`", "")
        text = text.replace("COUNT(*)", "count(1)").replace("count(*)", "count(1)")
        text = native(text)
        names = tuple(sorted({n for n in bare(text) if n in columns}))
        text = replace_bare(text, lambda n: f"`__c_{owner}__{n}`" if n in columns else None)
        return self.leaf(Leaf(owner, text, None, metric.name, tuple(metric.filters or ()), columns=names))

    def simple(self, owner: str | None, metric: Metric) -> str:
        if owner is None:
            owners = {a for a, _ in dotted(metric.sql or "") if a in self.ctx.graph.models}
            if len(owners) != 1:
                raise DefinitionError(f"can't tell the model of metric {metric.name}")
            owner = owners.pop()
        model = self.ctx.graph.model(owner)
        raw = metric.sql
        if metric.agg == "count" and raw is None:
            raw = "1"
        elif metric.agg == "count_distinct" and raw is None:
            if not model.key:
                raise DefinitionError(f"metric {metric.name}: count_distinct needs sql or a primary key")
            raw = model.key[0] if len(model.key) == 1 else f"struct({', '.join(model.key)})"
        elif raw is None:
            raw = metric.name
        agg = f"{metric.agg}({{x}}, {metric.percentile})" if metric.agg in ("percentile", "approx_percentile") else AGGREGATES[metric.agg or "sum"]
        agg = native(agg)
        semi = None
        if metric.non_additive_dimension:
            semi = (metric.non_additive_dimension, metric.non_additive_choice, tuple(metric.non_additive_groupings or ()))
        return self.leaf(Leaf(owner, agg, raw, metric.name, tuple(metric.filters or ()), metric.distinct_key, semi))


def aggregated(agg: str, x: str) -> Column:
    """An aggregate of the column ``x``."""
    if agg == "product({x})":  # no function of SQL
        return F.product(F.expr(x))
    return F.expr(agg.replace("{x}", x))


def pieces(rows: DataFrame) -> int:
    """How many tasks group multiplied rows, by the size of the tables that they come from; 1 if none tells its size."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN) // PIECE + 1


class Planner:
    """Plans leaves at dimensions under row filters."""

    def __init__(self, ctx: Context, dimensions: list[Field], filters: list[str], mentioned: Iterable[str] = ()):
        self.ctx, self.dimensions, self.filters = ctx, dimensions, filters
        self.preferred = frozenset([*(d.model for d in dimensions), *mentioned])

    # models and joins

    def filter_models(self) -> set[str]:
        return {a for f in self.filters for a, _ in dotted(f) if a in self.ctx.graph.models}

    def hops(self, base: str) -> list[Hop]:
        """Joins from ``base`` to all models of the query, each model once."""
        found: dict[str, Hop] = {}
        for goal in dict.fromkeys([*(d.model for d in self.dimensions), *sorted(self.filter_models())]):
            for hop in self.ctx.graph.path(base, goal, self.preferred | {base}):
                if hop.right != base:
                    found.setdefault(hop.right, hop)
        return list(found.values())

    def participants(self, models: Iterable[str]) -> list[str]:
        """Every model that a query for metrics of ``models`` reads: theirs, those of dimensions and
        filters, and those that joins pass through."""
        starts = list(dict.fromkeys(models)) or [self.start(list(dict.fromkeys(d.model for d in self.dimensions)))]
        found = dict.fromkeys([*starts, *(d.model for d in self.dimensions), *sorted(self.filter_models())])
        for base in starts:
            found |= dict.fromkeys(h.right for h in self.hops(base))
        return list(found)

    def multiplies(self, base: str) -> bool:
        return any(h.multiplies for h in self.hops(base))

    def frame(self, name: str, keys: set[str], leaves: list[Leaf], filters: list[str], fields: set[tuple[str, str | None]], raw: bool = False) -> DataFrame:
        """A model's rows with what the query needs, all under names of its own."""
        ctx, model = self.ctx, self.ctx.graph.model(name)
        ctx.admit(model)
        base = ctx.load(model)
        columns = set(base.columns)
        for text in secured(ctx, model):
            base = base.filter(inline_refs_raw(text, model, columns))
        windowed = [f for f in filters if any(is_window(model, split_grain(ctx.graph, name, b)[0]) for a, b in dotted(f) if a == name)]
        for text in (f for f in filters if f not in windowed):
            base = base.filter(inline_refs(ctx, text, model))
        made: dict[str, Column] = {}
        for column in keys:
            made[f"__k_{name}__{column}"] = F.expr(f"`{column}`" if column in columns else dimension_sql(ctx, model, column))
        for field_name, grain in fields:
            made[f"__d_{name}__{field_name}" + (f"__{grain}" if grain else "")] = F.expr(resolve_names(ctx, dimension_sql(ctx, model, field_name, grain), model, columns))
        for at, leaf in enumerate(leaves):
            if leaf.raw is not None:
                x = F.expr(resolve_names(ctx, leaf.raw, model, columns))
                made[f"__m{at}"] = self.filtered(model, leaf, x, columns)
            for column in leaf.columns:
                made[f"__c_{name}__{column}"] = self.filtered(model, leaf, F.col(column), columns)
            if leaf.distinct_key:
                made[f"__u{at}"] = F.expr(resolve_names(ctx, leaf.distinct_key, model, columns))
            if leaf.semi:
                time, _, groupings = leaf.semi
                made[f"__t{at}"] = F.expr(dimension_sql(ctx, model, time.split(".")[-1]))
                for i, g in enumerate(groupings):
                    made[f"__g{at}_{i}"] = F.expr(dimension_sql(ctx, model, g.split(".")[-1]))
        if not made:
            made["__one"] = F.lit(1)
        with lenient(ctx.spark):
            out = base.select(*[c.alias(n) for n, c in made.items()])
        for text in windowed:
            out = out.filter(replace_dotted(text, lambda a, b: f"`__d_{a}__{b}`"))
        return out

    def filtered(self, model: Model, leaf: Leaf, x: Column, columns: set[str]) -> Column:
        for text in leaf.filters:
            x = F.when(F.expr(resolve_names(self.ctx, text, model, columns)), x)
        return x

    def joined(self, base: str, leaves: list[Leaf], extra_keys: set[str] = frozenset()) -> DataFrame:
        graph, ctx = self.ctx.graph, self.ctx
        hops = self.hops(base)
        single = {f: {a for a, _ in dotted(f) if a in graph.models} for f in self.filters}
        crossing = [f for f, owners in single.items() if len(owners) != 1]  # without a model: constants and subqueries
        fields: dict[str, set[tuple[str, str | None]]] = {m: set() for m in [base, *(h.right for h in hops)]}
        for d in self.dimensions:
            fields[d.model].add((d.name, d.grain))
        for text, owners in single.items():
            for a, b in dotted(text):
                if a in owners and (len(owners) > 1 or is_window(graph.model(a), split_grain(graph, a, b)[0])):
                    fields[a].add(split_grain(graph, a, b))
        keys: dict[str, set[str]] = {m: set() for m in fields}
        keys[base] |= set(extra_keys)
        for hop in hops:
            keys[hop.left] |= set(hop.left_keys)
            keys[hop.right] |= set(hop.right_keys)
            if hop.condition:
                for side, model in (("from", hop.left), ("to", hop.right)):
                    text = hop.condition.replace(f"{{{side}}}.", "__side.")
                    keys[model] |= {b for a, b in dotted(text) if a == "__side"}
        frames = {m: self.frame(m, keys[m], leaves if m == base else [], [f for f, o in single.items() if o == {m}], fields[m]) for m in fields}
        out = frames[base]
        for hop in hops:
            if hop.cross:
                out = out.crossJoin(frames[hop.right])
                continue
            if hop.condition:
                text = replace_dotted(hop.condition.replace("{from}.", "__from.").replace("{to}.", "__to."), lambda a, b: {"__from": f"`__k_{hop.left}__{b}`", "__to": f"`__k_{hop.right}__{b}`"}.get(a))
                condition = F.expr(text)
            else:
                pairs = [F.col(f"__k_{hop.left}__{a}") == F.col(f"__k_{hop.right}__{b}") for a, b in zip(hop.left_keys, hop.right_keys)]
                condition = pairs[0]
                for p in pairs[1:]:
                    condition = condition & p
            narrowed = any(hop.right in o for o in single.values())
            out = out.join(frames[hop.right], condition, hop.how or ("inner" if narrowed else "left"))
        for text in crossing:
            out = out.filter(replace_dotted(text, lambda a, b: f"`__d_{a}__{b}`" if a in graph.models else None))
        return out

    # aggregation

    def part(self, model: str, leaves: list[Leaf], names: list[str], totals: bool = False) -> DataFrame:
        """Leaves of one model at the query's dimensions: dimension columns and ``names``."""
        many = self.multiplies(model)
        semi = any(x.semi for x in leaves)
        key = set(self.ctx.graph.model(model).key)
        if many and not key:
            raise DefinitionError(f"metrics of {model} meet joins that multiply its rows; it needs a primary_key")
        rows = self.joined(model, leaves, key if many else set())
        dims = [d.internal for d in self.dimensions]
        if semi:
            if many:
                raise DefinitionError("semi-additive metrics can't be combined with joins that multiply rows")
            rows = self.snapshots(rows, leaves)
        unique = [f"__u{i}" for i, x in enumerate(leaves) if x.distinct_key]
        if many or unique:
            # one row for each (dimensions, key). A row's own columns follow from its primary key; of
            # the values that a declared distinct key has, the smallest counts
            measured = [c for c in rows.columns if c.startswith(("__m", "__c_"))]
            owned = [f"__k_{model}__{k}" for k in key] if not unique else unique
            one = F.min if unique else F.any_value
            if many and (n := pieces(rows)) > 1:
                # else Spark sorts, joins and groups in one task what it deems small by its compressed size
                rows = rows.repartition(n, *dict.fromkeys([*dims, *owned]))
            rows = rows.groupBy(*dict.fromkeys([*dims, *owned])).agg(*[one(c).alias(c) for c in measured] or [F.lit(1).alias("__one")])
        with lenient(self.ctx.spark):
            made = [(x.agg.replace("{x}", f"`__m{i}`"), n, aggregated(x.agg, f"`__m{i}`")) for i, (x, n) in enumerate(zip(leaves, names))]
            if totals and dims and any(apart(text) for text, _, _ in made):
                whole = grouped(rows, [], made).select(*[F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dims], *names, F.lit(True).alias("_is_total"))
                return grouped(rows, dims, made).withColumn("_is_total", F.lit(False)).unionByName(whole)
            if totals:
                sets = [[F.col(d) for d in dims], []]
                return rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(*[c.alias(n) for _, n, c in made], (F.grouping_id() > 0).alias("_is_total"))
            return grouped(rows, dims, made) if dims or made else rows.select(*dims).distinct()

    def snapshots(self, rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
        """Of semi-additive leaves, rows off the first or last time of their partition measure NULL."""
        for i, leaf in enumerate(leaves):
            if not leaf.semi:
                continue
            time, choice, groupings = leaf.semi
            name = time.split(".")[-1]
            # a dimension that is the time itself, at its own grain, leaves nothing to choose from
            if any(d.model == leaf.model and d.name == name and d.grain is None for d in self.dimensions):
                continue
            by = [*[d.internal for d in self.dimensions], *[f"__g{i}_{j}" for j in range(len(groupings))]]
            # the edge of each partition is aggregated and met again: no task holds a partition's rows
            edges = rows.groupBy(*[F.col(c).alias(f"{c}__e") for c in by]).agg((F.min if choice == "min" else F.max)(f"__t{i}").alias("__edge"))
            if by:
                same = F.lit(True)
                for c in by:
                    same = same & F.col(c).eqNullSafe(F.col(f"{c}__e"))
                rows = rows.join(edges, same, "left")
            else:
                rows = rows.crossJoin(edges)  # one row
            kept = [c for c in rows.columns if c not in (f"__m{i}", "__edge", *(f"{c}__e" for c in by))]
            rows = rows.select(*kept, F.when(F.col(f"__t{i}") == F.col("__edge"), F.col(f"__m{i}")).alias(f"__m{i}"))
        return rows

    def aggregate(self, leaves: list[Leaf], totals: bool = False, instead: Callable[[str, list[Leaf], list[str]], DataFrame | None] | None = None) -> DataFrame:
        """All leaves (as __leaf0, ...) at the dimensions (under internal names). ``instead`` may
        give a part from elsewhere, as from a roll-up."""
        parts: dict[tuple, list[int]] = {}
        for i, leaf in enumerate(leaves):
            parts.setdefault((leaf.model, leaf.distinct_key), []).append(i)
        if not leaves:
            models = list(dict.fromkeys(d.model for d in self.dimensions))
            base = self.start(models)
            return self.joined(base, []).select(*[d.internal for d in self.dimensions]).distinct()
        if totals and len(parts) > 1:
            raise DefinitionError("totals need metrics of one model")
        frames = []
        for (model, _), at in parts.items():
            own, names = [leaves[i] for i in at], [f"__leaf{i}" for i in at]
            found = instead(model, own, names) if instead else None
            frames.append(self.part(model, own, names, totals) if found is None else found)
        out = frames[0]
        dims = [d.internal for d in self.dimensions]
        for n, right in enumerate(frames[1:]):
            if not dims:
                out = out.crossJoin(right)  # one row each
                continue
            renamed = right.select(*[F.col(d).alias(f"{d}__r{n}") for d in dims], *[c for c in right.columns if c not in dims])
            condition = None
            for d in dims:
                own = F.col(d).eqNullSafe(F.col(f"{d}__r{n}"))
                condition = own if condition is None else condition & own
            # a marker tells rows of the left side, so that a NULL dimension isn't taken for a missing row
            out = out.withColumn("__left", F.lit(True)).join(renamed, condition, "full")
            kept = [F.when(F.col("__left"), F.col(d)).otherwise(F.col(f"{d}__r{n}")).alias(d) for d in dims]
            out = out.select(*kept, *[c for c in out.columns if c not in dims and not c.endswith(f"__r{n}") and c != "__left"])
        return out

    def with_totals(self, out: DataFrame, leaves: list[Leaf], needed: list[int]) -> DataFrame:
        """``out`` with __total columns: leaves over all groups. What adds up is added over the groups;
        the rest is aggregated from the rows once more, to one row."""
        again = {"sum({x})": F.sum, "count({x})": F.sum, "min({x})": F.min, "max({x})": F.max}
        everything = Window.partitionBy()
        rest = [i for i in needed if leaves[i].agg not in again or leaves[i].distinct_key or leaves[i].semi or self.multiplies(leaves[i].model)]
        out = out.select("*", *[again[leaves[i].agg](f"__leaf{i}").over(everything).alias(f"__total{i}") for i in needed if i not in rest])
        if rest:
            whole = Planner(self.ctx, [], self.filters).aggregate([leaves[i] for i in rest])
            out = out.crossJoin(whole.select(*[F.col(f"__leaf{k}").alias(f"__total{i}") for k, i in enumerate(rest)]))  # one row
        return out

    def start(self, models: list[str]) -> str:
        """A model from which the others are reached, by joins that don't multiply where there is one."""
        best = None
        for m in models:
            try:
                many = self.multiplies(m)
            except DefinitionError:
                continue
            if not many:
                return m
            best = best or m
        if best is None:
            raise DefinitionError(f"no join path connects {', '.join(models)}")
        return best

    def detail(self, leaves: list[Leaf]) -> DataFrame:
        """Ungrouped rows: dimensions, primary key and raw measures (as __leaf0, ...)."""
        models = list(dict.fromkeys([*(x.model for x in leaves), *(d.model for d in self.dimensions)]))
        if len({x.model for x in leaves}) > 1:
            raise DefinitionError("ungrouped queries take metrics of one model")
        base = leaves[0].model if leaves else self.start(models)
        key = self.ctx.graph.model(base).key
        rows = self.joined(base, leaves, set(key))
        taken = {d.output for d in self.dimensions}
        return rows.select(
            *[d.internal for d in self.dimensions],
            *[F.col(f"__k_{base}__{k}").alias(k) for k in key if k not in taken],
            *[F.col(f"__m{i}").alias(f"__leaf{i}") for i, x in enumerate(leaves) if x.raw is not None],
        )


def secured(ctx: Context, model: Model) -> list[str]:
    """Row filters of the model's policy with the user's values; none given denies."""
    if not ctx.secure or not model.security or not model.security.row_filters:
        return []
    return [render_secure(text, ctx.user) for text in model.security.row_filters]


