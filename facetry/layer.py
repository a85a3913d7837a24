"""The façade: declare models, then ask for metrics by dimensions or in SQL."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import ResultCache
from .functions.relative_dates import expand
from .functions.templates import with_parameters
from .graph import Graph
from .model import DefinitionError, Dimension, Explore, Metric, Model, Parameter, SavedQuery
from .plans import events, rollups, windows
from .plans.live import Compiler, Context, Field, Planner, is_window, split_grain
from .plans.text import bare, dotted, lenient, replace_bare, replace_dotted, split_top


#: Queries that the log keeps.
LOG_LENGTH = 10_000


class SemanticLayer:
    """Models and metrics over a Spark session. Queries return DataFrames that nothing has run yet."""

    def __init__(self, spark: SparkSession, use_preaggregations: bool = False, default_limit: int | None = None, max_limit: int | None = None, enforce_visibility: bool = False, cache: ResultCache | None = None):
        self.spark, self.graph = spark, Graph()
        self.use_preaggregations, self.default_limit, self.max_limit = use_preaggregations, default_limit, max_limit
        self.enforce_visibility = enforce_visibility
        self.cache = cache
        self.log: deque[rollups.Asked] = deque(maxlen=LOG_LENGTH)

    # declarations

    def add_model(self, model: Model | dict) -> Model:
        model = Model.of(model) if isinstance(model, dict) else model
        if model.auto_dimensions:
            model.dimensions = [*model.dimensions, *self.introspect(model)]
        self.graph.add(model)
        return self.graph.models[model.name]

    def add_metric(self, metric: Metric | dict) -> None:
        self.graph.add_metric(Metric.of(metric) if isinstance(metric, dict) else metric)

    def add_parameter(self, parameter: Parameter | dict) -> None:
        parameter = Parameter.of(parameter) if isinstance(parameter, dict) else parameter
        self.graph.parameters[parameter.name] = parameter

    def add_explore(self, explore: Explore | dict) -> None:
        explore = Explore.of(explore) if isinstance(explore, dict) else explore
        self.graph.explores[explore.name] = explore

    def add_saved_query(self, query: SavedQuery | dict) -> None:
        query = SavedQuery.of(query) if isinstance(query, dict) else query
        self.graph.saved[query.name] = query

    def introspect(self, model: Model) -> list[Dimension]:
        """A dimension for each column that has none, typed by the schema."""
        kinds = {"date": ("time", "day"), "timestamp": ("time", "second"), "timestamp_ntz": ("time", "second"), "boolean": ("boolean", None)}
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        found = []
        for name, kind in Context(self.spark, self.graph).load(model).dtypes:
            if model.dimension(name) is None:
                type_, grain = kinds.get(kind, ("numeric", None) if kind in numeric or kind.startswith("decimal") else ("categorical", None))
                found.append(Dimension(name, type_, granularity=grain))
        return found

    # queries

    def query(
        self,
        metrics: list[str] | None = None,
        dimensions: list[str] | None = None,
        filters: list[str] | None = None,
        segments: list[str] | None = None,
        order_by: list[str] | None = None,
        limit: int | None = None,
        offset: int | None = None,
        ungrouped: bool = False,
        with_totals: bool = False,
        parameters: dict[str, Any] | None = None,
        aliases: dict[str, str] | None = None,
        timezone: str | None = None,
        use_preaggregations: bool | None = None,
        user_attributes: dict | None = None,
        explore: str | None = None,
        post_process: str | None = None,
        strict_rollups: bool = False,
    ) -> DataFrame:
        """Metrics (``model.metric`` or a graph metric) by dimensions (``model.dimension[__grain]``)."""
        metrics, dimensions, filters = list(metrics or []), list(dimensions or []), list(filters or [])
        if explore:
            metrics, dimensions, filters, limit = self._contract(explore, metrics, dimensions, filters, limit)
        limit = self._capped(limit)
        if with_totals and (limit is not None or offset or ungrouped):
            raise DefinitionError("totals can't be combined with limit, offset or ungrouped")
        if not metrics and not dimensions:
            raise DefinitionError("a query needs metrics or dimensions")
        ctx = Context(self.spark, self.graph, timezone, user_attributes)
        dimensions = self._with_default_time(metrics, dimensions)
        if self.enforce_visibility:
            self._check_visible(filters, segments or [], order_by or [])
        filters = [expand(with_parameters(f, self.graph.parameters, parameters or {})) for f in [*filters, *self._segments(segments or [])]]
        found = [self._metric(m) for m in metrics]
        fields = self._fields(dimensions, [m.name for _, m in found], aliases or {})
        self._check_access(ctx, fields, found)
        self.log.append(rollups.Asked(tuple(sorted({o for o, _ in found if o})), tuple(metrics), tuple(dimensions)))
        special = [m for _, m in found if m.type in ("conversion", "retention", "cohort")]
        if special:
            if len(found) > 1:
                raise DefinitionError(f"{special[0].name} of type {special[0].type} must be asked for alone")
            out = events.plan(ctx, found[0][0], special[0], fields, filters)
        else:
            routed = self.use_preaggregations if use_preaggregations is None else use_preaggregations
            out = self._plan(ctx, found, metrics, fields, filters, aliases or {}, ungrouped, with_totals, routed and not timezone and not ungrouped, strict_rollups)
        out = self._ordered(out, order_by or [], aliases or {})
        out = out.offset(offset) if offset else out
        out = out if limit is None else out.limit(limit)
        if post_process:
            return self.spark.sql(post_process.replace("{inner}", "{__inner}"), __inner=out)
        return out

    def table(self, **query) -> pa.Table:
        """A query's result as an Arrow table, from the cache if it is there. The key is the query,
        the user's attributes and the definitions; changed data is seen when the entry is too old."""
        if self.cache is None:
            return self.query(**query).toArrow()
        g = self.graph
        state = (g.models, g.metrics, g.parameters, g.explores, self.enforce_visibility, self.default_limit, self.max_limit, self.use_preaggregations)
        key = hashlib.sha256(repr((sorted(query.items()), state)).encode()).hexdigest()
        return self.cache.get(key, lambda: self.query(**query).toArrow())

    def run_saved(self, name: str, **more) -> DataFrame:
        q = self.graph.saved[name]
        return self.query(q.metrics, q.dimensions, [*q.filters, *more.pop("filters", [])], order_by=q.order_by, limit=q.limit, **more)

    def sql(self, text: str, **options) -> DataFrame:
        """A query in semantic SQL."""
        from .sql import run

        return run(self, text, **options)

    def explain(self, **query) -> str:
        """Spark's physical plan of a query."""
        return self.query(**query)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def create_view(self, name: str, **query) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise DefinitionError(f"{name!r} is no view name")
        self.query(**query).createOrReplaceTempView(name)

    # steps

    def _contract(self, name: str, metrics: list, dimensions: list, filters: list, limit: int | None):
        e = self.graph.explores.get(name)
        if e is None:
            raise DefinitionError(f"no explore {name}")
        metrics, dimensions = metrics or list(e.default_metrics), dimensions or list(e.default_dimensions)
        for kind, asked, open_ in (("metric", metrics, e.metrics), ("dimension", [d.rsplit("__", 1)[0] if d.rsplit("__", 1)[0] in (e.dimensions or []) else d for d in dimensions], e.dimensions)):
            closed = [a for a in asked if open_ is not None and a not in open_]
            if closed:
                raise PermissionError(f"explore {name} has no {kind} {closed[0]}")
        if e.max_limit is not None:
            limit = e.max_limit if limit is None else min(limit, e.max_limit)
        return metrics, dimensions, [*filters, *e.filters], limit

    def _capped(self, limit: int | None) -> int | None:
        limit = self.default_limit if limit is None else limit
        if self.max_limit is not None:
            limit = self.max_limit if limit is None else min(limit, self.max_limit)
        return limit

    def _metric(self, ref: str) -> tuple[str | None, Metric]:
        found = self.graph.find_metric(ref)
        if not found:
            raise DefinitionError(f"no metric {ref}")
        owner, metric = found
        if metric.extends:
            base = self._metric(f"{owner}.{metric.extends}" if owner else metric.extends)[1]
            own = {k: v for k, v in vars(metric).items() if v not in (None, False) and k not in ("extends",)}
            metric = Metric(**(vars(base) | own | {"name": metric.name, "extends": None}))
        return owner, metric

    def _fields(self, dimensions: list[str], metric_names: list[str], aliases: dict[str, str]) -> list[Field]:
        split = []
        for ref in dimensions:
            if "." not in ref:
                owners = [m.name for m in self.graph.models.values() if m.dimension(split_grain(self.graph, m.name, ref)[0])]
                if len(owners) != 1:
                    raise DefinitionError(f"{ref} is a dimension of {len(owners)} models; name the model")
                ref = f"{owners[0]}.{ref}"
            model, name = ref.split(".", 1)
            base, grain = split_grain(self.graph, model, name)
            if self.graph.model(model).dimension(base) is None:
                raise DefinitionError(f"model {model} has no dimension {base}")
            split.append((ref, model, base, grain, name))
        names = [s[4] for s in split] + metric_names
        return [Field(m, b, g, aliases.get(r) or (n if names.count(n) == 1 else f"{m}_{n}")) for r, m, b, g, n in split]

    def _with_default_time(self, metrics: list[str], dimensions: list[str]) -> list[str]:
        """Metrics of a model with a default time dimension come by it unless the query has a time dimension."""
        out = list(dimensions)
        for ref in metrics:
            found = self.graph.find_metric(ref)
            model = self.graph.models.get(found[0]) if found and found[0] else None
            if not model or not model.default_time_dimension or found[1].type in ("conversion", "retention", "cohort"):
                continue
            timed = False
            for d in out:
                owner, _, name = d.rpartition(".")
                if owner in self.graph.models:
                    dimension = self.graph.models[owner].dimension(split_grain(self.graph, owner, name)[0])
                    timed |= bool(dimension and dimension.type == "time")
            if not timed:
                out.append(f"{model.name}.{model.default_time_dimension}" + (f"__{model.default_grain}" if model.default_grain else ""))
        return out

    def _segments(self, segments: list[str]) -> list[str]:
        out = []
        for ref in segments:
            owner, _, name = ref.partition(".")
            segment = self.graph.model(owner).segment(name)
            if segment is None:
                raise DefinitionError(f"no segment {ref}")
            sql = segment.sql.replace("{model}", owner)
            columns = {d.name for d in self.graph.model(owner).dimensions}
            out.append("(" + replace_bare(sql, lambda n: f"{owner}.{n}" if n in columns else None) + ")")
        return out

    def _check_access(self, ctx: Context, fields: list[Field], found: list) -> None:
        for name in {*(f.model for f in fields), *(o for o, _ in found if o)}:
            ctx.admit(self.graph.model(name))
        if self.enforce_visibility:
            hidden = [f.name for f in fields if not self.graph.model(f.model).dimension(f.name).public] + [m.name for _, m in found if not m.public]
            if hidden:
                raise PermissionError(f"{hidden[0]} isn't public")

    def _check_visible(self, filters: list[str], segments: list[str], order_by: list[str]) -> None:
        """Fields that aren't public can't be filtered or sorted by, either."""
        refs = {(a, split_grain(self.graph, a, b)[0]) for f in filters for a, b in dotted(self._qualified(f)) if a in self.graph.models}
        refs |= {tuple(x.split()[0].split(".", 1)) for x in order_by if "." in x.split()[0]}
        for owner, name in refs:
            if owner in self.graph.models:
                field = self.graph.models[owner].dimension(name) or self.graph.models[owner].metric(name)
                if field and not field.public:
                    raise PermissionError(f"{owner}.{name} isn't public")
        for ref in segments:
            owner, _, name = ref.partition(".")
            segment = self.graph.model(owner).segment(name)
            if segment and not segment.public:
                raise PermissionError(f"{ref} isn't public")

    def _plan(self, ctx, found, refs, fields, filters, aliases, ungrouped, totals, routed, strict) -> DataFrame:
        rows, after = self._staged(filters, found)
        compiler = Compiler(ctx)
        window = windows.Windows(ctx, compiler, fields)
        outputs: list[tuple[str, str]] = []  # (column, formula over leaves)
        hidden: set[str] = set()  # outputs that only formulas need

        def windowed(owner: str | None, metric: Metric) -> str | None:
            """A window metric within a formula is a column of its own."""
            if not windows.needs(metric):
                return None
            name = f"__w_{owner or ''}_{metric.name}"
            if name not in {w.output for w in window.asked}:
                there = {o for o, _ in outputs}
                window.ask(owner, metric, name, outputs)
                hidden.update({o for o, _ in outputs} - there)
            return f"`{name}`"

        compiler.windowed = windowed
        for ref, (owner, metric) in zip(refs, found):
            if ref not in aliases and not windows.needs(metric) and dict(outputs).get(metric.name) == compiler.metric(owner, metric):
                hidden.discard(metric.name)  # there already, as what a window metric stands on
                continue
            taken = {f.output for f in fields} | {o for o, _ in outputs} | {w.output for w in window.asked}
            name = aliases.get(ref) or (metric.name if metric.name not in taken else f"{owner}_{metric.name}")
            if windows.needs(metric):
                window.ask(owner, metric, name, outputs)
                hidden.difference_update((window.asked[-1].base, window.asked[-1].bottom))
            elif name not in {o for o, _ in outputs}:
                outputs.append((name, compiler.metric(owner, metric)))
        having = []
        for text in after:  # metrics that are only filtered on are computed, too
            def named(a: str | None, b: str) -> str | None:
                near = next((h for o, _ in found if o and not a and (h := self.graph.find_metric(f"{o}.{b}"))), None)
                hit = near or self.graph.find_metric(f"{a}.{b}" if a else b)
                if not hit:
                    return None
                for ref, (owner, metric) in zip(refs, found):
                    if metric is hit[1]:
                        return f"`{aliases.get(ref) or metric.name}`"
                return f"({compiler.metric(*hit)})" if not windows.needs(hit[1]) else None

            names = {o for o, _ in outputs} | {w.output for w in window.asked}
            text = replace_dotted(text, lambda a, b: named(a, b) if a in self.graph.models else None)
            having.append(replace_bare(text, lambda n: None if n in names else named(None, n)))
        planner = Planner(ctx, fields, rows, [x.model for x in compiler.leaves])
        for name in planner.participants(x.model for x in compiler.leaves):
            ctx.admit(self.graph.model(name))
        if routed and compiler.leaves:
            hit = rollups.route(self, planner, compiler.leaves, strict)
            out = hit if hit is not None else planner.aggregate(compiler.leaves, totals)
        elif ungrouped:
            out = planner.detail(compiler.leaves)
        else:
            out = planner.aggregate(compiler.leaves, totals)
        over_all = sorted({int(i) for _, formula in outputs for i in re.findall(r"__total(\d+)", formula)})
        if over_all:
            if ungrouped or totals:
                raise DefinitionError("totals over all groups need a grouped query")
            out = planner.with_totals(out, compiler.leaves, over_all)
        with lenient(self.spark):
            kept = [F.col(f.internal).alias(f.output) for f in fields]
            extra = [F.col(c) for c in out.columns if ungrouped and not c.startswith(("__d_", "__leaf", "__total"))] + ([F.col("_is_total")] if totals else [])
            leaves = [F.col(f"__leaf{i}") for i in range(len(compiler.leaves)) if f"__leaf{i}" in out.columns]
            late = [(name, formula) for name, formula in outputs if "`__w_" in formula]
            early = [F.expr(formula).alias(name) for name, formula in outputs if "`__w_" not in formula]
            out = out.select(*kept, *extra, *leaves, *[F.col(f"__total{i}") for i in over_all], *early)
            if totals and window.asked:
                raise DefinitionError("totals can't be combined with window metrics")
            if window.asked:
                out = window.apply(out)
            out = out.select("*", *[F.expr(formula).alias(name) for name, formula in late])
            for text in having:
                out = out.filter(text)
        return out.drop(*[c for c in out.columns if c.startswith(("__leaf", "__total", "__w_")) or c in hidden])

    def _staged(self, filters: list[str], found: list) -> tuple[list[str], list[str]]:
        """Filters on rows and filters on metrics; ANDs are taken apart."""
        rows, after = [], []
        for text in (p for f in filters for p in split_top(f, "and") if p):
            text = f"({text})" if len(split_top(text, "or")) > 1 else text
            about = any(a in self.graph.models and self.graph.models[a].metric(b) for a, b in dotted(text))
            owners = {o for o, _ in found if o}
            names = {m.name for _, m in found} | set(self.graph.metrics) | {m.name for o in owners for m in self.graph.models[o].metrics}
            dims = {d.name for m in self.graph.models.values() for d in m.dimensions}
            about |= any(n in names and n not in dims for n in bare(text))
            (after if about else rows).append(text if about else self._qualified(text))
        return rows, after

    def _qualified(self, text: str) -> str:
        """Bare dimension names of row filters get their model where only one model has them."""

        def by(name: str) -> str | None:
            owners = [m.name for m in self.graph.models.values() if m.dimension(split_grain(self.graph, m.name, name)[0])]
            return f"{owners[0]}.{name}" if len(owners) == 1 else None

        return replace_bare(text, by)

    def _ordered(self, out: DataFrame, order_by: list[str], aliases: dict[str, str]) -> DataFrame:
        columns = []
        for text in order_by:
            m = re.match(r"\s*([\w.]+)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*$", text, re.IGNORECASE)
            if not m:
                raise DefinitionError(f"can't order by {text!r}")
            name = aliases.get(m[1]) or m[1]
            for option in (name, name.split(".")[-1], name.replace(".", "_")):
                if option in out.columns:
                    break
            else:
                raise DefinitionError(f"{m[1]} isn't in the result")
            down, nulls = (m[2] or "asc").lower() == "desc", (m[3] or "last").lower()
            column = F.col(f"`{option}`")
            columns.append(getattr(column, f"{'desc' if down else 'asc'}_nulls_{nulls}")())
        return out.orderBy(*columns) if columns else out


__all__ = ["SemanticLayer", "is_window"]
