"""What a user declares: models, dimensions, metrics, relationships and the rest.

Plain dataclasses; fields are checked when a graph takes them in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
#: Simple aggregates and the SQL each becomes; {x} is the measured expression.
AGGREGATES = {
    "sum": "sum({x})",
    "count": "count({x})",
    "count_distinct": "count(distinct {x})",
    "approx_count_distinct": "approx_count_distinct({x})",
    "avg": "avg({x})",
    "min": "min({x})",
    "max": "max({x})",
    "median": "median({x})",
    "stddev": "stddev_samp({x})",
    "stddev_pop": "stddev_pop({x})",
    "variance": "var_samp({x})",
    "variance_pop": "var_pop({x})",
    # beyond the twelve: recognised where importers or raw expressions bring them
    "sum_boolean": "sum(cast({x} as int))",
    "count_if": "count_if({x})",
    "mode": "mode({x}, true)",  # of equally frequent values the smallest
    "kurtosis": "kurtosis({x})",
    "skewness": "skewness({x})",
    "any_value": "any_value({x})",
    "string_agg": "array_join(array_sort(collect_set({x})), ', ')",
    "list": "collect_list({x})",
    "geometric_mean": "exp(avg(ln({x})))",
    "product": "product({x})",
    "entropy": "entropy({x})",
    # by a sketch, in memory that doesn't grow with the group
    "approx_median": "percentile_approx({x}, 0.5)",
}
METRIC_TYPES = ("ratio", "derived", "cumulative", "time_comparison", "conversion", "retention", "cohort")


#: Keys that describe a field and change no number; they may be given anywhere.
DESCRIPTIVE = {"meta", "tags", "label", "description", "owner", "format", "value_format_name", "drill_fields", "synonyms", "public"}


class DefinitionError(ValueError):
    """A definition or query that can't be right."""


class Declared:
    @classmethod
    def of(cls, given: dict[str, Any]):
        known = {f.name for f in fields(cls)}
        unknown = [k for k in given if k not in known | DESCRIPTIVE]
        if unknown:
            raise DefinitionError(f"{cls.__name__.lower()} {given.get('name', '')}: unknown key {unknown[0]!r}")
        return cls(**{k: v for k, v in given.items() if k in known})


@dataclass
class Dimension(Declared):
    name: str
    type: str = "categorical"
    sql: str | None = None
    granularity: str | None = None
    supported_granularities: list[str] | None = None
    parent: str | None = None
    window: str | None = None
    format: str | None = None
    label: str | None = None
    description: str | None = None
    public: bool = True
    synonyms: list[str] | None = None

    @property
    def expression(self) -> str:
        return self.window or self.sql or self.name


@dataclass
class Metric(Declared):
    name: str
    agg: str | None = None
    sql: str | None = None
    type: str | None = None
    filters: list[str] | None = None
    fill_nulls_with: Any = None
    # ratio
    numerator: str | None = None
    denominator: str | None = None
    offset_window: str | None = None
    # cumulative
    window: str | None = None
    grain_to_date: str | None = None
    window_expression: str | None = None
    window_frame: str | None = None
    window_order: str | None = None
    partition: bool = False
    # time comparison
    base_metric: str | None = None
    comparison_type: str | None = None
    time_offset: str | None = None
    calculation: str | None = None
    # conversion and funnel
    entity: str | None = None
    base_event: str | None = None
    conversion_event: str | None = None
    conversion_window: str | None = None
    steps: list[str] | None = None
    # retention
    cohort_event: str | None = None
    activity_event: str | None = None
    periods: int = 28
    retention_granularity: str = "day"
    # cohort: two levels
    inner_metrics: list[dict] | None = None
    entity_dimensions: list[str] | None = None
    having: str | None = None
    # the rest
    non_additive_dimension: str | None = None
    non_additive_choice: str = "max"
    non_additive_groupings: list[str] | None = None
    distinct_key: str | None = None
    percentile: float | None = None
    sql_is_complete: bool = False
    extends: str | None = None
    format: str | None = None
    label: str | None = None
    description: str | None = None
    public: bool = True

    def __post_init__(self):
        if self.agg and self.agg not in AGGREGATES and self.agg not in ("percentile", "approx_percentile"):
            raise DefinitionError(f"metric {self.name}: unknown aggregate {self.agg!r}")
        if self.type is not None and self.type not in METRIC_TYPES:
            raise DefinitionError(f"metric {self.name}: unknown type {self.type!r}")
        if self.agg is None and self.type is None and self.sql and not self.sql_is_complete:
            self.agg, self.sql = split_aggregate(self.sql)
        needed = {"ratio": ("numerator", "denominator"), "time_comparison": ("base_metric",), "cumulative": (), "derived": ("sql",)}
        for name in needed.get(self.type or "", ()):
            if not getattr(self, name):
                raise DefinitionError(f"metric {self.name}: type {self.type} needs {name}")
        if self.type == "conversion" and not (self.steps or (self.entity and self.base_event and self.conversion_event)):
            raise DefinitionError(f"metric {self.name}: conversion needs entity, base_event and conversion_event, or steps")


_CALL = re.compile(r"\s*(\w+)\s*\(\s*(distinct\s+)?(.*)\)\s*$", re.IGNORECASE | re.DOTALL)
_SQL_NAMES = {"sum": "sum", "count": "count", "avg": "avg", "min": "min", "max": "max", "median": "median", "stddev": "stddev", "stddev_samp": "stddev", "stddev_pop": "stddev_pop", "variance": "variance", "var_samp": "variance", "var_pop": "variance_pop", "variance_pop": "variance_pop", "approx_count_distinct": "approx_count_distinct"}


def split_aggregate(sql: str) -> tuple[str | None, str | None]:
    """``SUM(x)`` -> ("sum", "x"); anything but one aggregate around all stays an expression."""
    call = _CALL.match(sql)
    if not call or call[1].lower() not in _SQL_NAMES:
        return None, sql
    depth = 0
    for c in call[3]:
        depth += (c == "(") - (c == ")")
        if depth < 0:  # the first bracket closes before the end, as in SUM(x) / SUM(y)
            return None, sql
    agg = _SQL_NAMES[call[1].lower()]
    if call[2]:
        if agg != "count":
            return None, sql
        agg = "count_distinct"
    inner = call[3].strip()
    return agg, None if inner == "*" else inner


@dataclass
class Relationship(Declared):
    name: str  # the other model
    type: str = "many_to_one"
    foreign_key: str | list[str] | None = None
    primary_key: str | list[str] | None = None
    through: str | None = None
    through_foreign_key: str | list[str] | None = None
    related_foreign_key: str | list[str] | None = None
    sql: str | None = None
    join_type: str | None = None
    active: bool = True

    TYPES = ("many_to_one", "one_to_one", "one_to_many", "many_to_many", "cross")

    def __post_init__(self):
        if self.type not in self.TYPES:
            raise DefinitionError(f"relationship to {self.name}: unknown type {self.type!r}")


@dataclass
class Segment(Declared):
    name: str
    sql: str
    description: str | None = None
    public: bool = True


@dataclass
class Parameter(Declared):
    name: str
    type: str = "string"
    default_value: Any = None
    allowed_values: list[Any] | None = None

    def format(self, value: Any) -> str:
        """The value as SQL; what its type doesn't allow raises."""
        value = self.default_value if value is None else value
        if self.allowed_values is not None and value not in self.allowed_values:
            raise DefinitionError(f"parameter {self.name}: {value!r} is not allowed")
        if self.type == "number":
            return repr(float(value)) if isinstance(value, float) else str(int(value)) if str(value).lstrip("-").isdigit() else repr(float(value))
        if self.type == "unquoted":
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", str(value)):
                raise DefinitionError(f"parameter {self.name}: {value!r} is no plain name")
            return str(value)
        if self.type == "yesno":
            return "TRUE" if value in (True, "yes", "true", "True", 1) else "FALSE"
        if self.type == "date" and not re.fullmatch(r"\d{4}-\d{2}-\d{2}([ T][\d:.]+)?", str(value)):
            raise DefinitionError(f"parameter {self.name}: {value!r} is no date")
        return quote(str(value))


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class PreAggregation(Declared):
    name: str
    measures: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    time_dimension: str | None = None
    granularity: str | None = None
    type: str = "rollup"
    partition_granularity: str | None = None
    refresh_key: dict | None = None
    build_range_start: str | None = None
    build_range_end: str | None = None
    sql: str | None = None


@dataclass
class SecurityPolicy(Declared):
    access: str | bool | None = None
    row_filters: list[str] = field(default_factory=list)


@dataclass
class Model(Declared):
    name: str
    table: str | None = None
    sql: str | None = None
    source_uri: str | None = None
    source_format: str | None = None
    primary_key: str | list[str] | None = None
    unique_keys: list[list[str]] | None = None
    relationships: list[Relationship] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    pre_aggregations: list[PreAggregation] = field(default_factory=list)
    default_time_dimension: str | None = None
    default_grain: str | None = None
    auto_dimensions: bool = False
    security: SecurityPolicy | None = None
    extends: str | None = None
    description: str | None = None

    def __post_init__(self):
        kinds = {"relationships": Relationship, "dimensions": Dimension, "metrics": Metric, "segments": Segment, "pre_aggregations": PreAggregation}
        for name, kind in kinds.items():
            setattr(self, name, [kind.of(x) if isinstance(x, dict) else x for x in getattr(self, name) or []])
        if isinstance(self.security, dict):
            self.security = SecurityPolicy.of(self.security)

    @property
    def key(self) -> list[str]:
        return [self.primary_key] if isinstance(self.primary_key, str) else list(self.primary_key or [])

    def _find(self, kind: str, name: str):
        return next((x for x in getattr(self, kind) if x.name == name), None)

    def dimension(self, name: str) -> Dimension | None:
        return self._find("dimensions", name)

    def metric(self, name: str) -> Metric | None:
        return self._find("metrics", name)

    def segment(self, name: str) -> Segment | None:
        return self._find("segments", name)

    def hierarchy(self, name: str) -> list[str]:
        """From the top ancestor down to ``name``."""
        path: list[str] = []
        at: str | None = name
        while at is not None and at not in path:
            found = self.dimension(at)
            if found is None:
                raise DefinitionError(f"{self.name} has no dimension {at}")
            path.append(at)
            at = found.parent
        return path[::-1]

    def drill_down(self, name: str) -> str | None:
        return next((d.name for d in self.dimensions if d.parent == name), None)

    def drill_up(self, name: str) -> str | None:
        found = self.dimension(name)
        return found.parent if found else None

    def extended_by(self, child: Model) -> Model:
        """What ``child`` inherits from this model: its own entries win by name."""
        merged: dict[str, Any] = {}
        for f in fields(Model):
            mine, own = getattr(self, f.name), getattr(child, f.name)
            if isinstance(mine, list) and f.name not in ("primary_key", "unique_keys"):
                names = {x.name for x in own}
                merged[f.name] = [*(x for x in mine if x.name not in names), *own]
            else:
                merged[f.name] = own if own not in (None, False, []) else mine
        return replace(child, **merged | {"name": child.name, "extends": None})


@dataclass
class Explore(Declared):
    """What a consumer may ask for: allowed fields, filters that always hold, defaults, a row cap."""

    name: str
    metrics: list[str] | None = None
    dimensions: list[str] | None = None
    filters: list[str] = field(default_factory=list)
    default_metrics: list[str] = field(default_factory=list)
    default_dimensions: list[str] = field(default_factory=list)
    max_limit: int | None = None


@dataclass
class SavedQuery(Declared):
    name: str
    metrics: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
