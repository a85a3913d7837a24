"""Definition files into models: native YAML and DDL, and YAML of other tools.

Other formats bring their own vocabulary; what maps onto models, dimensions, metrics and
relationships is taken, and what can't be expressed raises rather than changing numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from ..functions.translate import TIMEFRAMES, expression
from ..model import AGGREGATES, DefinitionError, Dimension, Explore, Metric, Model, Parameter, PreAggregation, Relationship, SavedQuery, SecurityPolicy, Segment
from ..plans.text import closing


@dataclass
class Definitions:
    models: list[Model] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    parameters: list[Parameter] = field(default_factory=list)
    explores: list[Explore] = field(default_factory=list)
    saved: list[SavedQuery] = field(default_factory=list)
    #: What a file has and can't be expressed: field and reason.
    unsupported: list[str] = field(default_factory=list)

    def into(self, layer) -> None:
        """All into a layer; models first that others extend."""
        waiting = list(self.models)
        while waiting:
            ready = [m for m in waiting if not m.extends or m.extends in layer.graph.models]
            if not ready:
                raise DefinitionError(f"model {waiting[0].name} extends the unknown model {waiting[0].extends}")
            for m in ready:
                layer.add_model(m)
            waiting = [m for m in waiting if m not in ready]
        for kind, add in (("metrics", layer.add_metric), ("parameters", layer.add_parameter), ("explores", layer.add_explore), ("saved", layer.add_saved_query)):
            for x in getattr(self, kind):
                add(x)

    def merge(self, other: Definitions) -> None:
        for f in fields(self):
            getattr(self, f.name).extend(getattr(other, f.name))


SUFFIXES = (".yml", ".yaml", ".sql", ".lkml", ".tds", ".twb", ".aml", ".gsql", ".tmdl", ".malloy", ".tml", ".json")


def load(path: str) -> Definitions:
    """A definition file, or all of a folder."""
    from . import more_formats

    where = Path(path)
    if where.is_dir():
        files = sorted(p for p in where.rglob("*") if p.suffix in SUFFIXES)
        found, taken = more_formats.folder(files)
        for file in files:
            if file not in taken:
                found.merge(load(str(file)))
        infer_relationships(found.models)
        return found
    text = where.read_text()
    if (made := more_formats.read(path, where.suffix, text)) is not None:
        return made
    if where.suffix == ".sql":
        return parse_sql(text)
    if where.suffix == ".lkml":
        return lookml(text)
    return parse_yaml(text)


def parse_yaml(text: str) -> Definitions:
    from . import more_formats

    data = yaml.safe_load(text) or {}
    if (made := more_formats.from_data(data)) is not None:
        return made
    if "cubes" in data:
        return cube(data)
    if "semantic_models" in data or (isinstance(data.get("metrics"), list) and any("type_params" in m for m in data["metrics"])):
        return metricflow(data)
    if data.get("type") in ("metrics_view", "metrics") and "model" in data or "timeseries" in data:
        return rill(data)
    if "table_name" in data and "columns" in data:
        return superset(data)
    if "tables" in data and any("base_table" in t for t in data["tables"]):
        return snowflake(data)
    if "base_sql_table" in data or "base_sql_query" in data:
        return hex_model(data)
    if "models" not in data and any(isinstance(v, dict) and "table" in v and ("dimensions" in v or "measures" in v) for v in data.values()):
        return expressions(data)
    return native(data)


# native


def native(data: dict) -> Definitions:
    found = Definitions()
    for m in data.get("models") or ([data] if "name" in data and ("table" in data or "sql" in data) else []):
        found.models.append(native_model(m))
    found.metrics = [Metric.of(metric_fields(m)) for m in data.get("metrics") or [] if "models" in data]
    found.parameters = [Parameter.of(p) for p in data.get("parameters") or []]
    found.explores = [Explore.of(e) for e in data.get("explores") or []]
    found.saved = [SavedQuery.of(q) for q in data.get("saved_queries") or []]
    return found


def metric_fields(m: dict) -> dict:
    """Aliases: expr and measure for sql."""
    m = dict(m)
    for alias in ("expr", "expression", "measure"):
        given = m.pop(alias, None)
        if given is not None and m.get("sql") is None:
            m["sql"] = given
    if isinstance(m.get("filters"), str):
        m["filters"] = [m["filters"]]
    return m


def dimension_fields(d: dict) -> dict:
    """Alias: expr for sql."""
    d = dict(d)
    d["sql"] = d.get("sql") or d.get("expr")
    d.pop("expr", None)
    return d


def native_model(m: dict) -> Model:
    m = dict(m)
    m["dimensions"] = [Dimension.of(dimension_fields(d)) for d in m.get("dimensions") or []]
    m["metrics"] = [Metric.of(metric_fields(x)) for x in [*(m.get("metrics") or []), *(m.pop("measures", None) or [])]]
    segments = list(m.get("segments") or [])
    for key, kind in (("sql_metrics", "METRIC"), ("sql_segments", "SEGMENT")):
        for head, body in statements(m.pop(key, "") or ""):
            if head == kind:
                (m["metrics"] if kind == "METRIC" else segments).append(Metric.of(metric_fields(body)) if kind == "METRIC" else Segment.of(body))
    m["segments"] = [s if isinstance(s, Segment) else Segment.of(s) for s in segments]
    return Model.of(m)


def dump(layer) -> str:
    """The layer's definitions as native YAML, without what is at its default."""

    def plain(x: Any) -> Any:
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, (Model, Dimension, Metric, Relationship, Segment, PreAggregation, Parameter, SecurityPolicy, Explore, SavedQuery)):
            out = {}
            for f in fields(x):
                value = getattr(x, f.name)
                default = f.default_factory() if callable(getattr(f, "default_factory", None)) and not isinstance(f.default_factory, type(field().default)) else f.default
                if value != default or f.name == "name":
                    out[f.name] = plain(value)
            return out
        return x

    g = layer.graph
    data = {"models": [plain(m) for m in g.models.values()], "metrics": [plain(m) for m in g.metrics.values()], "parameters": [plain(p) for p in g.parameters.values()], "explores": [plain(e) for e in g.explores.values()], "saved_queries": [plain(q) for q in g.saved.values()]}
    return yaml.safe_dump({k: v for k, v in data.items() if v}, sort_keys=False)


# native DDL

_STATEMENT = re.compile(r"\b(MODEL|DIMENSION|METRIC|RELATIONSHIP|SEGMENT|PARAMETER|PRE_AGGREGATION)\s*\(", re.IGNORECASE)
_BLOCK = re.compile(r"\bmodel\s+(\w+)\s+from\s+([\w.]+)\s*\(", re.IGNORECASE)


def _split(text: str) -> list[str]:
    """At commas outside of brackets and quotes."""
    parts, depth, quote_, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote_:
            quote_ = "" if c == quote_ else quote_
        elif c in "'\"":
            quote_ = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _value(text: str) -> Any:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_value(p) for p in _split(text[1:-1])]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" and text[0] not in text[1:-1]:
        return text[1:-1]
    return {"true": True, "false": False, "null": None}.get(text.lower(), int(text) if re.fullmatch(r"-?\d+", text) else text)


def statements(text: str) -> list[tuple[str, dict]]:
    """(kind, fields) of each NAME (key value, ...) statement."""
    text, found, at = re.sub(r"--[^\n]*", "", text), [], 0
    while m := _STATEMENT.search(text, at):
        end = closing(text, m.end() - 1)
        body: dict[str, Any] = {}
        for part in _split(text[m.end() : end - 1]):
            name, _, value = part.partition(" ")
            body[name.strip().lower()] = _value(value)
        found.append((m[1].upper(), body))
        at = end
    return found


def parse_sql(text: str) -> Definitions:
    """DDL statements, table blocks, and YAML before the first statement."""
    found = Definitions()
    front = re.match(r"\s*---\n(.*?)\n---\s*\n", text, re.DOTALL)
    current: Model | None = None
    if front:
        found = native(yaml.safe_load(front[1]))
        current = found.models[-1] if found.models else None
        text = text[front.end() :]
    at = 0
    while m := _BLOCK.search(text, at):
        end = closing(text, m.end() - 1)
        found.models.append(_block(m[1], m[2], text[m.end() : end - 1]))
        at = end
    for kind, body in statements(_BLOCK.sub(lambda m: m[0], text) if not at else ""):
        if kind == "MODEL":
            current = native_model(body)
            found.models.append(current)
        elif kind == "PARAMETER":
            found.parameters.append(Parameter.of(body))
        elif kind == "METRIC" and current is None:
            found.metrics.append(Metric.of(metric_fields(body)))
        elif current is None:
            raise DefinitionError(f"{kind} {body.get('name')} stands before any MODEL")
        else:
            body = {k: [v] if k in ("filters", "measures", "dimensions") and not isinstance(v, list) else v for k, v in body.items()}
            target, made = {
                "DIMENSION": ("dimensions", lambda b: Dimension.of(dimension_fields(b))), "METRIC": ("metrics", lambda b: Metric.of(metric_fields(b))),
                "RELATIONSHIP": ("relationships", Relationship.of), "SEGMENT": ("segments", Segment.of), "PRE_AGGREGATION": ("pre_aggregations", PreAggregation.of),
            }[kind]
            getattr(current, target).append(made(body))
    return found


def _block(name: str, table: str, body: str) -> Model:
    model = Model(name, table=table)
    for line in (x.strip().rstrip(",") for x in body.splitlines()):
        if not line or line.startswith("--"):
            continue
        if key := re.match(r"primary\s+key\s*\((.*)\)$", line, re.IGNORECASE):
            names = [k.strip() for k in key[1].split(",")]
            model.primary_key = names[0] if len(names) == 1 else names
            continue
        m = re.match(r"(.*?)(?:\s+as\s+(\w+))?(?:\s*:\s*(\w+)(?:\s+grain\s+(\w+))?)?$", line, re.IGNORECASE)
        sql, alias, kind, grain = m[1].strip(), m[2], m[3], m[4]
        measured = Metric(alias or sql, sql=sql) if "(" in sql else None
        if measured and (measured.agg or re.search(r"(?i)\b(sum|count|avg|min|max)\s*\(", sql)):
            model.metrics.append(measured)
        else:
            model.dimensions.append(Dimension(alias or sql, kind or "categorical", None if sql == (alias or sql) else sql, granularity=grain))
    return model


def infer_relationships(models: list[Model]) -> None:
    """A foreign key ``x_id`` among the dimensions points to a model ``x`` or ``xs``."""
    names = {m.name: m for m in models}
    for m in models:
        for d in list(m.dimensions):
            if d.name.endswith("_id") and d.name not in m.key:
                target = next((names[n] for n in (d.name[:-3], f"{d.name[:-3]}s") if n in names and n != m.name), None)
                if target and target.key and not any(r.name == target.name for r in m.relationships):
                    m.relationships.append(Relationship(target.name, "many_to_one", foreign_key=d.name))


# other tools

_TIMES = {"time", "date", "timestamp", "datetime", "timestamp_ntz", "timestamp_ltz", "timestamp_tz"}
_NUMBERS = {"number", "numeric", "integer", "int", "bigint", "float", "double", "decimal"}


def kind(name: str | None) -> str:
    name = (name or "string").lower().split("(")[0]
    return "time" if name in _TIMES else "numeric" if name in _NUMBERS else "boolean" if name in ("boolean", "bool") else "categorical"


def cube(data: dict) -> Definitions:
    """Cube YAML. Joins are equalities of keys or stay SQL; shifted measures become comparisons."""
    found = Definitions()
    aggs = {"count": "count", "sum": "sum", "avg": "avg", "min": "min", "max": "max", "count_distinct": "count_distinct", "count_distinct_approx": "approx_count_distinct"}
    own = lambda s: re.sub(r"\{(?:CUBE|cube)\}\.", "{model}.", re.sub(r"\{(?:CUBE|cube)\.(\w+)\}", r"{model}.\1", s)) if s else s
    for c in data["cubes"]:
        model = Model(c["name"], table=c.get("sql_table"), sql=c.get("sql"), description=c.get("description"), extends=c.get("extends"))
        for d in c.get("dimensions") or []:
            if d.get("primary_key"):
                column = re.sub(r"\{(?:CUBE|cube)\}\.", "", d.get("sql") or d["name"])
                model.primary_key = [*model.key, column] if model.key else column
            model.dimensions.append(Dimension(d["name"], kind(d.get("type")), own(d.get("sql")), public=d.get("public", d.get("shown", True)), description=d.get("description")))
        for m in c.get("measures") or []:
            filters = [own(f["sql"]) for f in m.get("filters") or []] or None
            if m.get("rolling_window"):
                trailing = m["rolling_window"].get("trailing")
                base = Metric(f"{m['name']}_base", aggs.get(m["type"], "sum"), own(m.get("sql")), filters=filters)
                model.metrics += [base, Metric(m["name"], type="cumulative", sql=base.name, window=None if trailing in (None, "unbounded") else trailing)]
            elif m.get("type") in aggs:
                model.metrics.append(Metric(m["name"], aggs[m["type"]], own(m.get("sql")), filters=filters, description=m.get("description")))
            elif m.get("type") in ("number", "string", "time", "boolean"):
                model.metrics.append(Metric(m["name"], type="derived", sql=re.sub(r"\{(\w+)\}", r"\1", own(m.get("sql") or ""))))
            elif m.get("type") in ("running_total", "runningTotal"):
                model.metrics += [Metric(f"{m['name']}_base", "sum", own(m.get("sql"))), Metric(m["name"], type="cumulative", sql=f"{m['name']}_base")]
            else:
                raise DefinitionError(f"cube {c['name']}: measure type {m.get('type')} of {m['name']} can't be expressed")
        for s in c.get("segments") or []:
            model.segments.append(Segment(s["name"], own(s["sql"])))
        for j in c.get("joins") or []:
            keys = re.fullmatch(r"\s*\{(?:CUBE|cube)\}?\.(\w+)\}?\s*=\s*\{" + j["name"] + r"\}?\.(\w+)\}?\s*", j.get("sql", ""))
            type_ = {"many_to_one": "many_to_one", "belongsTo": "many_to_one", "belongs_to": "many_to_one", "one_to_many": "one_to_many", "hasMany": "one_to_many", "has_many": "one_to_many", "one_to_one": "one_to_one", "hasOne": "one_to_one", "has_one": "one_to_one"}[j.get("relationship", "many_to_one")]
            if keys:
                pair = (keys[1], keys[2]) if type_ != "one_to_many" else (keys[2], keys[1])
                model.relationships.append(Relationship(j["name"], type_, foreign_key=pair[0], primary_key=pair[1]))
            else:
                sql = re.sub(r"\{(?:CUBE|cube)\}?\.(\w+)\}?", r"{from}.\1", j["sql"])
                model.relationships.append(Relationship(j["name"], type_, sql=re.sub(r"\{" + j["name"] + r"\}?\.(\w+)\}?", r"{to}.\1", sql)))
        for p in c.get("pre_aggregations") or []:
            last = lambda x: str(x).split(".")[-1].strip("{}")
            model.pre_aggregations.append(PreAggregation(p["name"], [last(x) for x in p.get("measures") or []], [last(x) for x in p.get("dimensions") or []], last(p["time_dimension"]) if p.get("time_dimension") else None, p.get("granularity"), p.get("type", "rollup").replace("rollupLambda", "lambda"), p.get("partition_granularity")))
        found.models.append(model)
    return found


def metricflow(data: dict) -> Definitions:
    """MetricFlow semantic models and metrics. Entities become keys and relationships."""
    found = Definitions()
    aggs = {"sum": "sum", "count": "count", "average": "avg", "avg": "avg", "min": "min", "max": "max", "count_distinct": "count_distinct", "median": "median", "sum_boolean": "sum_boolean", "percentile": "percentile"}
    primary: dict[str, str] = {}
    for m in data.get("semantic_models") or []:
        for e in m.get("entities") or []:
            if e["type"] in ("primary", "unique"):
                primary.setdefault(e["name"], m["name"])
    for m in data.get("semantic_models") or []:
        table = re.sub(r"ref\(\s*'([^']+)'\s*\)", r"\1", m["model"]).strip()
        model = Model(m["name"], table=table, description=m.get("description"), default_time_dimension=(m.get("defaults") or {}).get("agg_time_dimension"))
        for e in m.get("entities") or []:
            column = e.get("expr") or e["name"]
            if e["type"] == "primary":
                model.primary_key = column
            elif e["type"] == "foreign" and e["name"] in primary and primary[e["name"]] != m["name"]:
                model.relationships.append(Relationship(primary[e["name"]], "many_to_one", foreign_key=column))
        for d in m.get("dimensions") or []:
            model.dimensions.append(Dimension(d["name"], kind(d["type"]), d.get("expr"), granularity=(d.get("type_params") or {}).get("time_granularity")))
        for x in m.get("measures") or []:
            semi = x.get("non_additive_dimension") or {}
            model.metrics.append(Metric(
                x["name"], aggs[x["agg"]], str(x["expr"]) if "expr" in x else None if x["agg"] == "count" else x["name"], percentile=(x.get("agg_params") or {}).get("percentile"),
                non_additive_dimension=semi.get("name"), non_additive_choice=semi.get("window_choice", "max"), non_additive_groupings=semi.get("window_groupings"),
            ))
        found.models.append(model)
    for x in data.get("metrics") or []:
        p = x.get("type_params") or {}
        name = lambda v: v["name"] if isinstance(v, dict) else v
        ref = lambda v: _measure_ref(found, name(v))
        if x["type"] == "simple":
            owner = next(m for m in found.models if m.metric(name(p["measure"])))
            if x["name"] != name(p["measure"]):
                base = vars(owner.metric(name(p["measure"]))) | {"name": x["name"]}
                if isinstance(p["measure"], dict) and p["measure"].get("fill_nulls_with") is not None:
                    base["fill_nulls_with"] = p["measure"]["fill_nulls_with"]
                owner.metrics.append(Metric(**base))
        elif x["type"] == "ratio":
            found.metrics.append(Metric(x["name"], type="ratio", numerator=ref(p["numerator"]), denominator=ref(p["denominator"])))
        elif x["type"] == "derived":
            found.metrics.append(Metric(x["name"], type="derived", sql=p["expr"]))
        elif x["type"] == "cumulative":
            more = p.get("cumulative_type_params") or {}
            window = more.get("window") or p.get("window")
            if isinstance(window, dict):
                window = f"{window['count']} {window['granularity']}"
            found.metrics.append(Metric(x["name"], type="cumulative", sql=ref(p["measure"]), window=window, grain_to_date=more.get("grain_to_date") or p.get("grain_to_date")))
        elif x["type"] == "conversion":
            raise DefinitionError(f"metric {x['name']}: conversion metrics name measures, not events, and can't be expressed")
    return found


def _measure_ref(found: Definitions, name: str) -> str:
    owner = next((m for m in found.models if m.metric(name)), None)
    return f"{owner.name}.{name}" if owner else name


def rill(data: dict) -> Definitions:
    name = data.get("name") or data.get("model") or data.get("table")
    model = Model(name, table=data.get("model") or data.get("table"), default_time_dimension=data.get("timeseries"), default_grain=data.get("smallest_time_grain") or None)
    for d in data.get("dimensions") or []:
        sql = d.get("expression") or d.get("column") or d.get("property")
        model.dimensions.append(Dimension(d.get("name") or d.get("column") or d.get("property"), "categorical", sql))
    if data.get("timeseries") and not model.dimension(data["timeseries"]):
        model.dimensions.append(Dimension(data["timeseries"], "time"))
    for m in data.get("measures") or []:
        if m.get("name"):
            model.metrics.append(Metric(m["name"], sql=m["expression"]))
    return Definitions([model])


def superset(data: dict) -> Definitions:
    model = Model(data["table_name"], table=data["table_name"] if not data.get("sql") else None, sql=data.get("sql"), default_time_dimension=data.get("main_dttm_col"))
    for c in data.get("columns") or []:
        model.dimensions.append(Dimension(c["column_name"], "time" if c.get("is_dttm") else kind(c.get("type")), c.get("expression") or None))
    for m in data.get("metrics") or []:
        model.metrics.append(Metric(m["metric_name"], sql=m["expression"]))
    return Definitions([model])


def snowflake(data: dict) -> Definitions:
    """Cortex semantic models."""
    found = Definitions()
    for t in data["tables"]:
        base = t["base_table"]
        key = (t.get("primary_key") or {}).get("columns") or []
        model = Model(t["name"], table=".".join(base[k] for k in ("database", "schema", "table") if base.get(k)), primary_key=key[0] if len(key) == 1 else key or None)
        model.dimensions = [Dimension(d["name"], kind(d.get("data_type")), d.get("expr"), synonyms=d.get("synonyms")) for d in t.get("dimensions") or []]
        model.dimensions += [Dimension(d["name"], "time", d.get("expr")) for d in t.get("time_dimensions") or []]
        for m in [*(t.get("measures") or []), *(t.get("facts") or []), *(t.get("metrics") or [])]:
            agg = m.get("default_aggregation")
            model.metrics.append(Metric(m["name"], agg, m.get("expr")) if agg in AGGREGATES else Metric(m["name"], sql=m.get("expr")))
        model.segments = [Segment(f["name"], f["expr"]) for f in t.get("filters") or []]
        found.models.append(model)
    names = {m.name: m for m in found.models}
    for r in data.get("relationships") or []:
        left, right = zip(*[(c["left_column"], c["right_column"]) for c in r["relationship_columns"]])
        names[r["left_table"]].relationships.append(Relationship(r["right_table"], r.get("relationship_type", "many_to_one"), foreign_key=list(left), primary_key=list(right)))
    return found


def hex_model(data: dict) -> Definitions:
    model = Model(data["id"], table=data.get("base_sql_table"), sql=data.get("base_sql_query"))
    for d in data.get("dimensions") or []:
        if d.get("unique") and not model.primary_key:
            model.primary_key = d["id"]
        model.dimensions.append(Dimension(d["id"], kind(d.get("type")), d.get("expr_sql")))
    for m in data.get("measures") or []:
        filters = [f["expr_sql"] for f in m.get("filters") or [] if isinstance(f, dict) and "expr_sql" in f] or None
        func = {"count": "count", "count_distinct": "count_distinct", "sum": "sum", "avg": "avg", "average": "avg", "min": "min", "max": "max", "median": "median", "stddev": "stddev", "variance": "variance"}.get(m.get("func") or "")
        model.metrics.append(Metric(m["id"], func, m.get("of") or m.get("func_sql"), filters=filters) if func else Metric(m["id"], sql=m.get("func_sql")))
    for r in data.get("relations") or []:
        keys = re.fullmatch(r"\s*(?:\$\{\w+\}\.)?(\w+)\s*=\s*\$?\{?\w+\}?\.\$?\{?(\w+)\}?\s*", r.get("join_sql", ""))
        model.relationships.append(Relationship(r.get("target") or r["id"], r.get("type", "many_to_one"), foreign_key=keys[1] if keys else None, primary_key=keys[2] if keys else None))
    return Definitions([model])


def expressions(data: dict) -> Definitions:
    """Models keyed by name whose fields are expressions like ``_.amount.sum()``."""
    found = Definitions()
    text = lambda v: v["expr"] if isinstance(v, dict) else v
    for name, m in data.items():
        if not isinstance(m, dict) or "table" not in m:
            continue
        model = Model(name, table=m["table"], primary_key=m.get("primary_key"), description=m.get("description"), default_time_dimension=m.get("time_dimension"))
        for d, v in (m.get("dimensions") or {}).items():
            timed = d == m.get("time_dimension") or (isinstance(v, dict) and v.get("is_time_dimension"))
            model.dimensions.append(Dimension(d, "time" if timed else "categorical", expression(text(v))))
        for x, v in (m.get("measures") or {}).items():
            model.metrics.append(Metric(x, sql=expression(text(v))))
        for j, v in (m.get("joins") or {}).items():
            keys = dict(foreign_key=(v.get("left_on") or v.get("with") or "").removeprefix("_.") or None, primary_key=v.get("right_on"))
            model.relationships.append(Relationship(v.get("model", j), {"one": "many_to_one", "many": "one_to_many", "cross": "cross"}.get(v.get("type", "one"), "many_to_one"), **keys))
        found.models.append(model)
    return found


# LookML

_LOOK = re.compile(r"\s*(?:#[^\n]*\s*)*")


def look_blocks(text: str, at: int = 0, inside: bool = False) -> tuple[list[tuple[str, str | None, Any]], int]:
    """(key, name, value) of ``key: value``, ``key: name { ... }`` and ``key: [ ... ]``; SQL values end with ;;"""
    found: list[tuple[str, str | None, Any]] = []
    while True:
        at = _LOOK.match(text, at).end()
        if at >= len(text):
            return found, at
        if text[at] == "}":
            if not inside:
                raise DefinitionError("a LookML block closes that was never opened")
            return found, at + 1
        key = re.compile(r"([\w+]+)\s*:\s*").match(text, at)
        if not key:
            raise DefinitionError(f"LookML not understood near {text[at : at + 40]!r}")
        at = key.end()
        block = re.compile(r"([\w+.]*)\s*\{").match(text, at)
        if key[1] in ("sql", "html") or key[1].startswith("sql_") or (key[1].startswith("expression") and ";;" in text[at:]):
            end = text.find(";;", at)
            if key[1].startswith("sql") and key[1] not in ("sql_always_where",) and end < 0:
                raise DefinitionError(f"LookML {key[1]} lacks ;;")
            found.append((key[1], None, text[at:end].strip()))
            at = end + 2
        elif block:
            value, at = look_blocks(text, block.end(), True)
            found.append((key[1], block[1] or None, value))
        elif text[at] == "[":
            end = text.index("]", at)
            pairs = re.findall(r"([\w.]+)\s*:\s*\"([^\"]*)\"", text[at:end])
            found.append((key[1], None, pairs or re.findall(r"[\w.]+", text[at + 1 : end])))
            at = end + 1
        else:
            value = re.compile(r'"((?:[^"\\]|\\.)*)"|([^\s}]+)').match(text, at)
            found.append((key[1], None, value[1] if value[1] is not None else value[2]))
            at = value.end()


def lookml(text: str) -> Definitions:
    """Views become models; explores of many-to-one or one-to-one joins become relationships."""
    found = Definitions()
    blocks, _ = look_blocks(text)
    for key, name, body in blocks:
        if key == "view":
            found.models.append(look_view(name, body))
    names = {m.name: m for m in found.models}
    for key, name, body in blocks:
        if key != "explore":
            continue
        for _, joined, join in (b for b in body if b[0] == "join"):
            fields_ = {k: v for k, _, v in join}
            on = re.fullmatch(r"\s*\$\{(\w+)\.(\w+)\}\s*=\s*\$\{(\w+)\.(\w+)\}\s*", fields_.get("sql_on", ""))
            kind_ = fields_.get("relationship", "many_to_one")
            if not on or not {on[1], on[3]} <= set(names):
                raise DefinitionError(f"explore {name}: the join of {joined} isn't an equality of two views' fields")
            (a, x), (b, y) = ((on[1], on[2]), (on[3], on[4])) if on[3] == joined else ((on[3], on[4]), (on[1], on[2]))
            column = lambda v, f: strip_table(names[v].dimension(f).sql) if names[v].dimension(f) and names[v].dimension(f).sql else f
            names[a].relationships.append(Relationship(b, kind_, foreign_key=column(a, x) if kind_ != "one_to_many" else column(b, y), primary_key=column(b, y) if kind_ != "one_to_many" else column(a, x)))
    return found


def strip_table(sql: str) -> str:
    return sql.replace("{model}.", "")


def look_view(name: str, body: list) -> Model:
    model = Model(name)
    sql = lambda s: re.sub(r"\$\{(\w+)\}", r"\1", re.sub(r"\$\{TABLE\}\.", "{model}.", s)) if s else None
    aggs = {"count": "count", "sum": "sum", "average": "avg", "min": "min", "max": "max", "count_distinct": "count_distinct", "median": "median", "sum_distinct": "sum", "average_distinct": "avg", "median_distinct": "median", "percentile": "percentile", "percentile_distinct": "percentile", "list": "string_agg"}
    for key, member, value in body:
        if key == "sql_table_name":
            model.table = value
        elif key == "derived_table":
            model.sql = next((v for k, _, v in value if k == "sql"), None)
        elif key in ("dimension", "dimension_group", "measure"):
            f = {k: v for k, _, v in value}
            hidden = f.get("hidden") == "yes"
            if key == "dimension":
                if f.get("primary_key") == "yes":
                    model.primary_key = strip_table(sql(f.get("sql")) or member)
                kind_ = {"yesno": "boolean"}.get(f.get("type", "string"), kind(f.get("type")))
                model.dimensions.append(Dimension(member, kind_, sql(f.get("sql")), public=not hidden))
            elif key == "dimension_group":
                x = sql(f.get("sql")) or member
                for frame in f.get("timeframes") or ["raw", "date", "week", "month", "quarter", "year"]:
                    if frame not in TIMEFRAMES:
                        raise DefinitionError(f"view {name}: unknown timeframe {frame}")
                    timed = "date_trunc" in TIMEFRAMES[frame] or TIMEFRAMES[frame] == "{x}"
                    model.dimensions.append(Dimension(f"{member}_{frame}", "time" if timed else "categorical", TIMEFRAMES[frame].replace("{x}", x)))
            else:
                filters = [look_filter(n, v) for n, v in f.get("filters") or []] or None
                if f.get("type") in aggs:
                    distinct = sql(f.get("sql_distinct_key")) if f["type"].endswith("_distinct") and f["type"] != "count_distinct" else None
                    share = float(f["percentile"]) / 100 if "percentile" in f else None
                    model.metrics.append(Metric(member, aggs[f["type"]], sql(f.get("sql")), filters=filters, distinct_key=distinct, percentile=share, public=not hidden))
                elif f.get("type") == "running_total":
                    model.metrics.append(Metric(member, type="cumulative", sql=sql(f["sql"])))
                elif f.get("type") in ("number", "string", "yesno", "date"):
                    model.metrics.append(Metric(member, type="derived", sql=sql(f["sql"]), public=not hidden))
                else:
                    raise DefinitionError(f"view {name}: measure type {f.get('type')} of {member} can't be expressed")
    if not model.table and not model.sql:
        model.table = name
    return model


def look_filter(name: str, value: str) -> str:
    """A filter expression: values by comma, -value, numbers with an operator, yes and no."""
    field_ = f"{{model}}.{name.split('.')[-1]}"
    if value.lower() in ("yes", "no"):
        return field_ if value.lower() == "yes" else f"NOT {field_}"
    parts = [p.strip() for p in value.split(",")]
    if len(parts) == 1 and (m := re.fullmatch(r"(>=|<=|<>|!=|>|<|=)?\s*(-?\d+(?:\.\d+)?)", parts[0])) and m[1]:
        return f"{field_} {m[1]} {m[2]}"
    quoted = lambda ps: ", ".join("'" + p.replace("'", "''") + "'" for p in ps)
    if parts[0].startswith("-"):
        return f"{field_} NOT IN ({quoted([p.lstrip('-') for p in parts])})"
    if any("%" in p for p in parts):
        return "(" + " OR ".join(f"{field_} LIKE {quoted([p])}" for p in parts) + ")"
    return f"{field_} IN ({quoted(parts)})"
