"""More definition formats: OSI, Omni, Tableau, TML, LDM, SML, AML, GSQL, TMDL and Malloy.

Each reader takes what maps onto models, dimensions, metrics and relationships. A measure
that can't be expressed isn't made: it is named in ``Definitions.unsupported`` with the
reason, and asking for it raises like any unknown metric."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from typing import Any

import yaml

from ..functions.translate import formula
from ..model import DefinitionError, Dimension, Metric, Model, Relationship
from ..plans.text import aggregate_calls, arguments, closing, dotted, outside_strings, replace_dotted
from .definitions import Definitions, infer_relationships, kind

#: Aggregates by the names that these formats give them.
AGGS = {
    "sum": "sum", "total": "sum", "avg": "avg", "average": "avg", "mean": "avg", "min": "min", "minimum": "min", "max": "max", "maximum": "max", "count": "count",
    "countd": "count_distinct", "count_distinct": "count_distinct", "count distinct": "count_distinct", "unique_count": "count_distinct", "median": "median",
    "stdev": "stddev", "stddev": "stddev", "std_deviation": "stddev", "stddev_samp": "stddev", "stddev_pop": "stddev_pop", "var": "variance", "variance": "variance",
    "approximate_count_distinct": "approx_count_distinct", "approx_count_distinct": "approx_count_distinct", "sum_boolean": "sum_boolean", "percentile": "percentile", "count non-null": "count", "stddev_samp": "stddev", "variance_samp": "variance", "var_samp": "variance",
}


def keys(names: list[str]) -> str | list[str] | None:
    return names[0] if len(names) == 1 else names or None


def join_of(to: str, type_: str, pairs: list[tuple[str, str]]) -> Relationship:
    """A relationship by pairs of (this model's column, the other's)."""
    here, there = [a for a, _ in pairs], [b for _, b in pairs]
    if type_ == "one_to_many":
        return Relationship(to, type_, foreign_key=there, primary_key=here)
    return Relationship(to, type_, foreign_key=here, primary_key=there)


def equalities(condition: str) -> list[tuple[tuple[str, str], tuple[str, str]]] | None:
    """``a.x = b.y AND ...`` as pairs; None if it is anything else."""
    found = []
    for part in re.split(r"(?i)\s+and\s+", condition.strip().strip("()")):
        m = re.fullmatch(r"\(?\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*\)?", part.strip())
        if not m:
            return None
        found.append(((m[1], m[2]), (m[3], m[4])))
    return found


def relate(models: dict[str, Model], left: str, right: str, condition: str, type_: str) -> None:
    """A join of two models by its condition, as keys where it is equalities."""
    pairs = equalities(condition)
    if pairs is None:
        sql = replace_dotted(condition, lambda a, b: {left: f"{{from}}.{b}", right: f"{{to}}.{b}"}.get(a))
        models[left].relationships.append(Relationship(right, type_, sql=sql))
        return
    ordered = [(a[1], b[1]) if a[0] == left else (b[1], a[1]) for a, b in pairs]
    models[left].relationships.append(join_of(right, type_, ordered))


def place(found: Definitions, name: str, sql: str, models: dict[str, Model], **more) -> None:
    """A metric over one model's columns goes to that model, one over several to the graph."""
    owners = {a for a, _ in dotted(sql) if a in models}
    if len(owners) == 1 and not any(models[o].metric(name) for o in owners):
        models[owners.pop()].metrics.append(Metric(name, sql=sql, **more))
    else:
        found.metrics.append(Metric(name, type="derived", sql=sql, **more))


# OSI


def osi(data: dict) -> Definitions:
    def text(expression: Any) -> str:
        if isinstance(expression, str):
            return expression
        options = {d["dialect"]: d["expression"] for d in expression["dialects"]}
        return next((options[d] for d in ("SPARK", "DATABRICKS", "ANSI_SQL") if d in options), next(iter(options.values())))

    found = Definitions()
    given = data["semantic_model"]
    for m in given if isinstance(given, list) else [given]:
        models: dict[str, Model] = {}
        for d in m.get("datasets") or []:
            source = d["source"]
            model = Model(d["name"], sql=source if " " in source.strip() else None, table=None if " " in source.strip() else source, primary_key=keys(d.get("primary_key") or []), description=d.get("description"))
            model.unique_keys = d.get("unique_keys")
            for f in d.get("fields") or []:
                timed = bool((f.get("dimension") or {}).get("is_time"))
                model.dimensions.append(Dimension(f["name"], "time" if timed else "categorical", text(f["expression"]), description=f.get("description"), label=f.get("label")))
            models[model.name] = model
        for r in m.get("relationships") or []:
            models[r["from"]].relationships.append(join_of(r["to"], "many_to_one", list(zip(r["from_columns"], r["to_columns"]))))
        found.models += models.values()
        for x in m.get("metrics") or []:
            place(found, x["name"], text(x["expression"]), models, description=x.get("description"))
    return found


# Omni


def omni_sql(sql: str | None, view: str) -> str | None:
    if sql is None:
        return None
    sql = sql.replace("${TABLE}.", "{model}.")
    sql = re.sub(r"\$\{(\w+)\.(\w+)\}", lambda m: f"{{model}}.{m[2]}" if m[1] == view else f"{m[1]}.{m[2]}", sql)
    return re.sub(r"\$\{(\w+)\}", r"\1", sql)


def omni_filter(field: str, tests: dict) -> str:
    quote = lambda v: str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    out = []
    for test, value in tests.items():
        many = value if isinstance(value, list) else [value]
        column = f"{{model}}.{field}"
        if test in ("is", "not"):
            if value is None or isinstance(value, bool):
                out.append(f"{column} IS {'NOT ' if test == 'not' else ''}{'NULL' if value is None else str(value).upper()}")
            else:
                out.append(f"{column} {'NOT ' if test == 'not' else ''}IN ({', '.join(map(quote, many))})")
        elif test in ("greater_than", "less_than", "greater_than_or_equal_to", "less_than_or_equal_to"):
            sign = {"greater_than": ">", "less_than": "<", "greater_than_or_equal_to": ">=", "less_than_or_equal_to": "<="}[test]
            out.append(f"{column} {sign} {quote(value)}")
        elif test in ("contains", "starts_with", "ends_with"):
            name = {"contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}[test]
            out.append("(" + " OR ".join(f"{name}({column}, {quote(v)})" for v in many) + ")")
        else:
            raise DefinitionError(f"filter {test} of {field} can't be expressed")
    return " AND ".join(out)


def omni_view(data: dict, name: str | None = None) -> Definitions:
    found = Definitions()
    name = data.get("name") or name or data.get("table_name")
    table = ".".join(x for x in (data.get("catalog"), data.get("schema"), data.get("table_name") or name) if x)
    model = Model(name, table=None if data.get("sql") else table, sql=data.get("sql"), description=data.get("description"))
    for d, v in (data.get("dimensions") or {}).items():
        v = v or {}
        if v.get("primary_key"):
            model.primary_key = keys([*model.key, d])
        model.dimensions.append(Dimension(d, kind(v.get("type")) if v.get("type") else "time" if v.get("timeframes") else "categorical", omni_sql(v.get("sql"), name), public=not v.get("hidden"), label=v.get("label")))
    for x, v in (data.get("measures") or {}).items():
        try:
            filters = [omni_filter(f.split(".")[-1], t) for f, t in (v.get("filters") or {}).items()] or None
        except DefinitionError as e:
            found.unsupported.append(f"{name}.{x}: {e}")
            continue
        sql, agg = omni_sql(v.get("sql"), name), v.get("aggregate_type")
        if agg and agg not in AGGS:
            found.unsupported.append(f"{name}.{x}: aggregate {agg} can't be expressed")
        elif agg:
            model.metrics.append(Metric(x, AGGS[agg], None if agg == "count" else sql, filters=filters, label=v.get("label"), description=v.get("description")))
        else:
            model.metrics.append(Metric(x, type="derived", sql=(sql or "").replace("{model}.", f"{name}."), label=v.get("label")))
    found.models.append(model)
    return found


def omni_relationships(relationships: list[dict], models: list[Model]) -> None:
    named = {m.name: m for m in models}
    for r in relationships:
        left, right = r["join_from_view"], r["join_to_view"]
        if left in named and right in named:
            type_ = r.get("relationship_type", "many_to_one")
            relate(named, left, right, re.sub(r"\$\{(\w+)\.(\w+)\}", r"\1.\2", r["on_sql"]), "many_to_one" if type_ == "assumed_many_to_one" else type_)


# Tableau


def tableau(text: str) -> Definitions:
    """Data sources of a .tds or .twb: one model each; a join tree becomes the model's SQL."""
    found = Definitions()
    root = ET.fromstring(text)
    sources = [root] if root.tag == "datasource" else [s for s in root.iter("datasource") if s.find("connection") is not None and s.get("name") != "Parameters"]
    for source in sources:
        relation = source.find("connection/relation")
        if relation is None:
            relation = next(source.iter("relation"), None)
        if relation is None:
            continue
        name = re.sub(r"\W+", "_", source.get("formatted-name") or source.get("caption") or source.get("name") or relation.get("name"))
        model = Model(name, **tableau_relation(relation))
        columns = [c for c in source.findall("column") if not c.get("name", "").startswith("[:")]
        named = {c.get("name"): c for c in columns}
        plain = lambda n: re.sub(r"\W+", "_", (named[n].get("caption") or n) if n.startswith("[Calculation") and n in named else n).strip("_")  # noqa: E731, B023
        for c in columns:
            calculation = c.find("calculation")
            raw = calculation.get("formula") if calculation is not None else None
            member = plain(c.get("name"))
            try:
                sql = tableau_formula(re.sub(r"\[[^\]]+\]", lambda m: f"[{plain(m[0])}]", raw)) if raw else None  # noqa: B023
            except DefinitionError as e:
                found.unsupported.append(f"{name}.{member}: {e}")
                continue
            label, public = c.get("caption"), c.get("hidden") != "true"
            if c.get("role") == "measure":
                if sql and aggregate_calls(sql):
                    model.metrics.append(Metric(member, type="derived", sql=sql, label=label, public=public))
                    continue
                agg = (c.get("aggregation") or "sum").lower()
                if agg not in AGGS:
                    found.unsupported.append(f"{name}.{member}: aggregate {agg} can't be expressed")
                    continue
                model.metrics.append(Metric(member, AGGS[agg], sql or member, label=label, public=public))
            else:
                timed = c.get("datatype") in ("date", "datetime")
                model.dimensions.append(Dimension(member, "time" if timed else "numeric" if c.get("datatype") in ("integer", "real") else "boolean" if c.get("datatype") == "boolean" else "categorical", sql or member, label=label, public=public))
        found.models.append(model)
    return found


def tableau_formula(text: str) -> str:
    if re.search(r"\{\s*(FIXED|INCLUDE|EXCLUDE)\b", text, re.IGNORECASE):
        raise DefinitionError("level-of-detail expressions can't be expressed")
    if re.search(r"\b(WINDOW_\w+|RUNNING_\w+|LOOKUP|INDEX|RANK\w*|TOTAL|SIZE|FIRST|LAST)\s*\(", text, re.IGNORECASE):
        raise DefinitionError("table calculations can't be part of a definition")
    return formula(text).replace("`", "")


def tableau_relation(relation: ET.Element) -> dict[str, str]:
    """A table's name, or SQL of a query, join or union."""
    table = lambda r: r.get("table", f"[{r.get('name')}]").replace("[", "").replace("]", "")

    def sql(r: ET.Element) -> str:
        how = r.get("type")
        if how == "table":
            return f"{table(r)} AS {r.get('name')}"
        if how == "text":
            return f"({(r.text or '').strip()}) AS {r.get('name')}"
        parts = [x for x in r if x.tag == "relation"]
        if how == "join":
            clause = r.find("clause/expression")
            return f"{sql(parts[0])} {r.get('join', 'inner').upper()} JOIN {sql(parts[1])} ON {condition(clause)}"
        if how == "union":
            inner = " UNION ALL ".join(f"SELECT * FROM {sql(p)}" for p in parts)
            return f"({inner}) AS {re.sub(r'[^A-Za-z0-9_]+', '_', r.get('name', 'united'))}"
        raise DefinitionError(f"a relation of type {how} can't be expressed")

    def condition(e: ET.Element) -> str:
        inner = [x for x in e if x.tag == "expression"]
        if not inner:
            return e.get("op").replace("[", "").replace("]", "")
        return f"({f' {e.get("op")} '.join(condition(x) for x in inner)})"

    if relation.get("type") == "table":
        return {"table": table(relation)}
    if relation.get("type") == "text":
        return {"sql": (relation.text or "").strip()}
    return {"sql": f"SELECT * FROM {sql(relation)}"}


# TML


def tml(data: dict) -> Definitions:
    """Tables, and models or worksheets over tables."""
    found = Definitions()
    if "table" in data:
        t = data["table"]
        model = Model(t["name"], table=".".join(x for x in (t.get("db"), t.get("schema"), t.get("db_table") or t["name"]) if x), description=t.get("description"))
        for c in t.get("columns") or []:
            tml_column(found, model, c["name"], c, c.get("db_column_name") or c["name"])
        for j in t.get("joins_with") or []:
            target = j["destination"]["name"] if isinstance(j.get("destination"), dict) else j.get("destination")
            relate({model.name: model}, model.name, target, tml_sql(j.get("on") or j[True]), "one_to_one" if j.get("is_one_to_one") else "many_to_one")
        found.models.append(model)
        return found
    body = data.get("model") or data.get("worksheet")
    tables = body.get("model_tables") or body.get("tables") or []
    models = {t.get("alias") or t["name"]: Model(t.get("alias") or t["name"], table=t.get("fqn") if "." in str(t.get("fqn", "")) else t["name"]) for t in tables}
    paths = {p["id"]: p["table"] for p in body.get("table_paths") or []}
    kinds = {"MANY_TO_ONE": "many_to_one", "ONE_TO_ONE": "one_to_one", "ONE_TO_MANY": "one_to_many", "MANY_TO_MANY": "many_to_many"}
    on = lambda j: tml_sql(j.get("on") or j.get(True) or "")  # noqa: E731  a bare ``on`` is a truth value in YAML
    for t in tables:
        for j in t.get("joins") or []:
            if on(j):
                relate(models, t.get("alias") or t["name"], j["with"], on(j), kinds[j.get("cardinality", "MANY_TO_ONE")])
    for j in body.get("joins") or []:
        if on(j):
            relate(models, j["source"], j["destination"], on(j), "one_to_one" if j.get("is_one_to_one") else "many_to_one")
    formulas = {f.get("id") or f["name"]: f["expr"] for f in body.get("formulas") or []}
    for c in body.get("columns") or body.get("worksheet_columns") or []:
        if "formula_id" in c:
            sql = replace_dotted(tml_sql(formulas[c["formula_id"]]), lambda a, b: f"{paths.get(a, a)}.{b}")
            owners = {a for a, _ in dotted(sql) if a in models}
            if len(owners) != 1:
                found.unsupported.append(f"{c['name']}: a formula over {len(owners)} tables can't be expressed")
                continue
            owner = owners.pop()
            tml_column(found, models[owner], c["name"], c, replace_dotted(sql, lambda a, b, owner=owner: f"{{model}}.{b}" if a == owner else None))
        elif "column_id" not in c:
            found.unsupported.append(f"{c.get('name')}: a column without an id can't be expressed")
        else:
            path, _, column = c["column_id"].partition("::")
            tml_column(found, models[paths.get(path, path)], c["name"], c, column)
    found.models += models.values()
    return found


def tml_sql(text: str) -> str:
    return re.sub(r"\[([^\]:]+)::([^\]]+)\]", r"\1.\2", text)


def tml_column(found: Definitions, model: Model, name: str, column: dict, sql: str) -> None:
    properties = column.get("properties") or {}
    name = re.sub(r"\W+", "_", name)
    if properties.get("column_type") == "MEASURE":
        agg = (properties.get("aggregation") or "SUM").lower()
        if aggregate_calls(sql):
            model.metrics.append(Metric(name, type="derived", sql=sql, description=column.get("description")))
        elif agg in AGGS:
            model.metrics.append(Metric(name, AGGS[agg], sql, description=column.get("description")))
        else:
            found.unsupported.append(f"{model.name}.{name}: aggregate {agg} can't be expressed")
        return
    type_ = column.get("data_type") or (column.get("db_column_properties") or {}).get("data_type") or ""
    timed = type_.upper().startswith(("DATE", "TIME")) or "default_date_bucket" in properties
    numeric = type_.upper().startswith(("INT", "DOUBLE", "FLOAT", "NUM"))
    model.dimensions.append(Dimension(name, "time" if timed else "boolean" if type_.upper().startswith("BOOL") else "numeric" if numeric else "categorical", sql, description=column.get("description")))


# LDM


def ldm(data: dict) -> Definitions:
    """Logical data model: datasets with attributes, facts and references."""
    found = Definitions()
    body = data.get("ldm") or data
    column_of: dict[tuple[str, str], str] = {}
    for d in body["datasets"]:
        for a in d.get("attributes") or []:
            column_of[d["id"], a["id"]] = a.get("sourceColumn") or a["id"]
    for d in body["datasets"]:
        table = d.get("dataSourceTableId") or d["id"]
        table = table.get("id") if isinstance(table, dict) else table
        query = d.get("sql")
        query = query.get("statement") if isinstance(query, dict) else query
        model = Model(d["id"], table=None if query else table.split(":")[-1].replace("/", "."), sql=query, description=d.get("description"))
        model.primary_key = keys([column_of.get((d["id"], g["id"]), g["id"]) for g in d.get("grain") or [] if g.get("type", "attribute") == "attribute"])
        for a in d.get("attributes") or []:
            type_ = {"NUMERIC": "numeric", "INT": "numeric", "BOOLEAN": "boolean", "DATE": "time", "TIMESTAMP": "time"}.get(a.get("dataType", ""), "categorical")
            model.dimensions.append(Dimension(a["id"], type_, column_of[d["id"], a["id"]], label=a.get("title")))
        for f in d.get("facts") or []:
            model.metrics.append(Metric(f["id"], "sum", f.get("sourceColumn") or f["id"], label=f.get("title")))
        for r in d.get("references") or []:
            to = r["identifier"]["id"]
            pairs = [(s["column"], column_of.get((to, s["target"]["id"]), s["target"]["id"])) for s in r.get("sources") or []]
            if not pairs:
                target = next((x for x in body["datasets"] if x["id"] == to), None)
                if target is None:  # a date instance: the column itself is the date
                    model.dimensions += [Dimension(c, "time", c) for c in r.get("sourceColumns") or []]
                    continue
                grain = [column_of.get((to, g["id"]), g["id"]) for g in target.get("grain") or []]
                pairs = list(zip(r.get("sourceColumns") or [], grain))
            elif not any(x["id"] == to for x in body["datasets"]):
                model.dimensions += [Dimension(a, "time", a) for a, _ in pairs]
                continue
            model.relationships.append(join_of(to, "many_to_many" if r.get("multivalue") else "many_to_one", pairs))
        found.models.append(model)
    return found


# SML


def sml(documents: list[dict]) -> Definitions:
    """Objects of a repository: datasets, dimensions, metrics, calculations, models."""
    found = Definitions()
    by_type: dict[str, list[dict]] = {}
    for d in documents:
        by_type.setdefault(d["object_type"], []).append(d)
    models = {d["unique_name"]: Model(d["unique_name"], table=None if d.get("sql") else d.get("table"), sql=d.get("sql"), description=d.get("description")) for d in by_type.get("dataset", [])}
    types = {(d["unique_name"], c["name"]): c.get("data_type") for d in by_type.get("dataset", []) for c in d.get("columns") or []}
    levels: dict[tuple[str, str], tuple[str, list[str]]] = {}
    for d in by_type.get("dimension", []):
        for a in (x for x in d.get("level_attributes") or [] if x.get("dataset") in models):
            levels[d["unique_name"], a["unique_name"]] = a["dataset"], a.get("key_columns") or [a["name_column"]]
            a.setdefault("name_column", levels[d["unique_name"], a["unique_name"]][1][0])
            model = models[a["dataset"]]
            if model.dimension(a["unique_name"]) is None:
                timed = d.get("type") == "time" or kind(types.get((a["dataset"], a["name_column"]))) == "time"
                model.dimensions.append(Dimension(a["unique_name"], "time" if timed else kind(types.get((a["dataset"], a["name_column"]))), a["name_column"], label=a.get("label")))
        for level in (x for h in d.get("hierarchies") or [] for x in h.get("levels") or []):
            for x in [*(level.get("metrics") or []), *(level.get("secondary_attributes") or [])]:
                if "calculation_method" in x:
                    sml_metric(found, models, x)
                elif x.get("dataset") in models:
                    models[x["dataset"]].dimensions.append(Dimension(x["unique_name"], "categorical", x.get("name_column"), label=x.get("label")))
    for holder in [*by_type.get("dimension", []), *by_type.get("model", [])]:
        for r in holder.get("relationships") or []:
            target = levels.get((r["to"].get("dimension"), r["to"].get("level")))
            here = r["from"]["dataset"]
            if target is None or target[0] == here:  # a dimension of the fact itself
                continue
            models[here].relationships.append(join_of(target[0], "many_to_one", list(zip(r["from"]["join_columns"], target[1]))))
            models[target[0]].primary_key = keys(target[1])
    for x in by_type.get("metric", []):
        sml_metric(found, models, x)
    for x in by_type.get("metric_calc", []):
        sql = re.sub(r"\[Measures\]\.\[(\w+)\]", r"\1", x["expression"], flags=re.IGNORECASE)
        if re.search(r"[\[\]]|\b(IIF|ParallelPeriod|CurrentMember|Aggregate)\b", sql, re.IGNORECASE):
            found.unsupported.append(f"{x['unique_name']}: the expression {x['expression']} can't be expressed")
        else:
            found.metrics.append(Metric(x["unique_name"], type="derived", sql=sql, label=x.get("label")))
    found.models += models.values()
    return found


def sml_metric(found: Definitions, models: dict[str, Model], x: dict) -> None:
    method = x["calculation_method"].lower().replace("estimated count distinct", "approx_count_distinct").replace("stddev_pop", "stddev_pop")
    if method not in AGGS:
        found.unsupported.append(f"{x['unique_name']}: method {method} can't be expressed")
        return
    if x.get("dataset") not in models:
        found.unsupported.append(f"{x['unique_name']}: there is no dataset {x.get('dataset')}")
        return
    models[x["dataset"]].metrics.append(Metric(x["unique_name"], AGGS[method], x["column"], label=x.get("label")))


# AML


def aml_block(text: str, at: int) -> tuple[list[tuple[str, str, Any]], int]:
    """(key, name, value) of a ``{ ... }`` body that starts at ``at``: ``key: value``, ``key name { ... }``."""
    found: list[tuple[str, str, Any]] = []
    head = re.compile(r"(\w+)\s*(?::\s*|\s+(\w+)\s*(?=\{))")
    while True:
        at = re.compile(r"(?:\s|,|//[^\n]*)*").match(text, at).end()
        if at >= len(text) or text[at] == "}":
            return found, at + 1
        m = head.match(text, at)
        if not m:
            raise DefinitionError(f"AML not understood near {text[at : at + 40]!r}")
        at = m.end()
        if m[2]:
            value, at = aml_block(text, text.index("{", at) + 1)
            found.append((m[1], m[2], value))
        elif text.startswith("@", at):
            end = text.index(";;", at)
            found.append((m[1], "", re.sub(r"^@\w+\s*", "", text[at:end]).strip()))
            at = end + 2
        elif text[at] == "[":
            depth, end = 0, at
            while True:
                depth += (text[end] in "[({") - (text[end] in "])}")
                end += 1
                if depth == 0:
                    break
            found.append((m[1], "", text[at:end]))
            at = end
        elif nested := re.compile(r"(\w+)\s*\{").match(text, at):
            value, at = aml_block(text, nested.end())
            found.append((m[1], nested[1], value))
        else:
            value = re.compile(r"'((?:[^'\\]|\\.)*)'|\"([^\"]*)\"|(\w+\([^)]*\)|[^\s,}]+)").match(text, at)
            found.append((m[1], "", next(x for x in value.groups() if x is not None).strip()))
            at = value.end()


def aml(text: str, known: list[Model] | None = None) -> Definitions:
    """Model, Relationship and Dataset blocks; ``known`` models of other files may be joined."""
    found, relationships, joins = Definitions(), {}, []
    at = 0
    while m := re.compile(r"\b(Model|Relationship|Dataset)\s+(\w+)\s*\{").search(text, at):
        body, at = aml_block(text, m.end())
        if m[1] == "Model":
            found.models.append(aml_model(found, m[2], body))
        elif m[1] == "Relationship":
            f = {k: v for k, _, v in body}
            ends = [aml_end(f[k]) for k in ("from", "to")]
            relationships[m[2]] = (ends[0], ends[1], f["type"])
        else:
            joins.append(next((v for k, _, v in body if k == "relationships"), ""))
    signs = {">": "many_to_one", "-": "one_to_one", "<": "one_to_many"}
    wanted = [] if joins else list(relationships.values())
    for text_ in joins:
        for m in re.finditer(r"rel(?:ationship)?\(\s*(\w+)\s*,\s*(true|false)\s*\)", text_):
            if m[2] == "true" and m[1] in relationships:
                wanted.append(relationships[m[1]])
        for m in re.finditer(r"rel_expr:\s*(\w+)\.(\w+)\s*([<>-])\s*(\w+)\.(\w+)\s*(?:,\s*active:\s*(true|false))?", text_):
            if m[6] != "false":
                wanted.append(((m[1], m[2]), (m[4], m[5]), signs[m[3]]))
        for m in re.finditer(r"type:\s*'(\w+)'\s*from:\s*r\((\w+)\.(\w+)\)\s*to:\s*r\((\w+)\.(\w+)\)", text_):
            wanted.append(((m[2], m[3]), (m[4], m[5]), m[1]))
    models = {x.name: x for x in [*(known or []), *found.models]}
    for (a, x), (b, y), type_ in wanted:
        if a in models and b in models and not any(r.name == b for r in models[a].relationships):
            models[a].relationships.append(join_of(b, type_, [(x, y)]))
    return found


def aml_end(value: Any) -> tuple[str, str]:
    """``r(model.field)``, or a block with model and field."""
    if isinstance(value, str):
        return re.search(r"(\w+)\.(\w+)", value).groups()
    f = {k: v for k, _, v in value}
    return f["model"], f["field"]


def aml_model(found: Definitions, name: str, body: list) -> Model:
    f = {k: v for k, n, v in body if not n}
    query = f.get("query")
    model = Model(name, table=None if query else f.get("table_name", name).strip('"').replace('"', ""), sql=query, description=f.get("description"))
    members = {n for k, n, _ in body if k == "measure"}
    sql = lambda s: re.sub(r"\{\{\s*(?:#SOURCE\.|#THIS\.)?(\w+)\s*\}\}", lambda m: m[1], s) if s else None
    for key, member, value in body:
        if key not in ("dimension", "measure"):
            continue
        v = {k: x for k, _, x in value}
        if key == "dimension":
            if v.get("primary_key") == "true":
                model.primary_key = keys([*model.key, member])
            type_ = {"number": "numeric", "date": "time", "datetime": "time", "truefalse": "boolean"}.get(v.get("type", "text"), "categorical")
            model.dimensions.append(Dimension(member, type_, sql(v.get("definition")), label=v.get("label"), public=v.get("hidden") != "true"))
            continue
        agg, expression = (v.get("aggregation_type") or "custom").replace(" ", "_"), sql(v.get("definition"))
        if agg in AGGS:
            model.metrics.append(Metric(member, AGGS[agg], expression, label=v.get("label")))
        elif agg == "custom" and expression and (aggregate_calls(expression) or members & set(re.findall(r"\w+", expression))):
            model.metrics.append(Metric(member, type="derived", sql=expression, label=v.get("label")))
        else:
            found.unsupported.append(f"{name}.{member}: aggregation {agg} can't be expressed")
    return model


# GSQL


def gsql(text: str) -> Definitions:
    """``table name ( columns, joins, expressions )``; expressions with aggregates are metrics."""
    found = Definitions()
    text = outside_strings(text, lambda s: re.sub(r"--[^\n]*", "", s))
    aliased: list[Model] = []
    at = 0
    while m := re.compile(r"(?im)^\s*table\s+([\w.]+)\s*(?:as\s*)?\(").search(text, at):
        end = closing(text, m.end() - 1)
        name = m[1].split(".")[-1]
        model, joins, exprs = Model(name, table=m[1]), [], {}
        for line in (re.sub(r"\s+#.*$", "", x).strip().rstrip(",") for x in text[m.end() : end - 1].splitlines()):
            if not line:
                continue
            if j := re.match(r"(?i)join\s+(one|many)\s+(\w+)(?:\s+as\s+(\w+))?\s+on\s+(.+)$", line):
                joins.append((j[1].lower(), j[2], j[3], j[4]))
            elif c := re.match(r"(?i)primary_?key\s*:?\s*\(?([\w, ]+)\)?$", line):
                model.primary_key = keys([k.strip() for k in c[1].split(",")])
            elif e := re.match(r"(\w+)\s*:\s*(.+)$", line):
                exprs[e[1]] = e[2]
            elif e := re.match(r"(?i)(.+\S)\s+as\s+(\w+)$", line):
                exprs[e[2]] = e[1]
            elif c := re.match(r"(\w+)\s+(\w+)", line):
                type_ = re.sub(r"\d+$", "", c[2].lower())
                model.dimensions.append(Dimension(c[1], kind({"bigint": "int", "string": "string"}.get(type_, type_)), c[1]))
        if not model.primary_key:
            names = [d.name for d in model.dimensions]
            model.primary_key = next((k for k in (f"{name.rstrip('s')}_id", f"{name}_id", "id") if k in names), None)
        rows = {n: s for n, s in exprs.items() if not aggregate_calls(s)}
        measures = {n for n in exprs if n not in rows}
        while grown := {n for n, s in rows.items() if n not in measures and measures & set(re.findall(r"\w+", re.sub(r"'[^']*'", "", s)))}:
            measures |= grown
        plain = {n: f"({s})" for n, s in rows.items() if n not in measures}
        inline = lambda s: re.sub(r"(?<![\w.'])\b(\w+)\b(?![\w'(])", lambda w: plain.get(w[1], w[0]), s)  # noqa: E731, B023
        for n, s in exprs.items():
            s = inline(s) if n in measures else s
            if n in measures:
                made = Metric(n, sql=s)
                model.metrics.append(made if made.agg else Metric(n, type="derived", sql=s))
            else:
                test = re.search(r"(?i)(=|<|>|\bis\b|\blike\b|\bin\b)", s) is not None and "case" not in s.lower()
                model.dimensions.append(Dimension(n, "boolean" if test else "categorical", s))
        found.models.append(model)
        for many, target, alias, condition in joins:
            role = alias or target
            if alias:
                aliased.append(Model(alias, table=target))
            sides = re.fullmatch(r"(?:(\w+)\.)?(\w+)\s*=\s*(?:(\w+)\.)?(\w+)", condition.strip())
            if not sides:
                raise DefinitionError(f"table {name}: the join on {condition} isn't an equality")
            (a, x), (b, y) = (sides[1] or name, sides[2]), (sides[3] or name, sides[4])
            pair = (x, y) if b == role else (y, x)
            model.relationships.append(join_of(role, "one_to_many" if many == "many" else "many_to_one", [pair]))
        at = end
    named = {m.name: m for m in found.models}
    for role in aliased:  # a table in another role, with the same fields
        base = named.get(role.table)
        if base and role.name not in named:
            found.models.append(Model(role.name, table=base.table, primary_key=base.primary_key, dimensions=list(base.dimensions), metrics=list(base.metrics)))
    return found


# TMDL and DAX

_DAX = {"SUM": "sum", "AVERAGE": "avg", "MIN": "min", "MAX": "max", "DISTINCTCOUNT": "count_distinct", "COUNT": "count", "COUNTA": "count", "MEDIAN": "median", "STDEV.S": "stddev", "STDEV.P": "stddev_pop", "VAR.S": "variance", "VAR.P": "variance_pop"}


def tmdl(text: str) -> Definitions:
    """Tables with columns and measures, and relationships; indentation nests."""
    found = Definitions()
    relations, model, member = [], None, None
    lines = [x for x in text.splitlines() if x.strip() and not x.strip().startswith(("///", "#", "//"))]
    name = r"(?:'((?:[^']|'')+)'|([\w.-]+))"
    at = 0
    while at < len(lines):
        line, depth = lines[at].strip(), indent(lines[at])
        at += 1
        if m := re.match(rf"table\s+{name}$", line):
            model, member = Model(word(m[1] or m[2]), table=word(m[1] or m[2])), None
            found.models.append(model)
        elif m := re.match(rf"relationship\s+{name}$", line):
            member = {"isActive": True}
            relations.append(member)
        elif model and (m := re.match(rf"column\s+{name}(?:\s*=\s*(.+))?$", line)):
            member = Dimension(word(m[1] or m[2]), sql=word(m[1] or m[2]))
            if m[3]:
                sql = dax(m[3], model)
                if sql is None:
                    found.unsupported.append(f"{model.name}.{member.name}: {m[3]} can't be expressed")
                    continue
                member.sql = sql
            model.dimensions.append(member)
        elif model and (m := re.match(rf"measure\s+{name}\s*=\s*(.*)$", line)):
            body = m[3].strip("` ")
            while at < len(lines) and indent(lines[at]) > depth and not re.match(r"\s*(formatString|displayFolder|lineageTag|description|isHidden|annotation)\b", lines[at]):
                body += " " + lines[at].strip().strip("`")
                at += 1
            measure = word(m[1] or m[2])
            sql = dax(body.strip(), model)
            if sql is None:
                found.unsupported.append(f"{model.name}.{measure}: {body.strip()} can't be expressed")
            else:
                made = Metric(measure, sql=sql)
                model.metrics.append(made if made.agg else Metric(measure, type="derived", sql=sql))
            member = None
        elif isinstance(member, dict) and (m := re.match(r"(\w+)(?:\s*:\s*(.+))?$", line)):
            member[m[1]] = m[2] if m[2] is not None else True
        elif isinstance(member, Dimension) and (m := re.match(r"(\w+)(?:\s*:\s*(.+))?$", line)):
            if m[1] == "dataType":
                member.type = {"int64": "numeric", "double": "numeric", "decimal": "numeric", "date": "time", "dateTime": "time", "boolean": "boolean"}.get(m[2].strip(), "categorical")
            elif m[1] == "isKey":
                model.primary_key = keys([*model.key, member.name])
            elif m[1] == "sourceColumn":
                member.sql = m[2].strip().strip("[]")
            elif m[1] == "isHidden":
                member.public = False
    tmdl_relations(found.models, relations)
    return found


def tmdl_relations(models: list[Model], relations: list[dict]) -> None:
    named = {m.name: m for m in models}
    ends = lambda s: tuple(word(x) for x in re.fullmatch(r"'?([^'\[.]+)'?(?:\.'?|\[)([^\]']+)[\]']?", s.strip()).groups())
    for r in relations:
        if str(r.get("isActive")).lower() == "false" or "fromColumn" not in r:
            continue
        (a, x), (b, y) = ends(r["fromColumn"]), ends(r["toColumn"])
        if a not in named or b not in named:
            continue
        column = lambda t, c: (named[t].dimension(c) or Dimension(c, sql=c)).sql
        type_ = f"{r.get('fromCardinality', 'many')}_to_{r.get('toCardinality', 'one')}"
        if not any(q.name == b for q in named[a].relationships):
            named[a].relationships.append(join_of(b, type_, [(column(a, x), column(b, y))]))


def indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def word(text: str) -> str:
    return re.sub(r"\W+", "_", text.strip().replace("''", "'")).strip("_")


def dax(text: str, model: Model) -> str | None:
    """A DAX expression of column aggregates, measures and arithmetic; None for any other."""
    text = text.strip()
    if re.search(r"(?i)\b(VAR|RETURN|CALCULATE\w*|FILTER|ALL\w*|SUMX|AVERAGEX|SAMEPERIODLASTYEAR|DATEADD|TOTAL[YMQ]TD|SWITCH|RELATED\w*|SELECTEDVALUE|EARLIER|RANKX|USERELATIONSHIP|BLANK)\b", text):
        return None
    column = lambda c: (model.dimension(word(c)) or Dimension(word(c), sql=word(c))).sql
    while m := re.search(r"(?i)\bDIVIDE\s*\(", text):
        end = closing(text, m.end() - 1)
        parts = arguments(text[m.end() : end - 1])
        ratio = f"(({parts[0]}) / nullif({parts[1]}, 0))"
        text = text[: m.start()] + (f"coalesce({ratio}, {parts[2]})" if len(parts) > 2 else ratio) + text[end:]
    text = re.sub(r"(?i)\bCOUNTROWS\s*\(\s*'?[^')]*'?\s*\)", "count(1)", text)

    def call(m: re.Match) -> str:
        agg = _DAX[m[1].upper()]
        return f"count(distinct {column(m[2])})" if agg == "count_distinct" else f"{ {'stddev': 'stddev_samp', 'variance': 'var_samp', 'variance_pop': 'var_pop'}.get(agg, agg)}({column(m[2])})"

    text = re.sub(rf"(?i)\b({'|'.join(map(re.escape, _DAX))})\s*\(\s*(?:'[^']+'|\w+)?\[([^\]]+)\]\s*\)", call, text)
    text = re.sub(r"(?:'[^']+'|\b\w+)\[([^\]]+)\]", lambda m: column(m[1]), text)
    text = re.sub(r"\[([^\]]+)\]", lambda m: word(m[1]), text)
    known = {"count", "sum", "avg", "min", "max", "median", "stddev_samp", "stddev_pop", "var_samp", "var_pop", "nullif", "coalesce"}
    if any(f.lower() not in known for f in re.findall(r"\b([A-Za-z_.]+)\s*\(", text)):
        return None
    return text


# Malloy


def malloy(text: str) -> Definitions:
    """``source: name is connection.table('t') extend { ... }``: fields, measures, joins, filters."""
    found = Definitions()
    text = outside_strings(text, lambda s: re.sub(r"(//|--|##?)[^\n]*", "", s))
    roles: list[tuple[str, str]] = []
    at = 0
    while m := re.compile(r"\bsource:\s*(\w+)\s+is\s+").search(text, at):
        head = re.compile(r"\w+\.(table|sql)\(\s*(\"\"\"(?:.|\n)*?\"\"\"|'[^']*'|\"[^\"]*\")\s*\)|(\w+)").match(text, m.end())
        if not head:
            raise DefinitionError(f"source {m[1]}: can't read what it stands for")
        target = head[2].strip("'\"").strip() if head[2] else None
        model = Model(m[1], table=target if head[1] == "table" else None, sql=target if head[1] == "sql" else None, extends=head[3])
        if model.table and re.search(r"\.(parquet|csv|json)$", model.table):
            model.source_uri, model.table = model.table, None
        at = head.end()
        if body := re.compile(r"\s*(?:extend\s*)?\{").match(text, at):
            end = braces(text, body.end() - 1)
            malloy_body(found, model, text[body.end() : end - 1], roles)
            at = end
        found.models.append(model)
    named = {x.name: x for x in found.models}
    for role, target in roles:  # a source in another role, with the same fields
        if role not in named and target in named:
            base = named[target]
            named[role] = Model(role, table=base.table, sql=base.sql, source_uri=base.source_uri, primary_key=base.primary_key, dimensions=list(base.dimensions), metrics=list(base.metrics))
            found.models.append(named[role])
    for model in list(found.models):
        for r in model.relationships:
            if r.primary_key is None and r.sql is None and r.name in named:
                r.primary_key = named[r.name].primary_key
    return found


def braces(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    raise DefinitionError("braces aren't closed")


def malloy_body(found: Definitions, model: Model, body: str, roles: list[tuple[str, str]]) -> None:
    sections = re.compile(r"\b(primary_key|dimension|measure|join_one|join_many|join_cross|where|rename|accept|except|view|query|declare|timezone)\s*:")
    cuts, depth, at = [], 0, 0
    for m in re.finditer(r"[{}]|" + sections.pattern, body):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            cuts.append((m[1], m.start(), m.end()))
    for i, (name, _, start) in enumerate(cuts):
        piece = body[start : cuts[i + 1][1] if i + 1 < len(cuts) else len(body)].strip()
        if name == "primary_key":
            model.primary_key = piece.split()[0]
        elif name == "where":
            condition = malloy_sql(piece)
            model.sql = f"SELECT * FROM {model.table or f'({model.sql})'} WHERE {condition}"
            model.table = None
        elif name == "rename":
            for new, old in re.findall(r"(\w+)\s+is\s+(\w+)", piece):
                model.dimensions.append(Dimension(new, sql=old))
        elif name.startswith("join"):
            malloy_join(model, name, piece, roles)
        elif name in ("dimension", "measure"):
            for member, expression in malloy_items(piece):
                try:
                    malloy_member(model, name, member, expression)
                except DefinitionError as e:
                    found.unsupported.append(f"{model.name}.{member}: {e}")


def malloy_items(piece: str) -> list[tuple[str, str]]:
    """``name is expression`` items, by line or comma."""
    starts = []
    for m in re.finditer(r"(?:^|[\n,])\s*(?:public\s+|private\s+|internal\s+)?(\w+)\s+is\s+", piece):
        before = piece[: m.start()]
        if before.count("(") == before.count(")") and before.count("{") == before.count("}"):
            starts.append((m[1], m.start(), m.end()))
    return [(n, piece[e : starts[i + 1][1] if i + 1 < len(starts) else len(piece)].strip().rstrip(",")) for i, (n, _, e) in enumerate(starts)]


def malloy_member(model: Model, section: str, name: str, expression: str) -> None:
    if section == "dimension":
        sql = malloy_sql(expression)
        timed = re.search(r"(?i)date_trunc|as (date|timestamp)\)$", sql) is not None or re.search(r"(_at|_date|_time)$", name) is not None
        test = re.search(r"(?i)[^<>]=|[<>]|\bis (not )?null\b", sql) is not None and "case" not in sql.lower()
        if model.dimension(name) is None:
            model.dimensions.append(Dimension(name, "time" if timed else "boolean" if test else "categorical", sql))
        return
    filters = None
    if m := re.fullmatch(r"((?:.|\n)*?)\s*\{\s*\??\s*(?:where:)?\s*((?:.|\n)*)\}", expression):
        expression, filters = m[1], [malloy_sql(m[2].strip())]
    expression = re.sub(r"\b([A-Za-z_][\w.]*)\.(sum|avg|min|max|stddev|count)\(\s*\)", lambda m: f"{'count(distinct ' if m[2] == 'count' else m[2] + '('}{m[1]})", expression)
    expression = re.sub(r"\bcount_distinct\(", "count(distinct ", re.sub(r"\bcount\(\s*\)", "count(*)", expression))
    sql = malloy_sql(expression)
    made = Metric(name, sql=sql, filters=filters)
    if not made.agg:
        if filters and not aggregate_calls(sql):
            raise DefinitionError("a filtered measure of measures can't be expressed")
        made = Metric(name, type="derived", sql=sql, filters=filters)
    model.metrics.append(made)


def malloy_join(model: Model, name: str, piece: str, roles: list[tuple[str, str]]) -> None:
    for m in re.finditer(r"(?:^|\n|,)\s*(\w+)(?:\s+is\s+(\w+))?\s+(with|on)\s+([^\n,{]+)", piece):
        role, target, how, condition = m[1], m[2] or m[1], m[3], m[4].strip()
        type_ = {"join_one": "many_to_one", "join_many": "one_to_many", "join_cross": "cross"}[name]
        if how == "with":
            model.relationships.append(Relationship(role, type_, foreign_key=condition))
        else:
            qualified = re.sub(r"(?<![\w.])(\w+)(?![\w.(])", lambda w: w[0] if w[1].lower() in ("and", "or", "not") or w[1].isdigit() else f"{model.name}.{w[1]}", condition)
            relate({model.name: model}, model.name, role, qualified, type_)
        if role != target:
            roles.append((role, target))


def malloy_sql(text: str) -> str:
    """An expression in Spark SQL; alternatives, ranges and ungrouped aggregates raise."""
    text = text.strip()
    if re.search(r"\?|\ball\(|\bexclude\(|~|@\d", outside_strings(text, lambda s: s.replace("??", ""))):
        raise DefinitionError(f"{text} can't be expressed")
    if re.match(r"pick\b", text):
        text = re.sub(r"\bpick\s+((?:'[^']*'|[^'])+?)\s+when\s+((?:'[^']*'|[^'])+?)(?=\s+pick\b|\s+else\b|$)", r"WHEN \2 THEN \1", text)
        text = f"CASE {re.sub(r'\belse\b', 'ELSE', text)} END"
    text = re.sub(r"\b([\w.]+)\s*\?\?\s*([\w.']+)", r"coalesce(\1, \2)", text)
    text = re.sub(r"\b([\w.]+)::(\w+)", lambda m: f"cast({m[1]} as {'double' if m[2] == 'number' else m[2]})", text)
    text = re.sub(r"(?<![\w.])(\w+)\.(second|minute|hour|day|week|month|quarter|year)\b(?!\s*\()", r"date_trunc('\2', \1)", text)
    return re.sub(r"!=\s*null\b", "IS NOT NULL", re.sub(r"(?<![<>!])=\s*null\b", "IS NULL", text))


# files


def read(path: str, suffix: str, text: str) -> Definitions | None:
    """Definitions of a file by its suffix; None if it isn't one of these formats."""
    if suffix in (".tds", ".twb"):
        return tableau(text)
    if suffix == ".aml":
        return aml(text)
    if suffix == ".gsql":
        return gsql(text)
    if suffix == ".tmdl":
        return tmdl(text)
    if suffix == ".malloy":
        return malloy(text)
    if suffix == ".tml":
        return tml(yaml.safe_load(text))
    if suffix == ".json":
        return from_data(json.loads(text))
    return None


def from_data(data: dict, name: str | None = None) -> Definitions | None:
    """Definitions of parsed YAML or JSON; None if it is none of these formats."""
    if not isinstance(data, dict):
        return None
    if "semantic_model" in data:
        return osi(data)
    if "ldm" in data or ("datasets" in data and "dateInstances" in data):
        return ldm(data)
    if "object_type" in data and "unique_name" in data:
        return sml([data])
    if {"table", "model", "worksheet"} & set(data) and ("guid" in data or "worksheet" in data or isinstance(data.get("table"), dict)):
        return tml(data)
    if isinstance(data.get("dimensions"), dict) and (isinstance(data.get("measures", {}), dict)) and ("table_name" in data or "schema" in data):
        return omni_view(data, name)
    return None


def folder(files: list) -> tuple[Definitions, set]:
    """Formats whose files belong together: (definitions, files taken)."""
    found, taken = Definitions(), set()
    parsed = {}
    for f in files:
        if f.suffix in (".yml", ".yaml"):
            try:
                data = yaml.safe_load(f.read_text())
            except yaml.YAMLError:
                continue
            if isinstance(data, dict):
                parsed[f] = data
            elif isinstance(data, list) and any(isinstance(x, dict) and "join_from_view" in x for x in data):
                parsed[f] = {"relationships": data}
                taken.add(f)
    objects = {f: d for f, d in parsed.items() if "object_type" in d and "unique_name" in d}
    if objects:
        found.merge(sml(list(objects.values())))
        taken |= set(objects)
    views = {f: d for f, d in parsed.items() if f not in taken and isinstance(d.get("dimensions"), dict) and ("table_name" in d or "schema" in d)}
    if views:
        for f, d in views.items():
            found.merge(omni_view(d, f.name.split(".")[0]))
        for f, d in parsed.items():
            relations = d.get("relationships") if isinstance(d, dict) else None
            if isinstance(relations, list) and any("join_from_view" in r for r in relations):
                omni_relationships(relations, found.models)
                taken.add(f)
        taken |= set(views)
    amls = [f for f in files if f.suffix == ".aml"]
    if amls:
        found.merge(aml("\n".join(f.read_text() for f in amls)))
        taken |= set(amls)
    tmdls = [f for f in files if f.suffix == ".tmdl"]
    if tmdls:
        found.merge(tmdl("\n".join(f.read_text() for f in tmdls)))
        taken |= set(tmdls)
    gsqls = [f for f in files if f.suffix == ".gsql"]
    if gsqls:
        found.merge(gsql("\n".join(f.read_text() for f in gsqls)))
        taken |= set(gsqls)
    return found, taken


__all__ = ["folder", "from_data", "infer_relationships", "read"]
