"""Measures in SQL: views with AS MEASURE, AGGREGATE(m), and AT modifiers that change a measure's context.

The query's groups are computed first. Each distinct (measure, modifiers) is one aggregate
of the measure view's base rows at the keys that its context keeps, joined to the
groups null-safe; a context without keys is one row. So every measure, additive or not, is
computed from base rows, and a NULL key is a group like any other."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DefinitionError
from ..plans import exact
from ..plans.text import aggregate_calls, bare, closing, dotted, lenient, native, replace_bare, replace_dotted, split_top
from .clauses import masked, parse_block, split_commas

_CREATE = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(\w+)\s+as\s+(select\b.*)$", re.IGNORECASE | re.DOTALL)
_MEASURE = re.compile(r"\s+as\s+measure\s+(\w+)\s*$", re.IGNORECASE)
_ATS = re.compile(r"\s*\bat\s*\(", re.IGNORECASE)


@dataclass
class MeasureView:
    name: str
    source: str  # FROM and WHERE
    dimensions: dict[str, str] = field(default_factory=dict)
    measures: dict[str, str] = field(default_factory=dict)
    star: bool = False

    def formula(self, name: str, trail: tuple[str, ...] = ()) -> str:
        """The measure's aggregate; measures in it by theirs."""
        if name in trail:
            raise DefinitionError(f"measure {name} depends on itself")
        inner = lambda n: f"({self.formula(n, (*trail, name))})" if n in self.measures and n != name else None
        text = re.sub(r"(?i)\baggregate\(\s*(\w+)\s*\)", r"\1", self.measures[name])
        return replace_bare(re.sub(r"\{(\w+)\}", r"\1", text), inner)

    def rows(self, spark) -> DataFrame:
        """Base rows: base columns under __b_ names, dimensions by name."""
        base = spark.sql(f"SELECT * {self.source}")
        names = dict(self.dimensions)
        if self.star:
            names = {c: f"`{c}`" for c in base.columns} | names
        return base.select(*[F.col(f"`{c}`").alias(f"__b_{c}") for c in base.columns], *[F.expr(e).alias(n) for n, e in names.items()])


def views_of(layer) -> dict[str, MeasureView]:
    return layer.__dict__.setdefault("measure_views", {})


def speaks(layer, text: str) -> bool:
    """Is this a statement of the measure dialect?"""
    flat = masked(text)
    if re.match(r"\s*semantic\s+", text, re.IGNORECASE) or (_CREATE.match(text) and re.search(r"\bas\s+measure\b", text, re.IGNORECASE)):
        return True
    m = re.search(r"\bfrom\s+(\w+)", flat, re.IGNORECASE)
    return bool(m and m[1] in views_of(layer))


def run(layer, text: str) -> DataFrame:
    made = _CREATE.match(text)
    if made:
        view = define(made[1], made[2])
        views_of(layer)[view.name] = view
        return layer.spark.createDataFrame([(view.name,)], "view string")
    return Query(layer, re.sub(r"^\s*semantic\s+", "", text, flags=re.IGNORECASE)).plan()


def define(name: str, select: str) -> MeasureView:
    block = parse_block(re.sub(r"(?i)\bas\s+measure\s+(\w+)", r"AS __measure_\1", select))
    source = f"FROM {block.get('from')}" + (f" WHERE {block.get('where')}" if block.get("where") else "")
    view = MeasureView(name, source)
    for expression, alias in block.items:
        if alias and alias.startswith("__measure_"):
            view.measures[alias.removeprefix("__measure_")] = expression
        elif expression == "*":
            view.star = True
        else:
            view.dimensions[alias or expression.split(".")[-1]] = expression
    return view


def normal(text: str) -> str:
    """An expression without qualifiers, blanks and case: equal texts are the same dimension."""
    return re.sub(r"\s+", "", replace_dotted(text, lambda a, b: b)).lower()


@dataclass
class Use:
    """A measure in a context."""

    view: str
    measure: str
    modifiers: list[str]
    visible: bool


class Query:
    def __init__(self, layer, text: str):
        self.layer, self.spark, self.views = layer, layer.spark, views_of(layer)
        self.block = parse_block(text)
        self.alias: dict[str, str] = {}
        self.uses: list[Use] = []
        self._from()

    def _from(self) -> None:
        text = self.block.get("from")
        flat = masked(text)
        for m in re.finditer(r"(?:^|,|\bjoin\b)\s*(\w+)(?:\s+(?:as\s+)?(?!on\b|join\b|inner\b|left\b|right\b|full\b|cross\b|using\b)(\w+))?", flat, re.IGNORECASE):
            self.alias[m[2] or m[1]] = m[1]
        if not any(v in self.views for v in self.alias.values()):
            raise DefinitionError(f"FROM {text} has no measure view")

    def owner(self, measure: str, qualifier: str | None) -> str | None:
        """The alias whose view has the measure."""
        for alias, view in self.alias.items():
            if view in self.views and measure in self.views[view].measures and qualifier in (None, alias, view):
                return alias
        return None

    # measures in expressions

    def take(self, text: str) -> str:
        """Measures in an expression by the columns that will hold them."""
        out, at = [], 0
        text = re.sub(r"\{(\w+)\}", r"AGGREGATE(\1)", text)
        pattern = re.compile(r"(?i)\baggregate\s*\(|(?<![\w.])(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)(?![\w.(])")
        quoted = re.sub(r"'(?:[^'\\]|\\.|'')*'", lambda m: "\x01" * len(m[0]), text)
        while m := pattern.search(quoted, at):
            if m[2] is None:
                end = closing(text, m.end() - 1)
                inner = text[m.end() : end - 1].strip()
                qualifier, _, name = inner.rpartition(".")
                alias = self.owner(name, qualifier or None)
                if alias is None:
                    raise DefinitionError(f"{inner} is no measure")
                visible = True
            else:
                alias, name, end, visible = self.owner(m[2], m[1]), m[2], m.end(), False
                if alias is None:
                    out.append(text[at : m.end()])
                    at = m.end()
                    continue
            out.append(text[at : m.start()])
            modifiers = []
            while a := _ATS.match(text, end):
                stop = closing(text, a.end() - 1)
                modifiers.append(text[a.end() : stop - 1].strip())
                end = stop
            use = Use(alias, name, modifiers, visible)
            if use not in self.uses:
                self.uses.append(use)
            out.append(f"__use{self.uses.index(use)}")
            at = end
        return "".join([*out, text[at:]])

    # the groups

    def plan(self) -> DataFrame:
        with lenient(self.spark):
            return self._plan()

    def _plan(self) -> DataFrame:
        block = self.block
        items = []
        for e, a in block.items:
            items.append((self.take(e), a, e))
        has_use = ["__use" in t for t, _, _ in items]
        aggregated = [bool(re.search(r"(?i)\b(count|sum|avg|min|max)\s*\(", t)) for t, _, _ in items]
        grouping, rolled = block.get("group by"), False
        if grouping:
            m = re.match(r"(?i)\s*(rollup|cube)\s*\((.*)\)\s*$", grouping, re.DOTALL)
            rolled = m[1].lower() if m else False
            keys = []
            for part in split_commas(m[2] if m else grouping):
                part = items[int(part) - 1][2] if part.isdigit() else next((t for t, a, _ in items if a == part), part)
                keys.append(part)
            if grouping.strip().lower() == "all":
                keys = [t for (t, _, _), u, g in zip(items, has_use, aggregated) if not u and not g]
        else:
            literal = re.compile(r"^('[^']*'|[\d.]+|null|true|false)$", re.IGNORECASE)
            keys = [t for (t, _, _), u, g in zip(items, has_use, aggregated) if not u and not g and not literal.match(t)]
        having = self.take(block.get("having")) if block.get("having") else ""
        order = [self.take(o) for o in split_commas(block.get("order by"))] if block.get("order by") else []
        counted = any(aggregate_calls(t) for t in (*(t for t, _, _ in items), having, *order))
        rows = self.outer_rows(distinct=not counted)
        if block.get("where"):
            rows = rows.filter(self.outer(block.get("where")))
        self.keys = [(k, normal(k)) for k in keys]
        grouped = rows.select(*[F.expr(self.outer(k)).alias(f"__g{i}") for i, k in enumerate(keys)], *[c for c in rows.columns])
        plain: list[str] = []

        def pull(text: str) -> str:
            """Plain aggregates of the query's own rows by column."""
            out, at = [], 0
            for start, end in aggregate_calls(text):
                call = self.outer(text[start:end])
                if call not in plain:
                    plain.append(call)
                out += [text[at:start], f"__a{plain.index(call)}"]
                at = end
            return "".join([*out, text[at:]])

        shown = [(self.named(pull(t)), a, raw) for t, a, raw in items]
        having = self.named(pull(having))
        sorts = [pull(o) for o in order]
        aggs = [F.expr(re.sub(r"(?i)count\(\s*\*\s*\)", "count(1)", c)).alias(f"__a{i}") for i, c in enumerate(plain)] or [F.count(F.lit(1)).alias("__n")]
        columns = [f"__g{i}" for i in range(len(keys))]
        groups = exact.grouped(grouped, columns, [(c, f"__a{i}", a) for i, (c, a) in enumerate(zip(plain, aggs))]) if plain and not rolled else getattr(grouped, rolled or "groupBy")(*columns).agg(*aggs)
        for i, use in enumerate(self.uses):
            groups = self.attach(groups, use, f"__use{i}")
        if having:
            groups = groups.filter(having)
        last = [raw.split(".")[-1] for _, _, raw in shown]
        names = [a or (raw.split(".")[-1] if re.fullmatch(r"\w+(\.\w+)?", raw) and last.count(raw.split(".")[-1]) == 1 else raw if re.fullmatch(r"\w+", raw) else re.sub(r"(?i)^aggregate\(\s*(?:\w+\.)?(\w+)\s*\)$", r"\1", raw)) for _, a, raw in shown]
        made = groups.select("*", *[F.expr(t).alias(f"__o{i}") for i, (t, _, _) in enumerate(shown)])
        columns = []
        for text in sorts:
            m = re.match(r"(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*$", text, re.IGNORECASE | re.DOTALL)
            body = m[1].strip()
            if body.isdigit():
                column = F.col(f"__o{int(body) - 1}")
            else:
                at = next((i for i, n in enumerate(names) if n == body), None)
                column = F.col(f"__o{at}") if at is not None else F.expr(self.named(body))
            columns.append(getattr(column, f"{'desc' if (m[2] or '').lower() == 'desc' else 'asc'}_nulls_{(m[3] or 'last').lower()}")())
        made = made.orderBy(*columns) if columns else made
        if block.get("limit"):
            made = made.limit(int(block.get("limit")))
        out = made.select(*[F.col(f"__o{i}").alias(n) for i, n in enumerate(names)])
        return out.distinct() if block.distinct else out

    def outer_rows(self, distinct: bool) -> DataFrame:
        """The FROM clause over the views' rows, each column under alias and name. Where nothing
        counts joined rows (``distinct``), each side of a join is reduced to the distinct values of
        the columns that the query names, so that facts don't multiply each other."""
        spoken = " ".join(x for e, _ in self.block.items for x in (e,)) + " " + " ".join(self.block.clauses.values())
        named = set(re.findall(r"\w+", spoken))
        frames = {}
        for alias, name in self.alias.items():
            rows = self.views[name].rows(self.spark) if name in self.views else self.spark.table(name)
            kept = rows.columns
            if distinct and len(self.alias) > 1:
                kept = [c for c in kept if c in named] or kept[:1]
                rows = rows.select(*[f"`{c}`" for c in kept]).distinct()
            frames[alias] = rows.select(*[F.col(f"`{c}`").alias(f"__{alias}__{c}") for c in kept])
        text, flat = self.block.get("from"), masked(self.block.get("from"))
        joins = list(re.finditer(r"(?i)\b((?:inner|left|right|full|cross)(?:\s+outer)?\s+)?join\b", flat))
        aliases = list(self.alias)
        out = frames[aliases[0]]
        for i, m in enumerate(joins):
            piece = text[m.end() : joins[i + 1].start() if i + 1 < len(joins) else len(text)]
            on = re.search(r"(?i)\bon\b(.*)$", piece, re.DOTALL)
            how = re.sub(r"(?i)\s*outer\s*", "", (m[1] or "inner").strip()).lower()
            right = frames[aliases[i + 1]]
            out = out.join(right, F.expr(self.outer(on[1])), how) if on else out.crossJoin(right)
        return out

    def outer(self, text: str) -> str:
        """An expression over the outer rows."""
        columns = {a: set(self.columns(a)) for a in self.alias}
        text = replace_dotted(text, lambda a, b: f"`__{a}__{b}`" if a in self.alias else next((f"`__{k}__{b}`" for k, v in self.alias.items() if v == a), None))

        def by(name: str) -> str | None:
            owners = [a for a in self.alias if name in columns[a]]
            return f"`__{owners[0]}__{name}`" if owners else None

        return replace_bare(text, by)

    def columns(self, alias: str) -> list[str]:
        cached = self.__dict__.setdefault("_columns", {})
        if alias not in cached:
            name = self.alias[alias]
            rows = self.views[name].rows(self.spark) if name in self.views else self.spark.table(name)
            cached[alias] = [c for c in rows.columns if not c.startswith("__b_")]
        return cached[alias]

    def named(self, text: str) -> str:
        """An expression over the groups: keys by column."""
        for i, (key, sign) in enumerate(self.keys):
            if normal(text) == sign:
                return f"__g{i}"
        simple = {sign: i for i, (key, sign) in enumerate(self.keys)}
        for key, sign in sorted(self.keys, key=lambda k: -len(k[0])):
            if "(" in key:
                text = re.sub(re.escape(key), f"__g{simple[sign]}", text, flags=re.IGNORECASE)
        text = replace_dotted(text, lambda a, b: f"__g{simple[b.lower()]}" if b.lower() in simple else None)
        return replace_bare(text, lambda n: f"__g{simple[n.lower()]}" if n.lower() in simple else None)

    # one measure in one context

    def attach(self, groups: DataFrame, use: Use, column: str) -> DataFrame:
        view = self.views[self.alias[use.view]]
        rows = view.rows(self.spark)
        dims = set(self.columns(use.view))
        own = lambda text: not {a for a, _ in dotted(text)} - {use.view, view.name} and {n for n in bare(text)} <= dims
        inner = lambda text: replace_dotted(text, lambda a, b: b if a in (use.view, view.name) else None)
        # a key of another view is a key here, too, if this view has a dimension of that name
        views = {*self.alias, *self.alias.values()}
        shared = lambda text: {a for a, _ in dotted(text)} <= views and {b for _, b in dotted(text)} | set(bare(text)) <= dims
        active = {
            sign: (inner(key) if own(key) else replace_dotted(key, lambda a, b: b), f"__g{i}") for i, (key, sign) in enumerate(self.keys) if own(key) or shared(key)
        }
        filters: list[str] = []
        sets: dict[str, tuple[str, str]] = {}
        removed: set[str] = set()
        parts = [p for m in use.modifiers for p in compound(m)]
        kinds = [p.split(None, 1)[0].upper() for p in parts]
        visible = use.visible and "SET" not in kinds
        everything = False
        for part, kind in reversed(list(zip(parts, kinds))):
            rest = part[len(kind) :].strip()
            if kind == "ALL" and not rest:
                active, filters, sets, visible, everything = {}, [], {}, False, True
            elif everything:
                continue
            elif kind == "ALL":
                for target in all_targets(rest):
                    active.pop(normal(target), None)
                    sets.pop(normal(target), None)
                    removed.add(normal(target))
            elif kind == "WHERE":
                eq = re.fullmatch(r"\s*(?:\w+\.)?(\w+)\s*=\s*(\w+)\.(\w+)\s*", rest)
                if eq and eq[2] in self.alias and eq[2] != view.name:  # tied to the outer row
                    sets[normal(eq[1])] = (eq[1], self.named(f"{eq[2]}.{eq[3]}"))
                else:
                    filters.append(inner(rest))
                if len(parts) == 1:
                    active = {}
            elif kind == "SET":
                eq = re.match(r"(.+?)(?<![<>!=])=(?!=)(.*)$", rest, re.DOTALL)
                among = re.match(r"(?is)(.+?)\s+(not\s+)?in\s*\(", rest)
                if among and (not eq or among.end() <= eq.start(2)):
                    sign = normal(among[1])
                    if sign not in removed:
                        active.pop(sign, None)
                        sets.pop(sign, None)
                        filters.append(inner(rest))
                elif eq:
                    sign = normal(eq[1])
                    held = active.pop(sign, None)
                    if sign not in removed:
                        sets[sign] = (inner(eq[1].strip()), self.current(eq[2].strip(), held, sign))
                else:
                    raise DefinitionError(f"can't read SET {rest}")
            elif kind == "VISIBLE":
                visible = visible or "SET" not in kinds
            else:
                raise DefinitionError(f"unknown modifier AT ({part})")
        if visible and self.block.get("where"):
            for part in split_top(self.block.get("where"), "and"):
                if own(part):
                    rows = rows.filter(inner(part))
        for text in filters:
            rows = rows.filter(text)
        base = {c.removeprefix("__b_") for c in rows.columns if c.startswith("__b_")}
        formula = replace_bare(replace_dotted(view.formula(use.measure), lambda a, b: b), lambda n: f"`__b_{n}`" if n in base else None)
        formula = native(re.sub(r"(?i)count\(\s*\*\s*\)", "count(1)", formula))
        ties = [*active.values(), *sets.values()]
        if re.search(r"(?i)\bover\s*\(", formula):  # a window measure has one value in a context
            keyed = rows.select(*[F.expr(e).alias(f"__k{i}") for i, (e, _) in enumerate(ties)], F.expr(formula).alias("__v"))
            one = F.when(F.count_distinct("__v") <= 1, F.any_value("__v", True)).otherwise(F.raise_error(F.lit(f"measure {use.measure} has several values in a context")))
        else:
            keyed = rows.select("*", *[F.expr(e).alias(f"__k{i}") for i, (e, _) in enumerate(ties)])
            one = F.expr(formula)
        keys = [f"__k{i}" for i in range(len(ties))]
        spans = [(0, len(formula))] if exact.apart(formula) else aggregate_calls(formula)
        if any(exact.apart(formula[a:b]) for a, b in spans):
            text, calls = formula, [formula[a:b] for a, b in spans]
            for i, (a, b) in reversed(list(enumerate(spans))):
                text = f"{text[:a]}__c{i}{text[b:]}"
            found = exact.grouped(keyed, keys, [(c, f"__c{i}", F.expr(c)) for i, c in enumerate(calls)]).select(*keys, F.expr(text).alias(column))
        else:
            found = keyed.groupBy(*keys).agg(one.alias(column))
        if not ties:
            return groups.crossJoin(found)  # one row
        condition = F.lit(True)
        for i, (_, right) in enumerate(ties):
            condition = condition & F.expr(f"({right}) <=> __k{i}")
        return groups.join(found, condition, "left").drop(*[f"__k{i}" for i in range(len(ties))])

    def current(self, text: str, held: tuple | None, sign: str) -> str:
        """The right side of SET over the groups; CURRENT of a dimension that isn't grouped is NULL."""
        grouped = {s for _, s in self.keys}
        text = re.sub(r"(?i)\bcurrent\s+([\w.]+)", lambda m: self.named(m[1]) if normal(m[1]) in grouped else "NULL", text)
        text = self.named(text)
        return replace_bare(text, lambda n: "NULL" if n.lower() == sign and sign not in grouped else None)


def compound(modifier: str) -> list[str]:
    """``ALL x SET y = 1`` as single modifiers."""
    flat = masked(modifier)
    cuts = [m.start() for m in re.finditer(r"(?i)\b(all|where|set|visible)\b", flat)]
    return [modifier[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(modifier)])]


def all_targets(text: str) -> list[str]:
    """``d1 d2`` or ``d1, MONTH(d)``."""
    found, at = [], 0
    while m := re.compile(r"[\s,]*([A-Za-z_][\w.]*)(\s*\()?").match(text, at):
        end = closing(text, m.end() - 1) if m[2] else m.end()
        found.append(text[m.start(1) : end])
        at = end
    return found

