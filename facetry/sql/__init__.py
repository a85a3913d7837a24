"""Semantic SQL: SELECTs over models become metric queries; all other SQL goes to Spark as it is.

A statement is worked on from the inside out. Each SELECT over a model (an island) is
planned as a metric query and becomes a temporary relation; what surrounds it, be it
CTEs, joins, set operations or aggregates, stays plain SQL over those relations."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GRAINS, DefinitionError, Metric
from ..plans.live import split_grain
from ..plans.text import aggregate_calls, bare, dotted, lenient, replace_bare, replace_dotted, split_top
from . import measures
from .clauses import Block, masked, nested_selects, parse_block, split_sets, split_with, uncommented

_count = itertools.count()
_SOURCE = re.compile(r"^\s*([A-Za-z_]\w*)(?:\s+(?:as\s+)?([A-Za-z_]\w*))?\s*(.*)$", re.IGNORECASE | re.DOTALL)
_TRUNC = re.compile(r"^date_trunc\(\s*'(\w+)'\s*,\s*([\w.]+)\s*\)$", re.IGNORECASE)
_WRAPPED = re.compile(r"^(?:measure|agg|metric)\(\s*([\w.]+)\s*\)$", re.IGNORECASE)


def run(layer, text: str, **options) -> DataFrame:
    """A statement of semantic SQL, measure SQL or plain SQL."""
    text = uncommented(text)
    if measures.speaks(layer, text):
        return measures.run(layer, text)
    named: dict[str, DataFrame] = {}
    rewritten = rewrite(layer, text, named, options, frozenset())
    if rewritten in named:
        return named[rewritten]
    return in_scope(layer.spark, rewritten, named)


def in_scope(spark, text: str, named: dict[str, DataFrame]) -> DataFrame:
    """``text`` with names of DataFrames as relations."""
    if not named:
        return spark.sql(text)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, named)) + r")\b")
    shielded = pattern.sub(lambda m: f"{{{m[1]}}}", text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(shielded, **named)


def rewrite(layer, text: str, named: dict, options: dict, hidden: frozenset[str]) -> str:
    """The statement with islands replaced by relation names; ``hidden``: CTE names that cover models."""
    ctes, main = split_with(text)
    if ctes:
        done = []
        for name, query in ctes:
            inner = rewrite(layer, query, named, options, hidden)
            done.append(f"{name} AS ({'SELECT * FROM ' + inner if inner in named else inner})")
            hidden = hidden | {name}
        inner = rewrite(layer, main, named, options, hidden)
        return f"WITH {', '.join(done)} {'SELECT * FROM ' + inner if inner in named else inner}"
    parts = split_sets(text)
    if len(parts) > 1:
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
                continue
            body = part[1:-1] if part.startswith("(") and masked(part).count("\x01") and part.endswith(")") else part
            inner = rewrite(layer, body, named, options, hidden)
            out.append(f"(SELECT * FROM {inner})" if inner in named else f"({inner})" if body is not part else inner)
        return " ".join(out)
    spans = nested_selects(text)
    for start, end in reversed(spans):
        inner = rewrite(layer, text[start:end], named, options, hidden)
        text = f"{text[:start]}{'SELECT * FROM ' + inner if inner in named else inner}{text[end:]}"
    if not re.match(r"\s*select\b", text, re.IGNORECASE):
        return text
    block = parse_block(text)
    base = source_of(layer, block, hidden)
    if base is None:
        return text
    name = f"__island_{next(_count)}"
    named[name] = Island(layer, block, base, options).plan()
    return name


def source_of(layer, block: Block, hidden: frozenset[str]) -> str | None:
    """The model that a block selects from ('metrics' for the virtual table), if it is one."""
    m = _SOURCE.match(block.get("from"))
    if not m or m[1] in hidden:
        return None
    if m[1] in layer.graph.models:
        joined = re.findall(r"\bjoin\s+([A-Za-z_]\w*|\()", masked(block.get("from")), re.IGNORECASE)
        return m[1] if all(j in layer.graph.models and j not in hidden for j in joined) else None
    return "metrics" if m[1] == "metrics" and not layer.spark.catalog.tableExists("metrics") else None


class Island:
    def __init__(self, layer, block: Block, base: str, options: dict):
        self.layer, self.graph, self.block, self.base, self.options = layer, layer.graph, block, base, options
        self.alias: dict[str, str] = {}
        self.dims: dict[str, str] = {}  # reference -> output column
        self.mets: dict[str, str] = {}
        self.filters: list[str] = []
        self.added: list[Metric] = []
        self._sources()

    def _sources(self) -> None:
        """Aliases of models; ON conjuncts that aren't keys of the declared relationship are filters."""
        text = self.block.get("from")
        flat = masked(text)
        cuts = [m for m in re.finditer(r"\b(?:(?:inner|left|right|full|cross)(?:\s+outer)?\s+)?join\b", flat, re.IGNORECASE)]
        pieces = [text[: cuts[0].start()] if cuts else text] + [text[m.end() : cuts[i + 1].start() if i + 1 < len(cuts) else len(text)] for i, m in enumerate(cuts)]
        for i, piece in enumerate(pieces):
            m = re.match(r"\s*([A-Za-z_]\w*)(?:\s+(?:as\s+)?(?!on\b)([A-Za-z_]\w*))?\s*(?:on\b(.*))?$", piece, re.IGNORECASE | re.DOTALL)
            if not m:
                raise DefinitionError(f"can't read FROM {text}")
            self.alias[m[2] or m[1]] = m[1]
            self.alias.setdefault(m[1], m[1])
            if i and self.base != "metrics":
                hop = self.graph.path(self.base, m[1])[-1]
                keys = {frozenset([(hop.left, a), (hop.right, b)]) for a, b in zip(hop.left_keys, hop.right_keys)}
                met = set()
                for part in split_top(m[3] or "", "and"):
                    part = self.qualified(part)
                    eq = re.fullmatch(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*", part)
                    pair = eq and frozenset([(eq[1], eq[2]), (eq[3], eq[4])])
                    if pair in keys:
                        met.add(pair)
                    elif part and eq:
                        raise DefinitionError(f"{part.strip()} isn't the declared relationship of {hop.left} and {hop.right}")
                    elif part:
                        self.filters.append(part)
                if keys - met:
                    raise DefinitionError(f"the join of {hop.left} and {hop.right} must repeat their declared keys")

    def qualified(self, text: str) -> str:
        """Aliases as model names."""
        return replace_dotted(text, lambda a, b: f"{self.alias[a]}.{b}" if a in self.alias else None)

    def resolve(self, text: str) -> tuple[str, str] | None:
        """('dim' or 'met', reference) of a plain item; None if it is an expression."""
        text = self.qualified(text.strip())
        m = _WRAPPED.match(text)
        text = m[1] if m else text
        grain = None
        if t := _TRUNC.match(text):
            grain, text = t[1].lower(), t[2]
        if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", text):
            return None
        owner, _, name = text.rpartition(".")
        owners = [owner] if owner else ([self.base] if self.base != "metrics" else []) + [m for m in dict.fromkeys(self.alias.values()) if m != self.base]
        if self.base == "metrics" and not owner:
            owners = list(self.graph.models)
        for o in owners:
            model = self.graph.models.get(o)
            if model is None:
                continue
            base, own = split_grain(self.graph, o, name)
            if model.dimension(base):
                use = grain or own
                return "dim", f"{o}.{base}" + (f"__{use}" if use in GRAINS else "")
            if model.metric(name) and grain is None:
                return "met", f"{o}.{name}"
        if not owner and name in self.graph.metrics:
            return "met", name
        return None

    def atom(self, kind: str, ref: str) -> str:
        """The output column of a reference, asked for if it isn't yet."""
        held = self.dims if kind == "dim" else self.mets
        if ref not in held:
            held[ref] = f"__{kind}{len(held)}"
        return held[ref]

    def expression(self, text: str) -> str:
        """An expression over the metric query's columns: fields by column, inline aggregates as metrics made for it."""
        pieces, at = [], 0
        for start, end in aggregate_calls(text):
            call = text[start:end]
            if any((r := self.resolve(x)) and r[0] == "met" for x in [".".join(p) for p in dotted(call)] + bare(call)):
                raise DefinitionError(f"{call} aggregates a metric")
            pieces += [self._plain(text[at:start]), self.atom("met", self.inline(call))]
            at = end
        return "".join([*pieces, self._plain(text[at:])])

    def _plain(self, text: str) -> str:
        text = re.sub(r"(?i)\b(?:measure|agg|metric)\(\s*([\w.]+)\s*\)", r"\1", text)

        def trunc(m: re.Match) -> str:
            found = self.resolve(m[0])
            return self.atom(*found) if found else m[0]

        text = re.sub(r"(?i)date_trunc\(\s*'\w+'\s*,\s*[\w.]+\s*\)", trunc, text)
        text = replace_dotted(text, lambda a, b: self.atom(*f) if (f := self.resolve(f"{a}.{b}")) else None)
        return replace_bare(text, lambda n: self.atom(*f) if not n.startswith("__") and (f := self.resolve(n)) else None)

    def inline(self, call: str) -> str:
        """A metric of the base model for an aggregate written in the query."""
        if self.base == "metrics":
            raise DefinitionError("aggregates need a model in FROM")
        owners = {self.alias.get(a, a) for a, _ in dotted(call)} or {self.base}
        owner = owners.pop()
        name = f"__inline{len(self.added)}"
        metric = Metric(name=name, sql=replace_dotted(call, lambda a, b: b if self.alias.get(a, a) == owner else None))
        self.added.append(metric)
        self.graph.models[owner].metrics.append(metric)
        return f"{owner}.{name}"

    def plan(self) -> DataFrame:
        try:
            return self._plan()
        finally:
            for model in self.graph.models.values():
                model.metrics = [m for m in model.metrics if not any(m is a for a in self.added)]

    def _plan(self) -> DataFrame:
        block, items = self.block, []
        for text, alias in block.items:
            if re.fullmatch(r"(\w+\.)?\*", text):
                model = self.graph.model(self.alias.get(text[:-2], self.base) if text != "*" else self.base)
                items += [(f"{model.name}.{d.name}", None) for d in model.dimensions] + [(f"{model.name}.{m.name}", None) for m in model.metrics]
            else:
                items.append((text, alias))
        outputs, plain = [], []
        for text, alias in items:
            found = self.resolve(text)
            if found:
                column = self.atom(*found)
                outputs.append((column, alias or found[1].split(".")[-1]))
                plain.append(found[0] == "dim")
            else:
                outputs.append((self.expression(text), alias or re.sub(r"\W+", "_", text).strip("_").lower()))
                plain.append(False)
        self._check_group(items, outputs, plain)
        names = {alias: text for text, alias in items if alias}
        where = [p for p in split_top(self._filter_text(block.get("where"), names), "and") if p]
        having_text = block.get("having")
        having = self.expression(replace_bare(having_text, lambda n: f"({names[n]})" if n in names and not self.resolve(n) else None)) if having_text else ""
        order = [self._order(o, outputs, names) for o in (_commas(block.get("order by")))]
        qualify = self.expression(replace_bare(block.get("qualify"), lambda n: f"({names[n]})" if n in names and not self.resolve(n) else None)) if block.get("qualify") else ""
        query = dict(metrics=list(self.mets), dimensions=list(self.dims), filters=self.filters + where, aliases={**self.dims, **self.mets})
        if not query["metrics"] and not query["dimensions"]:
            raise DefinitionError("the query names neither a metric nor a dimension of its model")
        out = self.layer.query(**query | self.options)
        with lenient(self.layer.spark):
            if having:
                out = out.filter(having)
            if qualify:  # top-N: window expressions become columns, then the condition holds
                out = _qualified(out, qualify)
            unique = [n if [x for _, x in outputs].count(n) == 1 else f"{n}" for _, n in outputs]
            made = out.select(*out.columns, *[F.expr(e).alias(f"__out{i}") for i, (e, _) in enumerate(outputs)])
            for i, text in enumerate(order):
                made = made.withColumn(f"__sort{i}", F.expr(text[0]))
            if block.distinct:
                made = made.dropDuplicates([f"__out{i}" for i in range(len(outputs))])
            if order:
                made = made.orderBy(*[getattr(F.col(f"__sort{i}"), f"{'desc' if d else 'asc'}_nulls_{n}")() for i, (_, d, n) in enumerate(order)])
            if block.get("offset"):
                made = made.offset(int(block.get("offset")))
            if block.get("limit"):
                made = made.limit(int(block.get("limit")))
            return made.select(*[F.col(f"__out{i}").alias(n) for i, n in enumerate(unique)])

    def _filter_text(self, text: str, names: dict[str, str]) -> str:
        text = self.qualified(text)

        def trunc(m: re.Match) -> str:
            found = self.resolve(m[0])
            return found[1] if found and found[0] == "dim" else m[0]

        text = re.sub(r"(?i)date_trunc\(\s*'\w+'\s*,\s*[\w.]+\s*\)", trunc, text)

        def by(name: str) -> str | None:
            found = self.resolve(name) or (self.resolve(names[name]) if name in names else None)
            return found[1] if found else f"{self.base}.{name}" if self.base != "metrics" else None

        return replace_bare(text, by)

    def _check_group(self, items: list, outputs: list, plain: list[bool]) -> None:
        text = self.block.get("group by")
        if not text or text.strip().lower() == "all":
            return
        listed = set()
        for part in _commas(text):
            if part.isdigit():
                part = items[int(part) - 1][0]
            part = next((t for t, a in items if a == part), part)
            found = self.resolve(part)
            listed.add(found[1] if found else re.sub(r"\s+", "", self.qualified(part)).lower())
        selected = {self.resolve(t)[1] for (t, _), p in zip(items, plain) if p}
        other = {re.sub(r"\s+", "", self.qualified(t)).lower() for (t, _), p in zip(items, plain) if not p}
        if not selected <= listed or not listed <= selected | other:
            raise DefinitionError(f"GROUP BY {text} must repeat the selected dimensions")

    def _order(self, text: str, outputs: list, names: dict) -> tuple[str, bool, str]:
        m = re.match(r"(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*$", text, re.IGNORECASE | re.DOTALL)
        body = m[1].strip()
        if body.isdigit():
            sql = f"__out{int(body) - 1}"
        else:
            at = next((i for i, (_, n) in enumerate(outputs) if n == body.split(".")[-1]), None)
            sql = f"__out{at}" if at is not None else self.expression(body)
        return sql, (m[2] or "").lower() == "desc", (m[3] or "last").lower()


def _commas(text: str) -> list[str]:
    from .clauses import split_commas

    return split_commas(text) if text else []


def _qualified(df: DataFrame, condition: str) -> DataFrame:
    from ..plans.text import closing

    at, n = 0, 0
    while m := re.search(r"(?i)\b\w+\s*\(", condition[at:]):
        start = at + m.start()
        end = closing(condition, at + m.end() - 1)
        over = re.compile(r"\s*over\s*\(", re.IGNORECASE).match(condition, end)
        if not over:
            at = end
            continue
        end = closing(condition, over.end() - 1)
        df = df.withColumn(f"__q{n}", F.expr(condition[start:end]))
        condition = f"{condition[:start]}__q{n}{condition[end:]}"
        at, n = start + len(f"__q{n}"), n + 1
    return df.filter(condition)
