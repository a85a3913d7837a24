"""Aggregates of groups of any size, exactly and without a task that holds a group's values.

Percentiles are selected by rank: a sketch of a large group gives cuts, rows below each are
counted, and only the rows between the cuts around a rank are sorted. Cuts needn't be close to
the rank; if they aren't, more rows are sorted. Modes and entropies come from the counts of the
values, which are grouped by value first. Distinct counts are taken apart from sketches,
whose states would otherwise be made for each distinct value."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .text import arguments, closing, entropy

#: Rows of a group that are sorted without looking for cuts; larger groups are broadcast by their cuts.
LARGE = 1 << 17
#: Cuts lie at these distances from a percentile.
AROUND = (0.002, 0.02)
#: Of the sketches that give cuts: their ranks are off by 1 / ACCURACY or so.
ACCURACY = 2000
_WITHIN = re.compile(r"(?i)percentile_(disc|cont)\(([\d.]+)\) WITHIN GROUP (\(ORDER BY (.+)\))")
#: Aggregates whose state is a few numbers.
_LIGHT = re.compile(r"(?i)(sum|count|avg|min|max|stddev_samp|stddev_pop|var_samp|var_pop|count_if|skewness|kurtosis|any_value)\(")


def call(text: str, name: str) -> list[str] | None:
    """The arguments if ``text`` is one call of ``name``."""
    if not text.lower().startswith(f"{name}(") or closing(text, len(name)) != len(text):
        return None
    return arguments(text[len(name) + 1 : -1])


def ranked(text: str) -> tuple[str, float, bool] | None:
    """The expression, percentage and whether a value is picked, of an exact percentile."""
    if (m := _WITHIN.fullmatch(text)) and closing(text, m.start(3)) == len(text) and not re.search(r"(?i)\b(asc|desc|first|last)$", m[4]):
        return (m[4], float(m[2]), m[1].lower() == "disc") if float(m[2]) <= 1 else None
    if (given := call(text, "median")) and len(given) == 1:
        return given[0], 0.5, False
    if (given := call(text, "percentile")) and len(given) == 2 and re.fullmatch(r"[\d.]+", given[1]) and float(given[1]) <= 1:
        return given[0], float(given[1]), False
    return None


def distinct(text: str) -> str | None:
    """The expression whose distinct values are counted."""
    given = call(text, "count")
    return given[0][9:] if given and len(given) == 1 and given[0].lower().startswith("distinct ") else None


def by_counts(text: str) -> tuple[str, str] | None:
    """What follows from the counts of an expression's values, and the expression."""
    if (given := call(text, "mode")) and len(given) == 2 and given[1].lower() == "true":
        return "mode", given[0]
    if text.startswith("IF(count(") and entropy(x := text[9 : closing(text, 8) - 1]) == text:
        return "entropy", f"CAST({x} AS STRING)"
    return None


def apart(text: str) -> bool:
    """Whether ``grouped`` computes an aggregate apart from the others."""
    return bool(ranked(text) or by_counts(text))


def light(text: str) -> bool:
    m = _LIGHT.match(text)
    return bool(m and closing(text, m.end() - 1) == len(text))


def grouped(rows: DataFrame, dims: list[str], asked: Iterable[tuple[str, str, Column]]) -> DataFrame:
    """``dims`` and an aggregate for each (SQL, name, the same as a column)."""
    asked = list(asked)
    together, apart, percents, counts = [], {}, {}, {}
    for text, name, column in asked:
        found = ranked(text)
        if found and isinstance(rows.select(F.expr(found[0])).schema[0].dataType, NumericType):
            percents.setdefault(found[0], []).append((name, *found[1:]))
        elif found := by_counts(text):
            counts.setdefault(found[1], []).append((name, found[0]))
        else:
            together.append((text, name, column))
    if not all(distinct(text) or light(text) for text, _, _ in together):
        for text, name, column in together:
            if x := distinct(text):
                apart.setdefault(x, []).append(column.alias(name))
        together = [a for a in together if not distinct(a[0])]
    pieces = [rows.groupBy(*dims).agg(*made) for made in apart.values()]
    pieces += [percentiles(rows, dims, x, made) for x, made in percents.items()]
    pieces += [frequencies(rows, dims, x, made) for x, made in counts.items()]
    empty = {name for made in counts.values() for name, kind in made if kind == "entropy"}
    if not pieces or together:
        out = rows.groupBy(*dims).agg(*[column.alias(name) for _, name, column in together])
    elif apart or not dims:
        out = pieces.pop(0)
    else:
        out = rows.select(*dims).distinct()
    for piece in pieces:
        if not dims:
            out = out.crossJoin(piece)  # one row each
            continue
        out = out.join(tagged(piece, dims, "__p"), same(dims, "__p"), "left").drop(*[f"{d}__p" for d in dims])
    return out.select(*dims, *[F.coalesce(name, F.lit(0.0)).alias(name) if name in empty else name for _, name, _ in asked])


def tagged(df: DataFrame, dims: list[str], tag: str) -> DataFrame:
    return df.select(*[F.col(d).alias(d + tag) for d in dims], *[c for c in df.columns if c not in dims])


def same(dims: list[str], tag: str) -> Column:
    out = F.lit(True)
    for d in dims:
        out = out & F.col(d).eqNullSafe(F.col(d + tag))
    return out


def frequencies(rows: DataFrame, dims: list[str], x: str, asked: list[tuple[str, str]]) -> DataFrame:
    """Modes, of equally frequent values the smallest, and entropies in bits (name, kind) of ``x`` in each group that has values."""
    values = rows.select(*dims, F.expr(x).alias("__x")).filter("__x IS NOT NULL").groupBy(*dims, "__x").agg(F.count(F.lit(1)).alias("__same"))
    same = F.col("__same")
    made = {"mode": F.min_by("__x", F.struct(-same, F.col("__x"))), "entropy": F.log2(F.sum(same)) - F.sum(same * F.log2(same)) / F.sum(same)}
    return values.groupBy(*dims).agg(*[made[kind].alias(name) for name, kind in asked])


def percentiles(rows: DataFrame, dims: list[str], x: str, asked: list[tuple[str, float, bool]]) -> DataFrame:
    """Exact percentiles (name, percentage, picked or between two values) of ``x`` in each group that has values."""
    # ranks from 0 of the two values that a percentile lies between, in a group of n
    place = lambda n, p, pick: F.greatest(F.ceil(n * p), F.lit(1)) - 1 if pick else (n - 1) * p
    ranks = lambda n, p, pick: (F.floor(place(n, p, pick)), F.ceil(place(n, p, pick)))
    at = sorted({min(max(p + sign * d, 0.0), 1.0) for _, p, _ in asked for d in AROUND for sign in (-1, 1)})
    cut, below = [F.col(f"__cut{j}") for j in range(len(at))], [F.col(f"__below{j}") for j in range(len(at))]
    values = rows.select(*dims, F.expr(x).alias("__x")).filter("__x IS NOT NULL")
    n, v = F.col("__n"), F.col("__x")
    # large groups alone, at most one for each LARGE rows of input, so they can be broadcast
    large = values.groupBy(*dims).agg(F.count(v).alias("__n")).filter(n > LARGE)
    cuts = values.join(F.broadcast(tagged(large, dims, "__t")), same(dims, "__t")).groupBy(*dims).agg(F.any_value(n).alias("__n"), F.percentile_approx(v, at, ACCURACY).alias("__cuts"))
    cuts = cuts.select(*dims, n, *[F.col("__cuts")[j].alias(f"__cut{j}") for j in range(len(at))])
    counted = values.join(F.broadcast(tagged(cuts, dims, "__t")), same(dims, "__t")).groupBy(*dims).agg(
        F.any_value(n).alias("__n"), *[F.any_value(c).alias(f"__cut{j}") for j, c in enumerate(cut)], *[F.count(F.when(v <= c, 1)).alias(f"__below{j}") for j, c in enumerate(cut)]
    )
    bounds = []
    for i, (_, p, pick) in enumerate(asked):
        first, last = ranks(n, p, pick)
        bounds += [
            F.greatest(*[F.when(b <= first, c) for b, c in zip(below, cut)]).alias(f"__lo{i}"),
            F.least(*[F.when(b > last, c) for b, c in zip(below, cut)]).alias(f"__hi{i}"),
            F.greatest(F.lit(0), *[F.when(b <= first, b) for b in below]).alias(f"__before{i}"),
        ]
    bounds = tagged(counted.select(*dims, n, *bounds), dims, "__t")
    inside = [F.coalesce(v > F.col(f"__lo{i}"), F.lit(True)) & F.coalesce(v <= F.col(f"__hi{i}"), F.lit(True)) for i in range(len(asked))]
    near = values.join(F.broadcast(bounds), same(dims, "__t"), "left")
    kept = inside[0]
    for one in inside[1:]:
        kept = kept | one
    # equal values are counted before they are sorted
    near = near.filter(kept).groupBy(*dims, "__x").agg(
        F.count(F.lit(1)).alias("__same"), F.any_value(n).alias("__n"),
        *[F.any_value(one).alias(f"__inside{i}") for i, one in enumerate(inside)], *[F.any_value(f"__before{i}").alias(f"__before{i}") for i in range(len(asked))],
    )
    whole = Window.partitionBy(*dims)
    until = whole.orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [F.when(F.col(f"__inside{i}"), F.col("__same")).otherwise(0) for i in range(len(asked))]
    near = near.select(
        *dims, "__x", F.coalesce(n, F.sum("__same").over(whole)).alias("__n"), *[c.alias(f"__own{i}") for i, c in enumerate(counts)],
        *[(F.coalesce(f"__before{i}", F.lit(0)) + F.sum(c).over(until)).alias(f"__until{i}") for i, c in enumerate(counts)],
    )
    picked = []
    for i, (_, p, pick) in enumerate(asked):
        holds = lambda rank: (F.col(f"__until{i}") - F.col(f"__own{i}") <= rank) & (rank < F.col(f"__until{i}"))  # noqa: B023, E731
        picked += [F.max(F.when(holds(rank), v)).cast("double").alias(f"__{side}{i}") for side, rank in zip(("first", "last"), ranks(n, p, pick))]
    found = near.groupBy(*dims).agg(F.any_value(n).alias("__n"), *picked)
    out = []
    for i, (name, p, pick) in enumerate(asked):
        (first, last), spot = ranks(n, p, pick), place(n, p, pick)
        a, b = F.col(f"__first{i}"), F.col(f"__last{i}")
        out.append(F.when((first == last) | (a == b), a).otherwise((last - spot) * a + (spot - first) * b).alias(name))
    return found.select(*dims, *out)
