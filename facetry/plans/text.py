"""Small edits of SQL fragments: names are replaced outside of string literals, comments aside."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PARTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"")
_DOTTED = re.compile(r"(?<![\w.`])([A-Za-z_]\w*)\.([A-Za-z_]\w*)(?![\w.(])")
_BARE = re.compile(r"(?<![\w.`])([A-Za-z_]\w*)(?!\w|\s*\(|\.\w)")
#: Words that stand between names and aren't names.
KEYWORDS = frozenset(
    "and or not in is null like ilike rlike between case when then else end true false distinct as over partition by order asc desc rows range preceding following "
    "unbounded current row within group filter where interval cast exists select from all any nulls first last escape".split()
)
#: Names in some places, words of an INTERVAL or of a cast in others.
UNITS = frozenset("day days month months year years week weeks hour hours minute minutes second seconds quarter".split())
TYPES = frozenset("date timestamp int integer bigint double float decimal string boolean".split())


def outside_strings(text: str, change: Callable[[str], str]) -> str:
    """``change`` applied to what isn't in quotes."""
    out, at = [], 0
    for m in _PARTS.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


def replace_dotted(text: str, change: Callable[[str, str], str | None]) -> str:
    """``a.b`` becomes what ``change`` gives, or stays where that is None."""
    return outside_strings(text, lambda s: _DOTTED.sub(lambda m: m[0] if (r := change(m[1], m[2])) is None else r, s))


def replace_bare(text: str, change: Callable[[str], str | None]) -> str:
    """Plain names that are neither keywords, calls nor qualified."""
    text = re.sub(r"(?i)\binterval\s+'(\d+)'\s+", r"INTERVAL \1 ", text)

    def one(m: re.Match, literal_follows: bool) -> str:
        word, before = m[1].lower(), m.string[: m.start()]
        fixed = word in KEYWORDS or (word in UNITS and re.search(r"(?i)\binterval\s+[-\d.]+\s+$", before))
        fixed = fixed or (word in TYPES and (re.search(r"(?i)\bas\s+$", before) or (literal_follows and not m.string[m.end() :].strip())))
        return m[0] if fixed or (r := change(m[1])) is None else r

    out, at = [], 0
    for quoted in _PARTS.finditer(text):
        out += [_BARE.sub(lambda m: one(m, True), text[at : quoted.start()]), quoted[0]]
        at = quoted.end()
    return "".join([*out, _BARE.sub(lambda m: one(m, False), text[at:])])


def dotted(text: str) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    replace_dotted(text, lambda a, b: found.append((a, b)))
    return found


def bare(text: str) -> list[str]:
    found: list[str] = []
    replace_bare(text, lambda a: found.append(a))
    return found


def split_top(text: str, word: str) -> list[str]:
    """Parts between ``word`` (as AND) at bracket depth 0; the AND of a BETWEEN doesn't split."""
    parts, depth, start, between = [], 0, 0, 0
    spans = [m.span() for m in _PARTS.finditer(text)]
    for m in re.finditer(rf"[()]|\b(?:between|case|end|{word})\b", text, re.IGNORECASE):
        if any(a <= m.start() < b for a, b in spans):
            continue
        token = m[0].lower()
        if token in "()":
            depth += 1 if token == "(" else -1
        elif token == "case":
            depth += 1
        elif token == "end":
            depth -= 1
        elif token == "between":
            between += depth == 0
        elif depth == 0:
            if between:
                between -= 1
            else:
                parts.append(text[start : m.start()].strip())
                start = m.end()
    return [*parts, text[start:].strip()]


_AGGREGATES = (
    "sum count avg min max median stddev stddev_samp stddev_pop variance var_samp var_pop variance_pop approx_count_distinct count_if mode kurtosis skewness any_value product "
    "percentile percentile_cont percentile_disc percentile_approx quantile quantile_cont quantile_disc approx_percentile collect_list collect_set string_agg listagg array_agg list "
    "first last max_by min_by bool_and bool_or corr covar_pop covar_samp regr_slope entropy geometric_mean geomean weighted_avg approx_quantile"
).split()
_AGGREGATE = re.compile(rf"\b({'|'.join(_AGGREGATES)})\s*\(", re.IGNORECASE)
_TAIL = re.compile(r"\s*(within\s+group|filter|over)\s*\(", re.IGNORECASE)


def closing(text: str, start: int) -> int:
    """The place after the bracket that closes the one at ``start``."""
    depth, quoted = 0, ""
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return i + 1
    raise ValueError(f"unbalanced brackets in {text!r}")


def aggregate_calls(text: str) -> list[tuple[int, int]]:
    """Spans of outermost aggregate calls with their WITHIN GROUP and FILTER; windowed ones are no aggregates."""
    found, at = [], 0
    while m := _AGGREGATE.search(text, at):
        end = closing(text, m.end() - 1)
        windowed = False
        while tail := _TAIL.match(text, end):
            windowed |= tail[1].lower() == "over"
            end = closing(text, tail.end() - 1)
        if not windowed:
            found.append((m.start(), end))
        at = end
    return found


def arguments(text: str) -> list[str]:
    """A call's arguments, split at commas outside brackets and quotes."""
    parts, depth, start, quoted = [], 0, 0, ""
    for i, c in enumerate(text):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def entropy(x: str) -> str:
    """Bits of the values' distribution: log2 n less the mean of log2 of each value's count, by a fold over the sorted values."""
    close = "IF(a.n > 0, a.n * log2(a.n), 0D)"
    fold = (
        f"aggregate(array_sort(collect_list(CAST({x} AS STRING))), named_struct('v', CAST(NULL AS STRING), 'n', 0D, 's', 0D), "
        f"(a, v) -> IF(v <=> a.v, named_struct('v', a.v, 'n', a.n + 1D, 's', a.s), named_struct('v', v, 'n', 1D, 's', a.s + {close})), a -> a.s + {close})"
    )
    return f"IF(count({x}) = 0, 0D, log2(count({x})) - {fold} / count({x}))"


def _product(x: str) -> str:
    sign = f"IF(count_if(({x}) < 0) % 2 = 1, -1, 1)"
    return f"CASE WHEN count({x}) = 0 THEN NULL WHEN count_if(({x}) = 0) > 0 THEN 0D ELSE {sign} * exp(sum(ln(abs({x})))) END"


#: Aggregates that definitions use and Spark's SQL lacks, by its own.
_FOREIGN = {
    "product": _product,
    "entropy": entropy,
    "geometric_mean": lambda x: f"exp(avg(ln({x})))",
    "geomean": lambda x: f"exp(avg(ln({x})))",
    "weighted_avg": lambda x, w: f"try_divide(sum(({x}) * ({w})), sum(CASE WHEN ({x}) IS NOT NULL THEN {w} END))",
    "quantile_cont": lambda x, q: f"percentile({x}, {q})",
    "quantile_disc": lambda x, q: f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})",
    "quantile": lambda x, q: f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})",
    "approx_quantile": lambda x, q: f"percentile_approx({x}, {q})",
    "list": lambda x: f"collect_list({x})",
}
_FOREIGN_CALL = re.compile(rf"(?i)\b({'|'.join(_FOREIGN)})\s*\(")


def native(text: str) -> str:
    """Aggregates that Spark's SQL lacks become expressions that it has; ``product({x})`` alone stays."""
    if text == "product({x})":
        return text
    at = 0
    while m := _FOREIGN_CALL.search(text, at):
        if any(a <= m.start() < b for a, b in (q.span() for q in _PARTS.finditer(text))):
            at = m.end()
            continue
        end = closing(text, m.end() - 1)
        made = _FOREIGN[m[1].lower()](*arguments(text[m.end() : end - 1]))
        text = text[: m.start()] + made + text[end:]
        at = m.start() + (len(made) if m[1].lower() in made.lower() else 0)
    return text


#: Planning of formulas takes turns, since it sets an option of the session.
_TURN = threading.RLock()


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Fragments analysed inside divide by zero to NULL, as the metric formulas expect."""
    with _TURN:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
