"""Formulas of other tools as Spark SQL."""

from __future__ import annotations

import ast
import re

from ..model import DefinitionError
from ..plans.text import closing

#: Spreadsheet-style names -> Spark SQL; {0}, {1} ... are arguments.
FORMULAS = {
    "ZN": "coalesce({0}, 0)", "IFNULL": "coalesce({0}, {1})", "ISNULL": "({0} IS NULL)", "IIF": "CASE WHEN {0} THEN {1} ELSE {2} END", "CONTAINS": "contains({0}, {1})",
    "STARTSWITH": "startswith({0}, {1})", "ENDSWITH": "endswith({0}, {1})", "LEN": "length({0})", "INT": "cast({0} AS BIGINT)", "FLOAT": "cast({0} AS DOUBLE)", "STR": "cast({0} AS STRING)",
    "COUNTD": "count(DISTINCT {0})", "DATETRUNC": "date_trunc({0}, {1})", "MID": "substring({0}, {1}, {2})", "FIND": "instr({0}, {1})", "CHAR": "char({0})",
    "MAKEDATE": "make_date({0}, {1}, {2})", "MAKEDATETIME": "cast(concat(cast({0} AS STRING), ' ', cast({1} AS STRING)) AS TIMESTAMP)", "TODAY": "current_date()", "NOW": "current_timestamp()",
}
#: Time frames of a date column -> Spark SQL over it.
TIMEFRAMES = {
    "raw": "{x}", "time": "{x}", "date": "date_trunc('day', {x})", "week": "date_trunc('week', {x})", "month": "date_trunc('month', {x})", "quarter": "date_trunc('quarter', {x})", "year": "year({x})",
    "hour_of_day": "hour({x})", "day_of_month": "day({x})", "day_of_year": "dayofyear({x})", "day_of_week": "date_format({x}, 'EEEE')", "day_of_week_index": "weekday({x})", "month_num": "month({x})",
    "month_name": "date_format({x}, 'MMMM')", "week_of_year": "weekofyear({x})", "quarter_of_year": "concat('Q', quarter({x}))", "hour": "date_trunc('hour', {x})", "minute": "date_trunc('minute', {x})", "second": "date_trunc('second', {x})",
}


def formula(text: str) -> str:
    """A spreadsheet-style formula: [Field] names, functions, IF ... THEN ... END, + of texts."""
    text = re.sub(r"\[([^\]]+)\]", lambda m: f"`{m[1]}`", text)
    text = re.sub(r'"([^"]*)"', r"'\1'", text)
    text = re.sub(r"\bIF\b(?!\s*\()", "CASE WHEN", text, flags=re.IGNORECASE)
    text = re.sub(r"\bELSEIF\b", "WHEN", text, flags=re.IGNORECASE)
    text = text.replace("==", "=")
    if re.search(r"\bDATEADD\s*\(", text, re.IGNORECASE):
        text = re.sub(r"(?i)\bDATEADD\s*\(\s*'(\w+)'\s*,", r"timestampadd(\1,", text)
    at = 0
    while m := re.compile(r"\b([A-Z]+)\s*\(", re.IGNORECASE).search(text, at):
        shape = FORMULAS.get(m[1].upper())
        if shape is None:
            at = m.end()
            continue
        end = closing(text, m.end() - 1)
        args, depth, start = [], 0, m.end()
        for i in range(m.end(), end - 1):
            depth += (text[i] == "(") - (text[i] == ")")
            if text[i] == "," and depth == 0:
                args.append(text[start:i].strip())
                start = i + 1
        args.append(text[start : end - 1].strip())
        made = shape.format(*args)
        text = text[: m.start()] + made + text[end:]
        at = m.start() + (0 if not made.lower().startswith(m[1].lower()) else len(m[1]) + 1)
    return re.sub(r"('[^']*')\s*\+\s*|\s*\+\s*('[^']*')", lambda m: f"{m[1]} || " if m[1] else f" || {m[2]}", text)


_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.BitAnd: "AND", ast.BitOr: "OR"}
_METHODS = {"sum": "sum({0})", "mean": "avg({0})", "min": "min({0})", "max": "max({0})", "median": "median({0})", "std": "stddev_samp({0})", "var": "var_samp({0})", "nunique": "count(DISTINCT {0})", "isnull": "({0} IS NULL)", "notnull": "({0} IS NOT NULL)", "year": "year({0})", "month": "month({0})", "day": "day({0})", "quarter": "quarter({0})", "hour": "hour({0})", "upper": "upper({0})", "lower": "lower({0})", "abs": "abs({0})"}


def expression(text: str) -> str:
    """An expression in the style of ``_.amount.sum() / _.count()``."""
    return _sql(ast.parse(text, mode="eval").body)


def _sql(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return "NULL" if node.value is None else str(node.value).upper() if isinstance(node.value, bool) else "'" + node.value.replace("'", "''") + "'" if isinstance(node.value, str) else repr(node.value)
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "_":
        return node.attr
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        return f"({_sql(node.left)} {_OPERATORS[type(node.op)]} {_sql(node.right)})"
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        return f"({_sql(node.left)} {_OPERATORS[type(node.ops[0])]} {_sql(node.comparators[0])})"
    if isinstance(node, ast.UnaryOp):
        return f"(NOT {_sql(node.operand)})" if isinstance(node.op, ast.Invert) else f"(-{_sql(node.operand)})"
    if isinstance(node, ast.IfExp):
        return f"CASE WHEN {_sql(node.test)} THEN {_sql(node.body)} ELSE {_sql(node.orelse)} END"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        owner, name = node.func.value, node.func.attr
        args = [_sql(a) for a in node.args if not isinstance(a, (ast.List, ast.Tuple))]
        if name == "count" and isinstance(owner, ast.Name):
            return "count(1)"
        x = _sql(owner)
        if name in _METHODS:
            return _METHODS[name].format(x)
        if name in ("isin", "notin"):
            return f"({x} {'NOT ' if name == 'notin' else ''}IN ({', '.join(_sql(e) for e in node.args[0].elts)}))"
        if name == "between":
            return f"({x} BETWEEN {args[0]} AND {args[1]})"
        if name in ("like", "ilike"):
            return f"({x} {name.upper()} {args[0]})"
        if name == "cast":
            return f"cast({x} AS {args[0].strip(chr(39))})"
        if name == "fillna":
            return f"coalesce({x}, {args[0]})"
    raise DefinitionError(f"can't translate {ast.unparse(node)}")
