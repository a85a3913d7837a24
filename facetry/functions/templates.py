"""A small template language: {{ value }}, {% if %}, {% elif %}, {% else %}, {% for %}; conditions
and values are expressions over the given names, evaluated from their syntax tree."""

from __future__ import annotations

import ast
import operator
import re
from typing import Any

from ..model import DefinitionError, Parameter, quote

_TAG = re.compile(r"\{\{\s*(.*?)\s*\}\}|\{%-?\s*(.*?)\s*-?%\}", re.DOTALL)
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not,
}
_FILTERS = {
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "int": int, "float": float, "length": len,
    "join": lambda x, by="": by.join(map(str, x)), "default": lambda x, other="": other if x is None else x, "title": lambda x: str(x).title(),
}


def evaluate(text: str, names: dict[str, Any]) -> Any:
    """An expression of literals, names, members, comparisons, arithmetic and | filters."""
    parts = re.split(r"\|(?![^()]*\))", text)
    value = _walk(ast.parse(parts[0].strip(), mode="eval").body, names)
    for part in parts[1:]:
        call = ast.parse(part.strip(), mode="eval").body
        name = call.func.id if isinstance(call, ast.Call) else call.id if isinstance(call, ast.Name) else ""
        if name not in _FILTERS:
            raise DefinitionError(f"unknown template filter {part.strip()!r}")
        value = _FILTERS[name](value, *[_walk(a, names) for a in getattr(call, "args", [])])
    return value


def _walk(node: ast.AST, names: dict[str, Any]) -> Any:
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        known = {"true": True, "false": False, "none": None}
        if node.id not in names and node.id not in known:
            raise DefinitionError(f"template name {node.id!r} has no value")
        return names[node.id] if node.id in names else known[node.id]
    if isinstance(node, ast.Attribute):
        value = _walk(node.value, names)
        if not isinstance(value, dict):
            raise DefinitionError("only members of dictionaries can be read")
        return value.get(node.attr)
    if isinstance(node, ast.Subscript):
        return _walk(node.value, names)[_walk(node.slice, names)]
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_walk(x, names) for x in node.elts]
    if isinstance(node, ast.BoolOp):
        values = (_walk(v, names) for v in node.values)
        return all(values) if isinstance(node.op, ast.And) else any(values)
    if isinstance(node, ast.UnaryOp):
        value = _walk(node.operand, names)
        return not value if isinstance(node.op, ast.Not) else -value
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_walk(node.left, names), _walk(node.right, names))
    if isinstance(node, ast.Compare):
        left = _walk(node.left, names)
        for op, right in zip(node.ops, node.comparators):
            value = _walk(right, names)
            if not _COMPARE[type(op)](left, value):
                return False
            left = value
        return True
    if isinstance(node, ast.IfExp):
        return _walk(node.body if _walk(node.test, names) else node.orelse, names)
    raise DefinitionError(f"{type(node).__name__} isn't allowed in a template")


def render(text: str, names: dict[str, Any], show=str) -> str:
    """The text with its tags carried out; ``show`` writes values."""
    tokens, at = [], 0
    for m in _TAG.finditer(text):
        tokens += [("text", text[at : m.start()]), ("value", m[1]) if m[1] is not None else ("tag", m[2])]
        at = m.end()
    tokens.append(("text", text[at:]))
    out, rest = _block(tokens, names, show, ())
    if rest:
        raise DefinitionError(f"unexpected template tag {rest[0][1]!r}")
    return out


def _block(tokens: list, names: dict, show, ends: tuple[str, ...]) -> tuple[str, list]:
    out: list[str] = []
    while tokens:
        kind, value = tokens[0]
        word = value.split(None, 1)[0] if kind == "tag" else ""
        if kind == "tag" and word in ends:
            return "".join(out), tokens
        tokens = tokens[1:]
        if kind == "text":
            out.append(value)
        elif kind == "value":
            out.append(show(evaluate(value, names)))
        elif word == "if":
            done = False
            test = value[2:]
            while True:
                hit = not done and (test is None or bool(evaluate(test, names)))
                if hit:
                    body, tokens = _block(tokens, names, show, ("elif", "else", "endif"))
                    out.append(body)
                    done = True
                else:
                    tokens = _skip(tokens)
                if not tokens:
                    raise DefinitionError("a template if has no endif")
                word, _, more = tokens[0][1].partition(" ")
                tokens = tokens[1:]
                if word == "endif":
                    break
                test = more if word == "elif" else None
        elif word == "for":
            name, _, source = value[3:].strip().partition(" in ")
            items = list(evaluate(source, names))
            after = _skip(tokens)
            for item in items:
                body, _ = _block(tokens, names | {name.strip(): item}, show, ("endfor",))
                out.append(body)
            if not after:
                raise DefinitionError("a template for has no endfor")
            tokens = after[1:]
        else:
            raise DefinitionError(f"unknown template tag {value!r}")
    if ends:
        raise DefinitionError(f"a template block lacks {ends[-1]}")
    return "".join(out), []


def _skip(tokens: list) -> list:
    """From inside a block to the tag that ends or continues it."""
    depth = 0
    for i, (kind, value) in enumerate(tokens):
        word = value.split(None, 1)[0] if kind == "tag" else ""
        if word in ("if", "for"):
            depth += 1
        elif word in ("endif", "endfor"):
            if depth == 0:
                return tokens[i:]
            depth -= 1
        elif word in ("elif", "else") and depth == 0:
            return tokens[i:]
    return []


def literal(value: Any) -> str:
    """A value as a SQL literal; lists as comma-separated literals."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return ", ".join(map(literal, value))
    return quote(str(value))


def render_secure(text: str, user: dict) -> str:
    """A row filter: every value becomes a literal, so it can't change the condition."""
    return render(text, {"user": user}, literal)


def allowed(access: str | bool | None, user: dict | None) -> bool:
    if access is None or isinstance(access, bool):
        return access is not False
    text = access.strip()
    m = re.fullmatch(r"\{\{(.*)\}\}", text, re.DOTALL)
    return user is not None and bool(evaluate(m[1] if m else text, {"user": user}))


def with_parameters(text: str, declared: dict[str, Parameter], values: dict[str, Any]) -> str:
    """``{{ name }}`` of a declared parameter as its typed literal; other tags as a template."""
    if "{{" not in text and "{%" not in text:
        return text
    text = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: declared[m[1]].format(values.get(m[1])) if m[1] in declared else m[0], text)
    names = {n: values.get(n, p.default_value) for n, p in declared.items()} | values
    return render(text, names, literal)
