"""A small sandboxed template language: syntax tree, constant folding, Python closures.

Text with {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %},
{% for name in list %}/{% endfor %}, {% set name = expression %} and
{% generation %}/{% endgeneration %}, which marks what a model is to write. A
dash inside a tag trims white space on its side. Expressions: strings, whole
numbers, true, false, none, names, .key, [key], lists, ( ), not, and, or, == !=
< <= > >= in, + - ~ * // %, | filter. There are no calls, and attributes are
keys of mappings only, so a template reaches nothing but its variables.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# --- syntax tree -----------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Each:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class Generated:
    body: tuple


# --- parsing ---------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+~*%<>|.\[\](),=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
#: Binary operators by rising strength.
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "//", "%"))


def _tokens(code: str) -> list[tuple[str, Any]]:
    out, at, code = [], 0, code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at : at + 20]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0

    def peek(self) -> Any:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" else None

    def take(self, want: str | None = None) -> tuple[str, Any]:
        if self.at >= len(self.tokens) or want and self.peek() != want:
            raise TemplateError(f"expected {want or 'an expression'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Any:
        node = self.binary(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def binary(self, level: int) -> Any:
        if level == len(_LEVELS):
            return self.unary()
        if level == 2 and self.peek() == "not":
            self.take()
            return Op("not", (self.binary(2),))
        node = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            node = Op(self.take()[1], (node, self.binary(level + 1)))
        return node

    def unary(self) -> Any:
        if self.peek() == "-":
            self.take()
            return Op("neg", (self.unary(),))
        node = self.primary()
        while self.peek() in (".", "[", "|"):
            sign = self.take()[1]
            if sign == ".":
                node = Op("get", (node, Const(self.take()[1])))
            elif sign == "[":
                node = Op("get", (node, self.binary(0)))
                self.take("]")
            else:
                name = self.take()[1]
                node = Filter(name, (node, *(self.listed(")") if self.peek() == "(" and self.take() else ())))
        return node

    def listed(self, end: str) -> list:
        items = []
        while self.peek() != end:
            items.append(self.binary(0))
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return items

    def primary(self) -> Any:
        kind, value = self.take()
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Const(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        if value == "(":
            node = self.binary(0)
            self.take(")")
            return node
        if value == "[":
            return Op("list", tuple(self.listed("]")))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    items: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left, right = (m[1], m[3]) if m[2] is not None else (m[4], m[6])
        text = text.lstrip() if trim else text
        items.append(("text", text.rstrip() if left else text))
        items.append(("emit", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    items.append(("text", source[at:].lstrip() if trim else source[at:]))
    body, rest = _block(items, 0, ())
    return body


def _block(items: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    """Nodes up to a tag in ends, and where that tag is."""
    nodes = []
    while at < len(items):
        kind, code = items[at]
        word = code.split(None, 1)[0] if kind == "tag" and code else ""
        if kind == "tag" and word in ends:
            return tuple(nodes), at
        if kind == "text":
            if code:
                nodes.append(Emit(Const(code)))
        elif kind == "emit":
            nodes.append(Emit(_Expression(code).whole()))
        elif word == "set":
            m = re.fullmatch(r"set\s+(\w+)\s*=(.*)", code, re.S)
            if not m:
                raise TemplateError(f"can't read {code!r}")
            nodes.append(Assign(m[1], _Expression(m[2]).whole()))
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", code, re.S)
            if not m:
                raise TemplateError(f"can't read {code!r}")
            body, at = _block(items, at + 1, ("endfor",))
            nodes.append(Each(m[1], _Expression(m[2]).whole(), body))
        elif word == "generation":
            body, at = _block(items, at + 1, ("endgeneration",))
            nodes.append(Generated(body))
        elif word == "if":
            node, at = _branch(items, at, code[2:])
            nodes.append(node)
        else:
            raise TemplateError(f"unexpected {code!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at


def _branch(items: list, at: int, test: str) -> tuple[Branch, int]:
    then, at = _block(items, at + 1, ("elif", "else", "endif"))
    code = items[at][1]
    other: tuple = ()
    if code.startswith("elif"):
        node, at = _branch(items, at, code[4:])
        other = (node,)
    elif code == "else":
        other, at = _block(items, at + 1, ("endif",))
    return Branch(_Expression(test).whole(), then, other), at


# --- folding ---------------------------------------------------------------


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no {key!r} here")


_OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "+": operator.add, "-": operator.sub, "~": lambda a, b: _shown(a) + _shown(b), "*": operator.mul,
    "//": operator.floordiv, "%": operator.mod, "neg": operator.neg, "not": operator.not_, "get": _get, "list": lambda *x: list(x),
}
FILTERS: dict[str, Callable] = {"trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len, "default": lambda x, y: y if x is None else x, "string": lambda x: _shown(x)}


def _shown(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The node with everything computed that depends on no variable."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, filters)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(_shown(out[-1].value.value) + _shown(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, (Op, Filter)):
        args = tuple(fold(a, filters) for a in node.args)
        if isinstance(node, Op) and node.name in ("and", "or"):
            if isinstance(args[0], Const):
                return args[0] if bool(args[0].value) == (node.name == "or") else args[1]
        elif all(isinstance(a, Const) for a in args):
            try:
                return Const((_OPS if isinstance(node, Op) else filters)[node.name](*(a.value for a in args)))
            except (TemplateError, TypeError, ArithmeticError):
                pass  # it fails when, and only if, it is rendered
        return type(node)(node.name, args)
    if isinstance(node, Emit):
        return Emit(fold(node.value, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    if isinstance(node, Branch):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return Branch(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, Each):
        return Each(node.name, fold(node.items, filters), fold(node.body, filters))
    if isinstance(node, Generated):
        return Generated(fold(node.body, filters))
    return node


# --- closures --------------------------------------------------------------


@dataclass
class Rendered:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)  # generated text, in code points

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    args = [_value(a, filters) for a in node.args]
    if isinstance(node, Op) and node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if isinstance(node, Op) and node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    table = _OPS if isinstance(node, Op) else filters
    if node.name not in table:
        raise TemplateError(f"unknown filter {node.name}")
    f = table[node.name]
    if len(args) == 1:
        return lambda scope, a=args[0]: f(a(scope))
    if len(args) == 2:
        return lambda scope, a=args[0], b=args[1]: f(a(scope), b(scope))
    return lambda scope: f(*(a(scope) for a in args))


def _step(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, tuple):
        steps = [_step(x, filters) for x in node]

        def run(scope: dict, out: Rendered) -> None:
            for step in steps:
                step(scope, out)

    elif isinstance(node, Emit):
        value = _value(node.value, filters)

        def run(scope: dict, out: Rendered) -> None:
            text = _shown(value(scope))
            out.parts.append(text)
            out.length += len(text)

    elif isinstance(node, Assign):
        assigned = _value(node.value, filters)

        def run(scope: dict, out: Rendered) -> None:
            scope[node.name] = assigned(scope)

    elif isinstance(node, Branch):
        test, then, other = _value(node.test, filters), _step(node.then, filters), _step(node.other, filters)

        def run(scope: dict, out: Rendered) -> None:
            (then if test(scope) else other)(scope, out)

    elif isinstance(node, Each):
        items, body = _value(node.items, filters), _step(node.body, filters)

        def run(scope: dict, out: Rendered) -> None:
            found = items(scope) or ()
            for i, x in enumerate(found):
                body({**scope, node.name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(found) - 1}}, out)

    else:
        inner = _step(node.body, filters)

        def run(scope: dict, out: Rendered) -> None:
            begin = out.length
            inner(scope, out)
            out.spans.append((begin, out.length))

    return run


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping], Rendered]:
    """A function from variables to what the template renders."""
    known = {**FILTERS, **(filters or {})}
    step = _step(fold(parse(source), known), known)

    def render(variables: Mapping) -> Rendered:
        out = Rendered()
        step(dict(variables), out)
        return out

    return render
