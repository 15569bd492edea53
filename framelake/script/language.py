"""The script language: a line is parsed into a tree, then evaluated against objects.

Statements are `expression;` and `declare a = expression, b;`, with // comments.
Values are int (32 bits), long (64 bits), double, string, void, objects and
functions. Functions have overloads, told apart by signatures: a result type and
argument types out of i, l, d, s, v (any) and a final . (any number of anything).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class ScriptError(Exception):
    pass


class Long(int):
    """A 64-bit whole number; a plain int is a 32-bit one."""


def wrap32(v: int) -> int:
    return (v + 2**31) % 2**32 - 2**31


def wrap64(v: int) -> Long:
    return Long((v + 2**63) % 2**64 - 2**63)


def kind(v: Any) -> str:
    """i, l, d, s, 0 (void), f (function) or o (object)."""
    if isinstance(v, Long):
        return "l"
    if isinstance(v, bool):
        return "i"
    for k, t in (("i", int), ("d", float), ("s", str)):
        if isinstance(v, t):
            return k
    return "0" if v is None else "f" if isinstance(v, Function) else "o"


NAMES = {"i": "int", "l": "long", "d": "double", "s": "string", "0": "void", "f": "function", "o": "object"}


def convert(v: Any, to: str) -> Any:
    if to == "i":
        return wrap32(int(v))
    if to == "l":
        return wrap64(int(v))
    return float(v) if to == "d" else v


@dataclass
class Function:
    """Overloads as (signature, body), tried in order."""

    name: str
    overloads: list[tuple[str, Callable]]

    def call(self, args: list) -> Any:
        best, tie = None, False
        for signature, body in self.overloads:
            rank = _rank(signature[1:], args)
            if rank is None:
                continue
            scores, promotions = rank
            if best is not None:
                if any(a < b for a, b in zip(scores, best[0], strict=True)):
                    continue
                if scores == best[0] and promotions >= best[1]:
                    tie = tie or promotions == best[1]
                    continue
            best, tie = (scores, promotions, signature, body), False
        if best is None:
            raise ScriptError(f"no overload of {self.name} takes ({', '.join(NAMES[kind(a)] for a in args)})")
        if tie:
            raise ScriptError(f"the call of {self.name} is ambiguous")
        _, _, signature, body = best
        wanted = signature[1:].rstrip(".").ljust(len(args), ".")
        result = body(*(convert(a, w) if w in "ild" else a for a, w in zip(args, wanted, strict=True)))
        return None if signature[0] == "0" else convert(result, signature[0])


def _rank(signature: str, args: list) -> tuple[list[int], int] | None:
    """Per argument 0, or -2 for a narrowing conversion, and -3 at the end for an ellipsis; and the number of promotions."""
    fixed = signature.rstrip(".")
    open_ = signature.endswith(".")
    if len(args) < len(fixed) or len(args) > len(fixed) and not open_:
        return None
    scores, promotions = [0] * (len(args) + 1), 0
    for i, (a, want) in enumerate(zip(args, fixed, strict=False)):
        have = kind(a)
        if want == "v" or have == want:
            continue
        if want in "ild" and have in "ild":
            if "ild".index(have) > "ild".index(want):
                scores[i] = -2
            else:
                promotions += 1
        else:
            return None
    if open_:
        scores[-1] = -3
    return scores, promotions


# --- syntax ----------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>//[^\n]*)|(?P<float>\d+\.\d*(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+)|(?P<number>0[xX][0-9a-fA-F]+|\d+)
    |(?P<raw>[uU]"[^"]*")|(?P<string>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>&&|\|\||==|!=|<=|>=|[-+*/%<>=!~&|^.,;()\[\]]))""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: Binary operators and how tightly they bind; fixed values.
PRECEDENCE = {"||": 4, "&&": 6, "|": 8, "^": 10, "&": 12, "==": 14, "!=": 14, "<": 16, ">": 16, "<=": 16, ">=": 16, "+": 18, "-": 18, "*": 20, "/": 20, "%": 20}


def tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ScriptError(f"can't read {text[at : at + 20]!r}")
        at = m.end()
        what, value = m.lastgroup, m[m.lastgroup]
        if what == "number":
            v = int(value, 16) if value[:2] in ("0x", "0X") else int(value, 8) if value[0] == "0" and value.isdigit() and len(value) > 1 else int(value)
            out.append(("value", v if v <= 0x7FFFFFFF else Long(v)))
        elif what == "float":
            out.append(("value", float(value)))
        elif what == "string":
            out.append(("value", re.sub(r"\\(x[0-9a-fA-F]{2}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] == "x" and len(e[1]) == 3 else _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)))
        elif what == "raw":
            out.append(("value", value[2:-1]))
        elif what == "name":
            if len(value) > 64:
                raise ScriptError("a name has at most 64 characters")
            out.append(("value", int(value == "true")) if value in ("true", "false") else (what, value))
        elif what == "sign":
            out.append((what, value))
    return out


class Parser:
    """Trees are tuples: (op, ...parts)."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def sign(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else None

    def take(self, want: str | None = None) -> tuple[str, Any]:
        if self.at >= len(self.tokens) or want and self.sign() != want:
            raise ScriptError(f"expected {want or 'an expression'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def program(self) -> list[tuple]:
        out = []
        while self.at < len(self.tokens):
            if self.tokens[self.at] == ("name", "declare"):
                self.at += 1
                while True:
                    what, name = self.take()
                    if what != "name":
                        raise ScriptError("expected a name after declare")
                    value = None
                    if self.sign() == "=":
                        self.take()
                        value = self.expression()
                    out.append(("declare", name, value))
                    if self.sign() != ",":
                        break
                    self.take()
            elif self.sign() != ";":
                out.append(("do", self.expression()))
            self.take(";")
        return out

    def expression(self, least: int = 3) -> tuple:
        node = self.unary()
        if self.sign() == "=" and least <= 3:
            self.take()
            return ("assign", node, self.expression(3))
        while (p := PRECEDENCE.get(self.sign() or "", 0)) >= least:
            node = ("binary", self.take()[1], node, self.expression(p + 1))
        return node

    def unary(self) -> tuple:
        s = self.sign()
        if s in ("!", "~", "-", "+"):
            self.take()
            return ("unary", s, self.unary())
        if s == "(" and self.tokens[self.at + 1 : self.at + 3] and self.tokens[self.at + 1][1] in ("int", "long", "double") and self.tokens[self.at + 2] == ("sign", ")"):
            to = self.tokens[self.at + 1][1]
            self.at += 3
            return ("cast", to[0], self.expression())  # a cast takes in all that follows
        node = self.primary()
        while self.sign() in (".", "(", "["):
            s = self.take()[1]
            if s == ".":
                what, name = self.take()
                if what != "name":
                    raise ScriptError("expected a name after .")
                node = ("member", node, name)
            elif s == "(":
                node = ("call", node, self.arguments(")"))
            else:
                node = ("index", node, self.arguments("]"))
        return node

    def arguments(self, end: str) -> list[tuple]:
        out = []
        while self.sign() != end:
            out.append(self.expression())
            if self.sign() != end:
                self.take(",")
        self.take(end)
        return out

    def primary(self) -> tuple:
        what, value = self.take()
        if what == "value":
            return ("const", value)
        if what == "name":
            return ("name", value)
        if value == "(":
            node = self.expression()
            self.take(")")
            return node
        raise ScriptError(f"unexpected {value}")


# --- built-in functions ----------------------------------------------------


def to_text(v: Any) -> str:
    return f"{v:g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) else v


def _divide(a: int, b: int) -> int:
    if b == 0:
        raise ScriptError("division by zero")
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _remainder(a: int, b: int) -> int:
    return a - b * _divide(a, b)


def _quotient(a: float, b: float) -> float:
    if b == 0:
        raise ScriptError("division by zero")
    return a / b


def _each(f: Callable, *signatures: str) -> list[tuple[str, Callable]]:
    return [(s, f) for s in signatures]


_CONCAT = _each(lambda a, b: a + to_text(b), "sss", "ssi", "ssl", "ssd")
OPERATORS = {
    "+": [*_each(lambda a, b: a + b, "iii", "lll", "ddd"), *_CONCAT],
    "-": _each(lambda a, b: a - b, "iii", "lll", "ddd"),
    "*": _each(lambda a, b: a * b, "iii", "lll", "ddd"),
    "/": [*_each(_divide, "iii", "lll"), ("ddd", _quotient)],
    "%": _each(_remainder, "iii", "lll"),
    "&": _each(lambda a, b: a & b, "iii", "lll"),
    "|": _each(lambda a, b: a | b, "iii", "lll"),
    "^": _each(lambda a, b: a ^ b, "iii", "lll"),
    "<": _each(lambda a, b: a < b, "iii", "ill", "idd"),
    ">": _each(lambda a, b: a > b, "iii", "ill", "idd"),
    "<=": _each(lambda a, b: a <= b, "iii", "ill", "idd"),
    ">=": _each(lambda a, b: a >= b, "iii", "ill", "idd"),
    "==": _each(lambda a, b: a == b, "iii", "ill", "idd", "iss"),
    "!=": _each(lambda a, b: a != b, "iii", "ill", "idd", "iss"),
    "&&": _each(lambda a, b: bool(a) and bool(b), "iii", "ill", "idd"),
    "||": _each(lambda a, b: bool(a) or bool(b), "iii", "ill", "idd"),
}
UNARY = {
    "-": _each(lambda a: -a, "ii", "ll", "dd"),
    "+": _each(lambda a: +a, "ii", "ll", "dd"),
    "~": _each(lambda a: ~a, "ii", "ll"),
    "!": _each(lambda a: not a, "ii", "il"),
}


def parse_whole(text: str) -> int:
    t = text.strip()
    m = re.fullmatch(r"([-+]?)(0[xX][0-9a-fA-F]+|\d+)", t)
    if not m:
        raise ScriptError(f"{text!r} is no whole number")
    v = int(m[2], 16) if m[2][:2] in ("0x", "0X") else int(m[2], 8) if m[2][0] == "0" and len(m[2]) > 1 else int(m[2])
    return -v if m[1] == "-" else v


def _parse_double(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ScriptError(f"{text!r} is no number") from None


def _assert(ok: Any, what: str = "assertion failed") -> None:
    if not ok:
        raise ScriptError(what)


class Library:
    """The language's own functions, as members of an object."""

    def __init__(self):
        self.log: list[str] = []
        equal = lambda a, b: _assert(a == b, f"{a} is not {b}")
        self.members: dict[str, Any] = {
            "ToString": _each(to_text, "si", "sl", "sd", "ss"),
            "Atoi": [("is", parse_whole)],
            "Atol": [("ls", parse_whole)],
            "Atod": [("ds", _parse_double)],
            "TypeName": [("s.", lambda v: NAMES[kind(v)])],
            "Assert": [("0i", _assert)],
            "AssertEqual": _each(equal, "0ii", "0ll", "0dd", "0ss"),
            "TestOverloading": [(f"i{a}", lambda *_, n=n: n) for n, a in enumerate(("", "i", "l", "d", "ii", "il", "id", "li", "ll", "ld", "di", "dl", "dd", "v."), 1)],
            "dprint": [("0.", lambda *a: self.log.append("".join(map(to_text, a))))],
            "MessageBox": [("0ss", lambda a, b: self.log.append(f"{b}: {a}"))],
        }

    def member(self, name: str) -> Any:
        if name not in self.members:
            raise ScriptError(f"no member {name}")
        return Function(name, self.members[name])


class Interpreter:
    def __init__(self, roots: dict[str, Any] | None = None):
        self.library = Library()
        self.names: dict[str, Any] = {"Script": self.library, **(roots or {})}

    def run(self, text: str) -> Any:
        """Runs statements; the result is the last expression's value."""
        value = None
        for what, *parts in Parser(text).program():
            if what == "declare":
                self.names[parts[0]] = self.value(parts[1]) if parts[1] is not None else None
            else:
                value = self.value(parts[0])
        return value

    def value(self, node: tuple) -> Any:
        what, *parts = node
        if what == "const":
            return parts[0]
        if what == "name":
            if parts[0] not in self.names:
                raise ScriptError(f"unknown name {parts[0]}")
            return self.names[parts[0]]
        if what == "member":
            of = self.value(parts[0])
            if not hasattr(of, "member"):
                raise ScriptError(f"{NAMES[kind(of)]} has no members")
            return of.member(parts[1])
        if what == "call":
            f = self.value(parts[0])
            if not isinstance(f, Function):
                raise ScriptError(f"{NAMES[kind(f)]} can't be called")
            return f.call([self.value(a) for a in parts[1]])
        if what == "index":
            return self.value(("call", ("member", parts[0], "[]"), parts[1]))
        if what == "cast":
            v = self.value(parts[1])
            if kind(v) not in "ild":
                raise ScriptError(f"{NAMES[kind(v)]} can't be cast")
            return convert(v, parts[0])
        if what == "assign":
            if parts[0][0] != "name":
                raise ScriptError("only variables can be assigned to")
            self.names[parts[0][1]] = value = self.value(parts[1])
            return value
        if what == "unary":
            return Function(parts[0], UNARY[parts[0]]).call([self.value(parts[1])])
        return Function(parts[0], OPERATORS[parts[0]]).call([self.value(parts[1]), self.value(parts[2])])
