"""Inline signature comments: ``(Integer, ?String) -> (nil | Foo)``.

A recursive descent over a small grammar.  Types that the engine cannot use (procs,
tuples, records, intersections, type parameters) are read and become ``untyped``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Invalid(ValueError):
    pass


@dataclass
class Signature:
    params: list = field(default_factory=list)
    returns: tuple = ("name", "untyped")
    type_params: list = field(default_factory=list)


_TOKEN = re.compile(r"\s*(->|\*\*|::|[A-Za-z_][\w]*[?!]?|[()\[\]{}|&?,:*^]|.)")


class _Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if t.strip()]
        # `String?` is a type and its mark, not a name.
        self.tokens = [y for x in self.tokens for y in ((x[:-1], "?") if len(x) > 1 and x[-1] == "?" else (x,))]
        self.i = 0
        self.type_params: set[str] = set()

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ""

    def take(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1] if self.i <= len(self.tokens) else ""

    def need(self, x: str) -> None:
        if self.take() != x:
            raise Invalid(f"expected `{x}`")

    def type(self):
        parts = [self.single()]
        while self.peek() in ("|", "&"):
            if self.take() == "&":
                self.single()
                parts[-1] = ("name", "untyped")
            else:
                parts.append(self.single())
        return parts[0] if len(parts) == 1 else ("union", parts)

    def single(self):
        if self.peek() == "?":
            self.take()
            t = ("union", [self.single(), ("name", "nil")])
        else:
            t = self.base()
        while self.peek() == "?":
            self.take()
            t = ("union", [t, ("name", "nil")])
        return t

    def base(self):
        x = self.take()
        if x == "(":
            t = self.type()
            self.need(")")
            return t
        if x == "^":
            self.callable()
            return ("name", "untyped")
        if x in ("[", "{"):
            close, depth = {"[": "]", "{": "}"}[x], 1
            while depth:
                y = self.take()
                if not y:
                    raise Invalid(f"expected `{close}`")
                depth += (y == x) - (y == close)
            return ("name", "untyped")
        if x == "::":
            x = "::" + self.take()
        if not re.match(r"(::)?[A-Za-z_]\w*$", x):
            raise Invalid(f"expected a type, found `{x}`" if x else "expected a type")
        while self.peek() == "::":
            self.take()
            x += "::" + self.take()
        if x == "singleton" and self.peek() == "(":
            self.take()
            self.type()
            self.need(")")
            return ("name", "untyped")
        args = []
        if self.peek() == "[":
            self.take()
            args.append(self.type())
            while self.peek() == ",":
                self.take()
                args.append(self.type())
            self.need("]")
        return ("name", "untyped" if x in self.type_params or (args and x not in ("Array", "Hash")) else x)

    def callable(self) -> None:
        if self.peek() == "(":
            self.params()
        if self.peek() == "{":
            self.base()
        self.need("->")
        self.type()

    def params(self) -> list:
        self.need("(")
        out = []
        while self.peek() != ")":
            kind = "req"
            if self.peek() in ("*", "**"):
                kind = "rest" if self.take() == "*" else "kwrest"
            elif self.peek() == "?":
                self.take()
                kind = "opt"
            if re.match(r"[a-z_]\w*$", self.peek()) and self.peek(1) == ":" and self.peek(2) != ":":
                self.take()
                self.take()
                kind = "key"
            t = self.type()
            if re.match(r"[a-z_]\w*$", self.peek()):
                self.take()
            out.append((kind, t))
            if self.peek() != ",":
                break
            self.take()
        self.need(")")
        return out


def signature(text: str) -> Signature:
    r = _Reader(text)
    sig = Signature()
    if r.peek() == "[":
        r.take()
        while r.peek() not in ("]", ""):
            x = r.take()
            if re.match(r"[A-Z]\w*$", x):
                sig.type_params.append(x)
        r.need("]")
        r.type_params = set(sig.type_params)
    if r.peek() == "(":
        sig.params = [(k, t) for k, t in r.params() if k in ("req", "opt")]
    while r.peek() in ("{", "?"):
        if r.peek() == "?":
            r.take()
        r.base()
    r.need("->")
    sig.returns = r.type()
    if r.peek():
        raise Invalid(f"unexpected `{r.peek()}`")
    return sig


def render(t: tuple) -> str:
    """Canonical members joined by `` | ``; unknown parts absorb."""
    if t[0] == "name":
        return {"void": "untyped", "top": "untyped", "boolish": "untyped", "NilClass": "nil", "true": "bool", "false": "bool", "self": "untyped", "instance": "untyped", "class": "untyped", "bot": "untyped", "interned": "untyped"}.get(t[1], t[1])
    parts = sorted({y for x in t[1] for y in render(x).split(" | ")})
    return "untyped" if "untyped" in parts else " | ".join(parts)
