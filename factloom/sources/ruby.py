"""A parser for the Ruby subset the engine reasons about.

It never guesses: what lies outside the subset raises :class:`Unsupported`, and the
caller treats the file as opaque (its classes open, nothing in it accused).
:class:`Malformed` is raised only for what no Ruby can be: an unclosed parameter list,
a missing or surplus ``end``.

Nodes are tuples ``(kind, start, end, ...)`` with character offsets.
"""

from __future__ import annotations

import re


class Unsupported(Exception):
    pass


class Malformed(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


# Reserved words.
RESERVED = frozenset("class module def end if elsif else unless while until case when in then do begin rescue ensure return yield self nil true false and or not super break next redo retry alias undef defined? for BEGIN END __FILE__ __LINE__ __method__".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f]+|\\\n)|(?P<comment>\#[^\n]*)|(?P<newline>\n)
    |(?P<float>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)|(?P<int>0[xXbBoO][\da-fA-F_]+|\d[\d_]*)
    |(?P<ivar>@[A-Za-z_]\w*)|(?P<cvar>@@[A-Za-z_]\w*)|(?P<gvar>\$(?:\w+|[!@&~_./;,<>*$?:"]))
    |(?P<label>[A-Za-z_]\w*[?!]?:(?!:))|(?P<sym>:(?:@{1,2}\w+|[A-Za-z_]\w*[?!=]?(?![=~>])|[A-Za-z_]\w*[?!]?|\[\]=?|[+\-*/%<>=!~^&|]+))
    |(?P<const>[A-Z]\w*)|(?P<id>[a-z_]\w*(?:[?!](?!=))?)
    |(?P<op>\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|\*\*|==|!=|>=|<=|&&|\|\||=~|!~|\+=|-=|\*=|/=|%=|\|=|&=|\^=|<<|>>|->|=>|\.\.|&\.|::|[-+*/%<>=!~^&|?:;,.(){}\[\]])""",
    re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_VALUE_END = {"int", "float", "ivar", "cvar", "gvar", "const", "str", "sym", "words", "regex", "xstr"}
_BINARY = {"||": 3, "&&": 4, "<=>": 6, "==": 6, "===": 6, "!=": 6, "=~": 6, "!~": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "|": 8, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14}
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "|=", "&=", "^=", "<<=", ">>=", "||=", "&&="}


class Lexer:
    """Tokens (kind, text, start, end, space_before); comments apart."""

    def __init__(self, src: str, base: int = 0):
        self.src, self.base, self.tokens, self.comments = src, base, [], []
        self._heredocs: list[tuple[str, bool, int]] = []
        at, space, depth = 0, False, 0
        while at < len(src):
            c = src[at]
            last = self.tokens[-1] if self.tokens else None
            value = last is not None and (last[0] in _VALUE_END or (last[0] == "id" and last[1] not in RESERVED) or (last[0] == "id" and last[1] in ("end", "self", "nil", "true", "false")) or last[1] in (")", "]", "}"))
            prefix = not value or (space and last[0] == "id" and last[1] not in RESERVED and at + 1 < len(src) and src[at + 1] not in " =\n\t")
            if c in "\"'`":
                end, parts = self._quoted(at + 1, c, c, c != "'")
                kind = "xstr" if c == "`" else "str"
                if end < len(src) and src[end] == ":" and src[end : end + 2] != "::" and kind == "str" and last and last[1] in ("{", ",", "("):
                    self._add("label", src[at + 1 : end - 1] + ":", at, end + 1, space)
                    end += 1
                else:
                    self._add(kind, (src[at + 1 : end - 1], parts), at, end, space)
                at, space = end, False
                continue
            if c == ":" and src[at + 1 : at + 2] == '"':
                end, parts = self._quoted(at + 2, '"', '"', True)
                self._add("sym", src[at + 2 : end - 1] if not parts else None, at, end, space)
                at, space = end, False
                continue
            if c == "%" and prefix and (m := re.match(r"%([wWiIqQr]?)([\[\](){}<>|!/])", src[at:])):
                close = _CLOSE.get(m[2], m[2])
                end, parts = self._quoted(at + m.end(), m[2], close, m[1] not in ("w", "i", "q"))
                body = src[at + m.end() : end - 1]
                if m[1] in ("w", "W", "i", "I"):
                    if parts:
                        raise Unsupported("interpolated word list")
                    self._add("words", (m[1].lower(), body.split()), at, end, space)
                elif m[1] == "r":
                    end += len(re.match(r"[a-z]*", src[end:])[0])
                    self._add("regex", (body, parts), at, end, space)
                else:
                    self._add("str", (body, parts), at, end, space)
                at, space = end, False
                continue
            if c == "/" and prefix:
                end, parts = self._quoted(at + 1, "/", "/", True)
                end += len(re.match(r"[a-z]*", src[end:])[0])
                self._add("regex", (src[at + 1 : end - 1], parts), at, end, space)
                at, space = end, False
                continue
            if c == "<" and prefix and (m := re.match(r"<<([~-])?([\"']?)([A-Z_]\w*)\2", src[at:])) and (m[1] or m[2] or not value):
                self._heredocs.append((m[3], m[2] != "'", len(self.tokens)))
                self._add("str", ("", []), at, at + m.end(), space)
                at, space = at + m.end(), False
                continue
            if src.startswith("=begin", at) and (at == 0 or src[at - 1] == "\n"):
                end = src.find("\n=end", at)
                at = len(src) if end < 0 else end + 5
                continue
            if src.startswith("__END__", at) and (at == 0 or src[at - 1] == "\n"):
                break
            m = _TOKEN.match(src, at)
            if not m:
                raise Unsupported(f"character {c!r}")
            kind = m.lastgroup
            if kind == "label" and last and last[1] == "?" and last[0] == "op":
                m = re.compile(r"[A-Za-z_]\w*[?!]?").match(src, at)
                kind = "const" if m[0][0].isupper() else "id"
            if kind == "label" and (m[0][:-1] in ("else", "then") or self._ternary()):
                m = re.compile(r"[A-Za-z_]\w*[?!]?").match(src, at)
                kind = "const" if m[0][0].isupper() else "id"
            if kind == "sym" and value and not space:
                m, kind = re.compile(":").match(src, at), "op"
            text = m[0]
            if kind == "space":
                at, space = m.end(), True
                continue
            if kind == "comment":
                self.comments.append((at + base, m.end() + base, text))
                at = m.end()
                continue
            if kind == "newline":
                self._add("nl", "\n", at, m.end(), space)
                at, space = m.end(), False
                for name, cooked, where in self._heredocs:
                    end = re.compile(rf"^[ \t]*{name}$", re.M).search(src, at)
                    if not end:
                        raise Malformed(self.tokens[where][2], "unterminated heredoc")
                    body = src[at : end.start()]
                    old = self.tokens[where]
                    self.tokens[where] = ("str", (body, self._parts(body, at) if cooked else []), *old[2:])
                    at = min(end.end() + 1, len(src))
                self._heredocs = []
                continue
            self._add(kind, text, at, m.end(), space)
            at, space = m.end(), False
        self._add("nl", "\n", len(src), len(src), False)
        self._add("eof", "", len(src), len(src), False)

    def _ternary(self) -> bool:
        """An open ``?`` on this line makes ``name:`` its middle part."""
        depth = 0
        for kind, text, *_ in reversed(self.tokens):
            if kind == "nl":
                return False
            if kind == "op" and text in (")", "]", "}"):
                depth += 1
            elif kind == "op" and text in ("(", "[", "{"):
                if depth == 0:
                    return False
                depth -= 1
            elif kind == "op" and text == "?" and depth == 0:
                return True
            elif kind == "op" and text == ":" and depth == 0:
                return False
        return False

    def _add(self, kind, text, start, end, space):
        self.tokens.append((kind, text, start + self.base, end + self.base, space))

    def _quoted(self, at: int, open_: str, close: str, cooked: bool) -> tuple[int, list]:
        src, depth, parts = self.src, 0, []
        while at < len(src):
            c = src[at]
            if c == "\\":
                at += 2
                continue
            if cooked and src.startswith("#{", at):
                end = self._braces(at + 2)
                parts.append((at + 2, src[at + 2 : end - 1]))
                at = end
                continue
            if c == close and depth == 0:
                return at + 1, parts
            if open_ != close and c == open_:
                depth += 1
            elif c == close:
                depth -= 1
            at += 1
        raise Malformed(self.base + len(src), "unterminated string")

    def _parts(self, body: str, base: int) -> list:
        out, at = [], 0
        while (at := body.find("#{", at)) >= 0:
            if at and body[at - 1] == "\\":
                at += 2
                continue
            end = self._braces(base + at + 2) - base
            out.append((base + at + 2, body[at + 2 : end - 1]))
            at = end
        return out

    def _braces(self, at: int) -> int:
        depth = 1
        while at < len(self.src):
            c = self.src[at]
            if c in "\"'":
                at, _ = self._quoted(at + 1, c, c, c == '"')
                continue
            depth += (c == "{") - (c == "}")
            at += 1
            if not depth:
                return at
        raise Malformed(self.base + at, "unterminated interpolation")


class Parser:
    def __init__(self, src: str, base: int = 0):
        lexer = Lexer(src, base)
        self.src, self.base, self.t, self.comments, self.i = src, base, lexer.tokens, lexer.comments, 0

    # -- tokens -----------------------------------------------------------
    def at(self, *texts: str) -> bool:
        k, x = self.t[self.i][:2]
        return k in ("op", "id", "const") and x in texts

    def kw(self, *texts: str) -> bool:
        return self.t[self.i][0] == "id" and self.t[self.i][1] in texts

    def take(self):
        self.i += 1
        return self.t[self.i - 1]

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str, message: str | None = None):
        if not self.at(text):
            if self.t[self.i][0] == "eof" or (message and self.t[self.i][0] == "nl"):
                raise Malformed(self.t[self.i][2], message or f"expected `{text}`")
            raise Unsupported(f"expected {text!r} before {self.t[self.i][1]!r}")
        return self.take()

    def skip(self) -> None:
        while self.t[self.i][0] == "nl" or self.at(";"):
            self.i += 1

    def newlines(self) -> None:
        while self.t[self.i][0] == "nl":
            self.i += 1

    # -- statements -------------------------------------------------------
    def program(self) -> list:
        body = self.statements()
        if self.t[self.i][0] != "eof":
            if self.kw("end"):
                raise Malformed(self.t[self.i][2], "unexpected `end`")
            raise Unsupported(f"unexpected {self.t[self.i][1]!r}")
        return body

    def statements(self, *stops: str) -> list:
        out = []
        while True:
            self.skip()
            if self.t[self.i][0] == "eof" or self.kw("end", "else", "elsif", "when", "in", "rescue", "ensure") or self.at("}", ")"):
                return out
            out.append(self.statement())
            if not (self.t[self.i][0] in ("nl", "eof") or self.at(";", "}", ")") or self.kw("end", "else", "elsif", "when", "rescue", "ensure")):
                raise Unsupported(f"unexpected {self.t[self.i][1]!r}")

    def statement(self):
        node = self.expression_statement()
        while self.kw("if", "unless", "while", "until", "rescue"):
            word, start = self.take()[1], node[1]
            self.newlines()
            other = self.expression_statement()
            end = other[2]
            if word in ("if", "unless"):
                node = ("if", start, end, other, [node], None, word == "unless")
            elif word == "rescue":
                node = ("begin", start, end, [node], [([], None, [other])], None, None)
            else:
                node = ("while", start, end, other, [node])
        return node

    def expression_statement(self):
        left = self.not_expression()
        while self.kw("and", "or"):
            word = self.take()[1]
            self.newlines()
            right = self.not_expression()
            left = ("and" if word == "and" else "or", left[1], right[2], left, right)
        return left

    def not_expression(self):
        if self.kw("not"):
            start = self.take()[2]
            x = self.not_expression()
            return ("not", start, x[2], x)
        return self.expression()

    def expression(self):
        if self.at("*", "(") and self._multiple(True):
            return self._several([])
        left = self.ternary()
        k, text = self.t[self.i][:2]
        if k == "op" and text == "," and left[0] in ("local", "ivar", "call", "const", "index", "gvar") and self._multiple():
            return self._several([left])
        if k == "op" and (text == "=" or text in _ASSIGN):
            self.take()
            self.newlines()
            right = self.expression()
            if self.at(",") and text == "=" and not self._inside:
                items = [right]
                while self.eat(","):
                    self.newlines()
                    items.append(self.ternary())
                right = ("array", right[1], items[-1][2], items)
            if self.kw("rescue"):
                self.take()
                alt = self.expression()
                right = ("begin", right[1], alt[2], [right], [([], None, [alt])], None, None)
            return self._assign(left, text, right)
        return left

    _inside = 0

    def _multiple(self, start: bool = False) -> bool:
        """Does a `=` outside all brackets follow on this line, after a comma or a splat?"""
        if self._inside:
            return False
        j, depth, several = self.i, 0, False
        while self.t[j][0] not in ("nl", "eof"):
            k, x = self.t[j][:2]
            if k == "op":
                depth += x in ("(", "[", "{")
                depth -= x in (")", "]", "}")
                if x == "=" and depth == 0:
                    return several
                if depth < 0 or x == ";" or x in _ASSIGN and depth == 0:
                    return False
                several |= depth == 0 and (x == "," or x == "*" and j == self.i and start)
            elif depth == 0 and k == "id" and x in RESERVED and x not in ("self", "nil", "true", "false"):
                return False
            j += 1
        return False

    def _several(self, targets: list):
        """The targets of a multiple assignment after the first ones, and its values: ("massign", start, end, targets, values)."""
        start = targets[0][1] if targets else self.t[self.i][2]
        if targets:
            self.need(",")
        while not self.at("="):
            targets.append(self._target())
            if not self.eat(","):
                break
        self.need("=")
        self.newlines()
        values = []
        while True:
            if self.at("*"):
                s = self.take()[2]
                x = self.ternary()
                values.append(("splat", s, x[2], x))
            else:
                values.append(self.ternary())
            if not self.eat(","):
                break
            self.newlines()
        return ("massign", start, values[-1][2], targets, values)

    def _target(self):
        s = self.t[self.i][2]
        if self.eat("*"):
            if self.at(",", "=", ")"):
                return ("splat", s, s + 1, ("unknown", s, s, []))
            x = self._target()
            return ("splat", s, x[2], x)
        if self.eat("("):
            inner = [self._target()]
            while self.eat(","):
                if not self.at(")"):
                    inner.append(self._target())
            end = self.need(")")[3]
            return ("targets", s, end, inner)
        return self.postfix(self.primary())

    def _assign(self, left, op, right):
        start, end = left[1], right[2]
        kind = left[0]
        if kind == "call" and left[3] is None and not left[5] and not left[7]:
            left, kind = ("local", left[1], left[2], left[4]), "local"
        if kind in ("local", "ivar", "const", "gvar"):
            return ("assign", start, end, left, op, right)
        if kind == "index":
            return ("call", start, end, left[3], "[]=", [*left[4], right], (left[2] - 1, left[2]), None, {"splat": op != "="})
        if kind == "call":
            return ("attrassign", start, end, left[3], left[4], right, left[6], op)
        raise Unsupported("assignment target")

    def ternary(self):
        cond = self.range_()
        if self.at("?"):
            self.take()
            self.newlines()
            a = self.ternary()
            self.newlines()
            if self.t[self.i][0] == "label":
                raise Unsupported("ternary")
            if self.t[self.i][0] == "sym":
                raise Unsupported("ternary")
            self.need(":")
            self.newlines()
            b = self.ternary()
            return ("if", cond[1], b[2], cond, [a], [b], False)
        return cond

    def range_(self):
        left = self.binary(3)
        if self.at("..", "..."):
            self.take()
            if self.t[self.i][0] in ("nl", "eof") or self.at(")", "]"):
                return ("literal", left[1], left[2] + 2, "Range", [left])
            right = self.binary(3)
            return ("literal", left[1], right[2], "Range", [left, right])
        return left

    def binary(self, least: int):
        left = self.unary()
        while True:
            k, op, s, e, _ = self.t[self.i]
            power = _BINARY.get(op) if k == "op" else None
            if power is None or power < least:
                return left
            self.take()
            self.newlines()
            right = self.binary(power if op == "**" else power + 1)
            if op in ("&&", "||"):
                left = ("and" if op == "&&" else "or", left[1], right[2], left, right)
            elif op in ("!=", "!~"):
                left = ("call", left[1], right[2], left, op, [right], (s, e), None, {})
            else:
                left = ("call", left[1], right[2], left, op, [right], (s, e), None, {"operator": True})

    def unary(self):
        k, text, s, e, _ = self.t[self.i]
        if k == "op" and text == "!":
            self.take()
            x = self.unary()
            return ("not", s, x[2], x)
        if k == "op" and text in ("-", "+", "~"):
            self.take()
            x = self.unary()
            if x[0] == "literal" and x[3] in ("Integer", "Float") and text == "-":
                return ("literal", s, x[2], x[3], [], "-" + str(x[5]))
            return ("call", s, x[2], x, text + "@", [], (s, e), None, {"operator": True})
        if k == "op" and text in ("&", "*", "**"):
            raise Unsupported("splat")
        if self.kw("defined?"):
            self.take()
            paren = self.eat("(")
            x = self.ternary()
            if paren:
                self.need(")")
            return ("defined", s, x[2], x)
        return self.postfix(self.primary())

    # -- calls ------------------------------------------------------------
    def postfix(self, node):
        while True:
            k, text, s, e, space = self.t[self.i]
            if k == "nl":
                j = self.i
                while self.t[j][0] == "nl":
                    j += 1
                if self.t[j][0] == "op" and self.t[j][1] in (".", "&.") :
                    self.i = j
                    continue
                return node
            if k != "op":
                return node
            if text in (".", "&."):
                self.take()
                self.newlines()
                k2, name, ns, ne, _ = self.take()
                if k2 == "op" and name == "(":
                    self.i -= 1
                    name, ns, ne = "call", s, e
                elif k2 == "label":
                    name, ne = name[:-1], ne - 1
                    self.i -= 1
                    self.t[self.i] = ("op", ":", ne, ne + 1, False)
                elif k2 not in ("id", "const") and not (k2 == "op" and name in _BINARY):
                    raise Unsupported("message")
                node = self._call(node, name, ns, ne, text == "&.")
            elif text == "::":
                self.take()
                k2, name, ns, ne, _ = self.take()
                if k2 == "const" and not (self.at("(") and not self.t[self.i][4]):
                    node = ("const", node[1], ne, f"{node[3]}::{name}") if node[0] == "const" else ("unknown", node[1], ne, [node])
                elif k2 in ("id", "const"):
                    node = self._call(node, name, ns, ne, False)
                else:
                    raise Unsupported("scope")
            elif text == "[" and not space:
                self.take()
                args, flags = self._list("]")
                end = self.t[self.i - 1][3]
                node = ("index", node[1], end, node, args) if not flags.get("splat") else ("unknown", node[1], end, [node, *args])
            else:
                return node

    def _call(self, recv, name, ns, ne, safe):
        args, flags, end = [], {"safe": safe} if safe else {}, ne
        if self.at("(") and not self.t[self.i][4]:
            self.take()
            args, more = self._list(")")
            flags |= more
            flags["paren"] = True
            end = self.t[self.i - 1][3]
        elif self._command():
            args, more = self._command_args()
            flags |= more
            end = self.t[self.i - 1][3]
        block = self._block(bool(args) and not flags.get("paren"))
        if block:
            end = block[2]
        return ("call", recv[1] if recv else ns, end, recv, name, args, (ns, ne), block, flags)

    def _command(self) -> bool:
        """Does an argument list without parentheses follow?"""
        k, text, s, e, space = self.t[self.i]
        if not space:
            return False
        if k in ("int", "float", "str", "sym", "const", "ivar", "cvar", "gvar", "label", "words", "regex", "xstr"):
            return True
        if k == "id":
            return text not in RESERVED or text in ("nil", "true", "false", "self", "not", "defined?", "lambda", "proc", "case", "super", "yield", "def", "__FILE__", "__LINE__", "__method__")
        nxt = self.src[e - self.base : e - self.base + 1]
        return k == "op" and (text in ("->", "::") or text in ("[", "-", "*", "&", "**", "!") and nxt not in ("", " ", "\n", "="))

    def _command_args(self):
        args, flags = [], {}
        while True:
            self._argument(args, flags)
            if not self.eat(","):
                return args, flags
            self.newlines()

    def _list(self, close: str):
        args, flags = [], {}
        self._inside += 1
        self.newlines()
        while not self.at(close):
            if self.t[self.i][0] == "eof":
                raise Malformed(self.t[self.i][2], f"expected `{close}`")
            self._argument(args, flags)
            self.newlines()
            if not self.eat(","):
                break
            self.newlines()
        self.newlines()
        self.need(close)
        self._inside -= 1
        return args, flags

    def _argument(self, args, flags) -> None:
        k, text, s, e, _ = self.t[self.i]
        if k == "op" and text in ("*", "**", "&"):
            self.take()
            flags["splat" if text != "&" else "blockarg"] = True
            if not self.at(",", ")") and self.t[self.i][0] != "nl":
                x = self.ternary()
                args.append(("splat", s, x[2], x)) if text != "&" else flags.setdefault("extra", []).append(x)
            return
        if k == "op" and text == "...":
            self.take()
            flags["splat"] = True
            return
        if k == "label":
            self.take()
            flags["keywords"] = True
            if self.at(",", ")") or self.t[self.i][0] == "nl":
                flags.setdefault("extra", []).append(("call", s, e - 1, None, text[:-1], [], (s, e - 1), None, {}))
                return
            self.newlines()
            flags.setdefault("extra", []).append(self.ternary())
            flags.setdefault("named", []).append((text[:-1], flags["extra"][-1]))
            return
        x = self.not_expression()
        if self.at("=>"):
            self.take()
            self.newlines()
            flags["keywords"] = True
            flags.setdefault("extra", []).extend([x, self.ternary()])
            return
        args.append(x)

    def _block(self, command: bool = False):
        if self.at("{") and not command:
            start = self.take()[2]
            params = self._block_params()
            inside, self._inside = self._inside, 0
            body = self.statements()
            self._inside = inside
            return ("block", start, self.need("}")[3], params, body)
        if self.kw("do") and not getattr(self, "_no_do", 0):
            start = self.take()[2]
            params = self._block_params()
            inside, self._inside = self._inside, 0
            body = self._body()
            self._inside = inside
            end = self._end(start)
            return ("block", start, end, params, body)
        return None

    def _block_params(self) -> list[str]:
        out = []
        self.newlines() if self.at("|") else None
        if self.eat("||"):
            return out
        if self.eat("|"):
            depth = 0
            while not (self.at("|") and depth == 0):
                k, text = self.take()[:2]
                if k == "eof":
                    raise Malformed(self.t[self.i - 1][2], "expected `|`")
                depth += text == "("
                depth -= text == ")"
                if k == "id" or k == "label":
                    out.append(text.rstrip(":"))
                elif k not in ("op", "nl") and k not in ("int", "str", "sym", "const"):
                    raise Unsupported("block parameter")
            self.take()
        return out

    def _end(self, start: int) -> int:
        self.skip()
        if not self.kw("end"):
            if self.t[self.i][0] == "eof":
                raise Malformed(self.t[self.i][2], "expected `end`")
            raise Unsupported(f"expected end before {self.t[self.i][1]!r}")
        return self.take()[3]

    def _body(self) -> list:
        """Statements with optional rescue, else and ensure parts."""
        start = self.t[self.i][2]
        body = self.statements()
        if not self.kw("rescue", "ensure", "else"):
            return body
        rescues, other, ensure = [], None, None
        while self.kw("rescue"):
            self.take()
            classes, name = [], None
            while not (self.t[self.i][0] == "nl" or self.at(";", "=>") or self.kw("then")):
                if self.at("*"):
                    raise Unsupported("rescue splat")
                classes.append(self.ternary())
                if not self.eat(","):
                    break
                self.newlines()
            if self.eat("=>"):
                name = self.take()[1]
            self.eat("then")
            rescues.append((classes, name, self.statements()))
        if self.kw("else"):
            self.take()
            other = self.statements()
        if self.kw("ensure"):
            self.take()
            ensure = self.statements()
        return [("begin", start, self.t[self.i][2], body, rescues, other, ensure)]

    # -- primaries --------------------------------------------------------
    def primary(self):
        k, text, s, e, space = self.take()
        if k == "int":
            return ("literal", s, e, "Integer", [], text)
        if k == "float":
            return ("literal", s, e, "Float", [], text)
        if k in ("str", "xstr"):
            parts = self._interpolated(text[1])
            while self.t[self.i][0] == "str":
                more = self.take()
                parts, e = parts + self._interpolated(more[1][1]), more[3]
            return ("literal", s, e, "String", parts, None if parts else text[0])
        if k == "regex":
            return ("literal", s, e, "Regexp", self._interpolated(text[1]))
        if k == "sym":
            return ("literal", s, e, "Symbol", [], text[1:] if text and text[0] == ":" else text)
        if k == "words":
            return ("array", s, e, [("literal", s, e, "String" if text[0] == "w" else "Symbol", [], w) for w in text[1]])
        if k == "ivar":
            return ("ivar", s, e, text)
        if k in ("cvar", "gvar"):
            return ("gvar", s, e, text)
        if k == "const":
            if self.at("(") and not self.t[self.i][4]:
                return self._call(None, text, s, e, False)
            return ("const", s, e, text)
        if k == "op":
            return self._primary_op(text, s, e)
        if k == "label":
            raise Unsupported("label")
        if k != "id":
            raise Unsupported(f"unexpected {text!r}")
        return self._word(text, s, e)

    def _interpolated(self, parts) -> list:
        out = []
        for at, src in parts:
            p = Parser(src, self.base + at)
            out += p.program()
        return out

    def _primary_op(self, text, s, e):
        if text == "(":
            inside, self._inside = self._inside, 0
            body = self.statements()
            self._inside = inside
            end = self.need(")")[3]
            return ("begin", s, end, body, [], None, None)
        if text == "[":
            args, flags = self._list("]")
            end = self.t[self.i - 1][3]
            return ("array", s, end, args) if not flags.get("keywords") else ("unknown", s, end, args + flags.get("extra", []))
        if text == "{":
            return self._hash(s)
        if text == "->":
            params: list[str] = []
            if self.eat("("):
                while not self.at(")"):
                    k, x = self.take()[:2]
                    if k == "eof":
                        raise Malformed(self.t[self.i - 1][2], "expected `)`")
                    if k in ("id", "label"):
                        params.append(x.rstrip(":"))
                self.take()
            while self.t[self.i][0] == "id" and not self.kw("do"):
                params.append(self.take()[1])
                self.eat(",")
            block = self._block()
            if not block:
                raise Unsupported("lambda")
            return ("lambda", s, block[2], ("block", block[1], block[2], params + block[3], block[4]))
        if text == "::":
            name = self.take()
            if name[0] != "const":
                raise Unsupported("scope")
            return ("const", s, name[3], "::" + name[1])
        if text == "..":
            raise Unsupported("beginless range")
        raise Unsupported(f"unexpected {text!r}")

    def _hash(self, s):
        pairs, splat = [], False
        self._inside += 1
        self.newlines()
        while not self.at("}"):
            if self.t[self.i][0] == "eof":
                raise Malformed(self.t[self.i][2], "expected `}`")
            k, text, ks, ke, _ = self.t[self.i]
            if self.at("**"):
                self.take()
                pairs.append((None, self.ternary()))
                splat = True
            elif k == "label":
                self.take()
                self.newlines()
                key = ("literal", ks, ke, "Symbol", [], text[:-1])
                pairs.append((key, ("unknown", ks, ke, []) if self.at(",", "}") else self.ternary()))
            else:
                key = self.ternary()
                self.newlines()
                self.need("=>")
                self.newlines()
                pairs.append((key, self.ternary()))
            self.newlines()
            if not self.eat(","):
                break
            self.newlines()
        self.newlines()
        self._inside -= 1
        return ("hash", s, self.need("}")[3], pairs, splat)

    def _word(self, text, s, e):
        if text in ("nil", "true", "false"):
            return ("literal", s, e, "nil" if text == "nil" else "bool", [], text)
        if text == "self":
            return ("self", s, e)
        if text == "__LINE__":
            return ("literal", s, e, "Integer", [], "0")
        if text in ("__FILE__", "__method__"):
            return ("literal", s, e, "String", [])
        if text == "class":
            return self._class(s)
        if text == "module":
            name = self._path()
            body = self.statements()
            return ("module", s, self._end(s), name, body)
        if text == "def":
            return self._def(s)
        if text in ("if", "unless"):
            cond = self._condition()
            self.eat("then")
            body = self.statements()
            other = self._else()
            return ("if", s, self._end(s), cond, body, other, text == "unless")
        if text in ("while", "until"):
            cond = self._condition()
            self.eat("do")
            body = self.statements()
            return ("while", s, self._end(s), cond, body)
        if text == "for":
            name = self.take()
            if name[0] != "id" or not self.kw("in"):
                raise Unsupported("for")
            self.take()
            x = self._condition()
            self.eat("do")
            body = self.statements()
            return ("for", s, self._end(s), name[1], x, body)
        if text == "case":
            return self._case(s)
        if text == "begin":
            body = self._body()
            return ("begin", s, self._end(s), body, [], None, None)
        if text in ("return", "break", "next"):
            args = []
            if not (self.t[self.i][0] in ("nl", "eof") or self.at(";", "}", ")") or self.kw("if", "unless", "end", "while", "until")):
                args.append(self.expression())
                while not self._inside and self.eat(","):
                    args.append(self.ternary())
            return (text if text == "return" else "jump", s, args[-1][2] if args else e, args)
        if text in ("redo", "retry"):
            return ("jump", s, e, [])
        if text == "yield" or text == "super":
            node = self._call(None, text, s, e, False)
            return ("unknown", s, node[2], [*node[5], *node[8].get("extra", []), *([node[7]] if node[7] else [])], text)
        if text == "alias":
            a, b = self.take(), self.take()
            return ("alias", s, b[3], a[1].lstrip(":"), b[1].lstrip(":"))
        if text in RESERVED:
            if text == "end":
                raise Malformed(s, "unexpected `end`")
            raise Unsupported(text)
        return self._call(None, text, s, e, False)

    def _condition(self):
        old, self._no_do = getattr(self, "_no_do", 0), 1
        x = self.expression_statement()
        self._no_do = old
        return x

    def _else(self):
        if self.kw("elsif"):
            s = self.take()[2]
            cond = self._condition()
            self.eat("then")
            body = self.statements()
            other = self._else()
            return [("if", s, self.t[self.i][2], cond, body, other, False)]
        if self.kw("else"):
            self.take()
            return self.statements()
        return None

    def _case(self, s):
        subject = None if self.t[self.i][0] == "nl" else self.expression_statement()
        self.skip()
        whens, other = [], None
        if self.kw("in"):
            return self._patterns(s, subject)
        while self.kw("when"):
            self.take()
            conds = [self.ternary()]
            while self.eat(","):
                self.newlines()
                conds.append(self.ternary())
            self.eat("then")
            whens.append((conds, self.statements()))
        if self.kw("else"):
            self.take()
            other = self.statements()
        return ("case", s, self._end(s), subject, whens, other)

    def _patterns(self, s, subject):
        """``case`` with patterns: ("casein", start, end, subject, branches, other), a branch being (bound names, guard, body)."""
        branches, other = [], None
        while self.kw("in"):
            self.take()
            names, depth, guard = [], 0, None
            while True:
                k, text = self.t[self.i][:2]
                if k == "eof":
                    raise Malformed(self.t[self.i][2], "expected `end`")
                if depth == 0 and (k == "nl" or self.at(";") or self.kw("then", "if", "unless")):
                    break
                if k == "op":
                    depth += text in ("(", "[", "{")
                    depth -= text in (")", "]", "}")
                elif k in ("id", "label") and text.rstrip(":") not in RESERVED:
                    names.append(text.rstrip(":"))
                self.take()
            if self.kw("if", "unless"):
                self.take()
                guard = self.expression_statement()
            self.eat("then")
            branches.append((names, guard, self.statements()))
        if self.kw("else"):
            self.take()
            other = self.statements()
        return ("casein", s, self._end(s), subject, branches, other)

    def _path(self) -> tuple:
        name = ""
        if self.eat("::"):
            name = "::"
        k, text, s, e, _ = self.take()
        if k != "const":
            raise Unsupported("class name")
        name += text
        while self.eat("::"):
            k, text, _, e, _ = self.take()
            if k != "const":
                raise Unsupported("class name")
            name += "::" + text
        return (name, s, e)

    def _class(self, s):
        if self.eat("<<"):
            if not self.kw("self"):
                raise Unsupported("singleton class")
            self.take()
            body = self.statements()
            return ("sclass", s, self._end(s), body)
        name = self._path()
        parent = None
        if self.eat("<"):
            parent = self.ternary()
        body = self._body()
        return ("class", s, self._end(s), name, parent, body)

    def _def(self, s):
        k, text, ns, ne, _ = self.take()
        singleton = False
        if k == "id" and text == "self" and self.at("."):
            self.take()
            singleton = True
            k, text, ns, ne, _ = self.take()
        if k == "label":
            raise Unsupported("method name")
        if k not in ("id", "const") and not (k == "op" and text in _BINARY or text in ("!", "+", "-", "~", "[")):
            raise Unsupported("method name")
        if k == "op" and text == "[":
            self.need("]")
            text, ne = "[]", ne + 1
        if self.at("@") or (k == "op" and self.t[self.i][0] == "ivar"):
            raise Unsupported("method name")
        if self.at("=") and self.t[self.i][2] == ne and k in ("id", "const", "op"):
            nxt = self.t[self.i + 1]
            if nxt[1] == "(" or nxt[0] == "id" and not self.t[self.i + 1][4]:
                self.take()
                text, ne = text + "=", ne + 1
        params = []
        if self.at("("):
            self.take()
            params = self._params(")")
        elif not (self.t[self.i][0] == "nl" or self.at(";", "=")):
            params = self._params(None)
        if self.eat("="):
            self.newlines()
            x = self.statement()
            return ("def", s, x[2], text, (ns, ne), singleton, params, [x])
        body = self._body()
        return ("def", s, self._end(s), text, (ns, ne), singleton, params, body)

    def _params(self, close) -> list:
        """(kind, name, default): req opt rest post key keyopt kwrest block forward."""
        out = []
        self._inside += 1
        while True:
            if close:
                if self.t[self.i][0] == "nl":
                    # A parameter list may span lines only after its opening or a comma.
                    if self.t[self.i - 1][1] not in ("(", ","):
                        j = self.i
                        while self.t[j][0] == "nl":
                            j += 1
                        if not (self.t[j][0] == "op" and self.t[j][1] in (close, ",")):
                            raise Malformed(self.t[self.i][2], f"expected `{close}` to close the parameters")
                    self.newlines()
                if self.eat(close):
                    break
            elif self.t[self.i][0] == "nl" or self.at(";"):
                break
            k, text, s, e, _ = self.take()
            if k == "op" and text in ("*", "**", "&"):
                name = self.take()[1] if self.t[self.i][0] == "id" else None
                out.append(({"*": "rest", "**": "kwrest", "&": "block"}[text], name, None))
            elif k == "op" and text == "...":
                out.append(("forward", None, None))
            elif k == "label":
                if self.at(",") or (close and self.at(close)) or self.t[self.i][0] == "nl":
                    out.append(("key", text[:-1], None))
                else:
                    out.append(("keyopt", text[:-1], self.ternary()))
            elif k == "id" and text not in RESERVED:
                if self.eat("="):
                    out.append(("opt", text, self.ternary()))
                else:
                    out.append(("req", text, None))
            elif k == "eof" or (k == "id" and text in RESERVED and close):
                raise Malformed(s, f"expected `{close or 'a line end'}` to close the parameters")
            else:
                raise Unsupported("parameter")
            if not self.eat(","):
                if close and self.t[self.i][0] == "nl":
                    continue
                if close:
                    if self.t[self.i][0] == "eof":
                        raise Malformed(self.t[self.i][2], f"expected `{close}` to close the parameters")
                    self.need(close)
                break
            self.newlines()
        self._inside -= 1
        return out


def parse(src: str) -> tuple[list, list]:
    """Statements and comments of a source text."""
    p = Parser(src)
    return p.program(), p.comments
