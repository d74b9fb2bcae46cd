"""From source text to fact tables, one file at a time.

The walk does what depends on one file alone: nesting, parameters, local flow and
narrowing.  Types that need the rest of the project stay symbolic, as expressions
(``exprs``) that :mod:`factloom.plans.program` resolves with joins.  A file outside
the parser's subset yields opaque fragments (its classes are open), never a guess.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import core
from factloom.sources import rbs, sorbet
from factloom.sources.ruby import Malformed, Unsupported, parse

_S, _L, _B, _A = T.StringType(), T.LongType(), T.BooleanType(), T.ArrayType(T.StringType())
TABLES = {
    "fragments": [("class_path", _S), ("kind", _S), ("superclass", _S), ("nesting", _A), ("open_reason", _S), ("start", _L)],
    "mixins": [("class_path", _S), ("kind", _S), ("target", _S), ("nesting", _A), ("ord", _L)],
    "methods": [("class_path", _S), ("name", _S), ("singleton", _B), ("required", _L), ("optional", _L), ("rest", _B), ("arity_unknown", _B), ("abstract", _B), ("params", _A), ("param_types", _A), ("declared", _S), ("ret", _S), ("start", _L), ("end", _L), ("name_start", _L), ("name_end", _L), ("nesting", _A), ("sig_types", _A), ("sig_returns", _S), ("points", _A)],
    "consts": [("name", _S), ("alias_of", _S), ("nesting", _A), ("start", _L)],
    "const_refs": [("name", _S), ("nesting", _A), ("start", _L), ("end", _L)],
    "calls": [("id", _S), ("recv", _S), ("recv_kind", _S), ("name", _S), ("given", _L), ("exact", _B), ("args", _A), ("literals", _A), ("start", _L), ("end", _L), ("class_path", _S), ("singleton", _B), ("scope", _S), ("local", _S), ("silent", _B)],
    "exprs": [("id", _S), ("op", _S), ("name", _S), ("operands", _A), ("nesting", _A), ("start", _L), ("end", _L), ("shape", _S)],
    "ivars": [("class_path", _S), ("name", _S), ("expr", _S)],
    "anywhere": [("kind", _S), ("name", _S), ("nesting", _A)],
    "errors": [("code", _S), ("start", _L), ("end", _L), ("message", _S)],
}
STRUCTS = {k: T.StructType([T.StructField(n, t) for n, t in v]) for k, v in TABLES.items()}
SCHEMA = T.StructType([T.StructField("path", _S), *(T.StructField(k, T.ArrayType(v)) for k, v in STRUCTS.items())])

_OPAQUE = re.compile(r"^\s*(class|module)\s+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)", re.M)
# Calls in a class body that define methods in ways the walk knows, or that change nothing it reads.
PLAIN_MACROS = frozenset("private public protected private_constant private_class_method public_class_method module_function attr_reader attr_writer attr_accessor include extend prepend require require_relative autoload freeze puts raise define_method alias_method".split())
# Calls by which code gives a class more methods.
DEFINERS = frozenset("include extend prepend define_method define_singleton_method attr_reader attr_writer attr_accessor class_eval module_eval class_exec module_exec instance_eval instance_exec alias_method delegate class_attribute mattr_accessor cattr_accessor".split())
# Calls that define readers and writers on a class and its instances.
ACCESSORS = frozenset("mattr_accessor mattr_reader mattr_writer cattr_accessor cattr_reader cattr_writer class_attribute thread_mattr_accessor".split())
# Methods a module answers when it is mixed in; what they do to the host is not followed.
HOOKS = frozenset("included extended prepended inherited method_added append_features extend_object".split())
# Calls that make the locals of a scope unreadable.
OPAQUE_CALLS = frozenset("eval binding instance_eval class_eval local_variable_set instance_exec".split())


class Walk:
    def __init__(self, path: str):
        self.path, self.n = path, 0
        self.ops: dict[str, tuple[str, str | None]] = {}
        self.out: dict[str, list] = {k: [] for k in TABLES}

    def add(self, table: str, *row) -> None:
        names = [n for n, _ in TABLES[table]]
        self.out[table].append(dict(zip(names, [*row, *[None] * (len(names) - len(row))], strict=True)))

    def expr(self, op: str, name: str | None, operands: list[str], nesting=(), at: tuple[int, int] = (0, 0), shape: str | None = None) -> str:
        self.n += 1
        key = f"{self.path}#{self.n}"
        self.add("exprs", key, op, name, operands, list(nesting), *at, shape)
        self.ops[key] = (op, name)
        return key

    def atom(self, name: str) -> str:
        return self.expr("atom", name, [])

    # -- class bodies -----------------------------------------------------
    def body(self, nodes: list, nesting: list[str], class_path: str | None, in_singleton: bool = False) -> None:
        frag, env, visibility = None, Env(), False
        if class_path is not None and not in_singleton:
            frag = self.out["fragments"][-1]
        for node in nodes:
            kind = node[0]
            if kind in ("class", "module"):
                self.definition(node, nesting)
            elif kind == "sclass" and class_path is not None:
                self.body(node[3], nesting, class_path, True)
            elif kind == "def":
                self.method(node, nesting, class_path, in_singleton or visibility == "module_function")
            elif kind == "alias" and class_path is not None:
                self.add("methods", class_path, node[3], in_singleton, 0, 0, True, True, False, [], [], None, None, node[1], node[2], node[1], node[2], nesting)
            elif kind == "assign" and node[3][0] == "const":
                name = "::".join([*nesting[-1:], node[3][3]])
                self.add("consts", name, node[5][3] if node[5][0] == "const" else None, nesting, node[1])
                self.value(node[5], env, Scope(nesting, class_path, True, self.path))
            elif kind == "call" and node[3] is None and class_path is not None:
                visibility = self.macro(node, nesting, class_path, in_singleton, frag, env) or visibility
            elif class_path is None or kind in ("literal", "const", "assign", "massign"):
                self.value(node, env, Scope(nesting, class_path, class_path is not None, self.path))
            else:
                self.open(frag, "ClassBodyBlock")
                self.value(node, env, Scope(nesting, class_path, True, self.path))

    def open(self, frag: dict | None, reason: str) -> None:
        if frag is not None and frag["open_reason"] is None:
            frag["open_reason"] = reason

    def definition(self, node, nesting: list[str]) -> None:
        name = node[3][0]
        path = name[2:] if name.startswith("::") else "::".join([*nesting[-1:], name])
        parent, body, reason = None, node[4], None
        if node[0] == "class":
            body = node[5]
            if node[4] is not None:
                if node[4][0] == "const":
                    parent = node[4][3]
                    self.add("const_refs", parent, nesting, node[4][1], node[4][2])
                else:
                    reason = "DynamicSuperclass"
        self.add("fragments", path, node[0], parent, list(nesting), reason, node[1])
        frag = self.out["fragments"][-1]
        mark = len(self.out["fragments"])
        self.body_of(body, [*nesting, path], path, frag)
        assert self.out["fragments"][mark - 1] is frag

    def body_of(self, body, nesting, path, frag) -> None:
        """Walk a body whose fragment is not the last one once nested classes are met."""
        outer = self.out["fragments"]
        env, visibility = Env(), None
        for node in body:
            kind = node[0]
            if kind == "call" and node[3] is None:
                visibility = self.macro(node, nesting, path, False, frag, env) or visibility
            elif kind == "def" and visibility == "module_function":
                self.method(node, nesting, path, True)
                self.method(node, nesting, path, False)
            elif kind in ("class", "module", "sclass", "def", "alias", "literal", "const") or (kind == "assign" and node[3][0] == "const"):
                self.body([node], nesting, path) if kind != "def" else self.method(node, nesting, path, False)
            elif kind in ("assign", "massign"):
                self.value(node, env, Scope(nesting, path, True, self.path))
            else:
                self.open(frag, "ClassBodyBlock")
                self.value(node, env, Scope(nesting, path, True, self.path))
        assert outer is self.out["fragments"]

    def macro(self, node, nesting, class_path, in_singleton, frag, env) -> str | None:
        name, args = node[4], node[5]
        literal = [a[5] for a in args if a[0] == "literal" and a[3] in ("Symbol", "String") and a[5] is not None and not a[4]]
        all_literal = len(literal) == len(args) and not node[8].get("splat")
        at = (node[1], node[2], *node[6], nesting)
        add = lambda n, req, rest=False, unknown=False: self.add("methods", class_path, n, in_singleton, req, 0, rest, unknown, False, [], [], None, None, at[0], at[1], at[2], at[3], nesting)
        if name == "sig" and node[7]:
            self.contract = sorbet.contract(node[7][4])
            return None
        if name in ("include", "prepend", "extend"):
            for a in args:
                if a[0] == "const":
                    self.add("mixins", class_path, "extend" if in_singleton else name, a[3], nesting, a[1])
                    self.add("const_refs", a[3], nesting, a[1], a[2])
                elif a[0] == "self" and name == "extend":
                    self.add("mixins", class_path, name, "::" + class_path, nesting, a[1])
                else:
                    self.open(frag, "DynamicMixinArg")
            return None
        if name in ("attr_reader", "attr_writer", "attr_accessor"):
            if not all_literal:
                self.open(frag, "DynamicAttrArg")
            for x in literal:
                if name != "attr_writer":
                    add(x, 0)
                if name != "attr_reader":
                    add(x + "=", 1)
            return None
        if name in ACCESSORS and literal and not node[8].get("splat"):
            # Options only take some of these away; what may be there is never accused.
            for x in literal:
                for n, req in ((x, 0), (x + "=", 1), *([(x + "?", 0)] if name == "class_attribute" else [])):
                    for single in (False, True):
                        self.add("methods", class_path, n, single or in_singleton, req, 0, False, True, False, [], [], None, None, *at)
            scope = Scope(nesting, class_path, True, self.path)
            for a in [*args, *node[8].get("extra", [])]:
                self.value(a, env, scope)
            return None
        if name == "delegate" and literal and not node[8].get("splat"):
            # With a prefix the names are others.
            if re.search(r"\bprefix\b", self.text[node[1] : node[2]]):
                self.open(frag, "UnknownClassBodyCall")
            for x in literal:
                add(x, 0, True, True)
            return None
        if name == "define_method":
            if len(literal) < 1:
                self.open(frag, "DynamicDefineMethod")
            else:
                add(literal[0], 0, True, True)
        elif name == "alias_method":
            if len(literal) != 2:
                self.open(frag, "DynamicAliasMethod")
            else:
                add(literal[0], 0, True, True)
        elif name == "module_function" and not args:
            return "module_function"
        elif name == "module_function":
            for x in literal:
                self.add("methods", class_path, x, True, 0, 0, True, True, False, [], [], None, None, *at)
            for a in args:
                if a[0] == "def":
                    self.method(a, nesting, class_path, True)
                    self.method(a, nesting, class_path, False)
            return None
        elif name in ("private", "public", "protected") and args and args[0][0] == "def":
            self.method(args[0], nesting, class_path, in_singleton)
            return None
        elif name not in PLAIN_MACROS:
            self.open(frag, "UnknownClassBodyCall")
        scope = Scope(nesting, class_path, True, self.path)
        for a in [*args, *node[8].get("extra", [])]:
            if a[0] != "def":
                self.value(a, env, scope)
        if node[7] and name != "define_method":
            self.block(node[7], env, scope, True)
        return None

    # -- methods ----------------------------------------------------------
    def method(self, node, nesting, class_path, singleton) -> None:
        _, start, end, name, (ns, ne), own, params, body = node
        singleton = singleton or own
        contract, self.contract = getattr(self, "contract", None), None
        kinds = [k for k, _, _ in params]
        unknown = "forward" in kinds or "key" in kinds or "keyopt" in kinds or "kwrest" in kinds
        sig = self.sigs.get(self.line(start) - 1)
        types, declared, sig_unknown = [], None, False
        if sig is not None:
            try:
                parsed = rbs.signature(sig[2])
                types, declared = [rbs.render(t) for _, t in parsed.params], rbs.render(parsed.returns)
            except rbs.Invalid as e:
                self.add("errors", "E0105", sig[0], sig[1], f"invalid RBS signature comment: {e}")
                sig_unknown = True
        scope = Scope(nesting, class_path, singleton, f"{self.path}:{start}", instance=not singleton)
        env = Env()
        k = 0
        for kind, p, default in params:
            if default is not None:
                self.value(default, env, scope)
            t = None
            if kind in ("req", "opt"):
                t = types[k] if k < len(types) else None
                k += 1
            if p:
                env.set(p, self.expr("declared", t, [], nesting) if t else None)
        scope.opaque = _mentions(body, OPAQUE_CALLS)
        scope.kept = kept_elements([d for _, _, d in params if d is not None], body)
        abstract = len(body) == 1 and body[0][0] == "call" and body[0][4] == "raise" and bool(body[0][5]) and body[0][5][0][0] == "const" and body[0][5][0][3] == "NotImplementedError"
        tail = self.block_value(body, env, scope)
        ret = self.union([tail, *scope.returns]) if not sig_unknown else None
        names = [p for kind, p, _ in params if kind in ("req", "opt")]
        self.add("methods", class_path or "Object", name, singleton, kinds.count("req"), kinds.count("opt"), "rest" in kinds, unknown, abstract, names, types, declared, ret, start, end, ns, ne, nesting, [contract.params.get(n, "untyped") for n in names] if contract else None, contract.returns if contract else None, points(body) if contract else None)
        if name in HOOKS and singleton:
            self.add("anywhere", "hook", class_path, nesting)
        if name == "const_missing" and singleton:
            self.add("anywhere", "const_missing", class_path, nesting)
        if name == "method_missing" or name == "respond_to_missing?":
            for frag in self.out["fragments"]:
                if frag["class_path"] == class_path:
                    self.open(frag, "MethodMissing")

    def union(self, parts: list[str | None]) -> str | None:
        if any(p is None for p in parts):
            return None
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else self.expr("union", None, parts)

    def block_value(self, nodes: list, env, scope) -> str | None:
        out = self.atom("nil")
        for n in nodes:
            out = self.value(n, env, scope)
        return out

    # -- expressions ------------------------------------------------------
    def value(self, node, env, scope) -> str | None:
        """The symbolic type of a node: an expression id, or None where unknown."""
        kind, at = node[0], (node[1], node[2])
        handler = getattr(self, f"_{kind}", None)
        if handler:
            return handler(node, env, scope, at)
        if kind == "unknown" or kind == "splat":
            for x in node[3] if isinstance(node[3], list) else [node[3]]:
                if x and x[0] == "block":
                    self.block(x, env, scope, True)
                elif x:
                    self.value(x, env, scope)
        return None

    def _literal(self, node, env, scope, at):
        for x in node[4] if len(node) > 4 else []:
            self.value(x, env, scope)
        return self.atom(node[3]) if node[3] in ("Integer", "Float", "String", "Symbol", "nil", "bool") else None

    def _self(self, node, env, scope, at):
        if scope.class_path is None or scope.rebound:
            return None
        return self.expr("self", scope.class_path if scope.instance else f"Class[{scope.class_path}]", [])

    def _const(self, node, env, scope, at):
        if not scope.guarded(node[3]):
            self.add("const_refs", node[3], scope.nesting, *at)
        return self.expr("const", node[3], [], scope.nesting, at)

    def _array(self, node, env, scope, at):
        return self.collection("array", [(x, self.value(x, env, scope)) for x in node[3]], at)

    def _hash(self, node, env, scope, at):
        pairs = [((k, self.value(k, env, scope)) if k else None, (v, self.value(v, env, scope))) for k, v in node[3]]
        if any(k is None for k, _ in pairs):  # `**rest`
            return self.atom("Hash")
        return self.collection("hash", [x for pair in pairs for x in pair], at)

    def collection(self, op: str, held: list[tuple], at) -> str:
        """A literal array or hash by the types of what is written in it; equal literals are one operand (pairs of a hash keep together)."""
        name, width = ("Array", 1) if op == "array" else ("Hash", 2)
        if not held or any(x[0] == "splat" for x, _ in held) or (op == "array" and any(v is None for _, v in held)):
            return self.atom(name)
        seen, operands = set(), []
        for lo in range(0, len(held), width):
            ids = [v or "" for _, v in held[lo : lo + width]]
            key = tuple(self.ops[v] if v and self.ops[v][0] == "atom" else v for v in ids)
            if key not in seen:
                seen.add(key)
                operands += ids
        return self.expr(op, None, operands, at=at)

    def erased(self, v: str | None) -> str | None:
        """``v`` without what a collection in it holds, for what others may change."""
        return self.expr("erase", None, [v]) if v and self.ops[v][0] in ("array", "hash", "call", "union", "strip", "minus") else v

    def bound(self, name: str, v: str | None, env, scope) -> None:
        """A local is given a value: it keeps what a collection holds only where all of its reads leave that alone."""
        v = v if scope.kept is not None and name in scope.kept else self.erased(v)
        env.set(name, v)
        scope.writes.setdefault(name, []).append(v)

    def _index(self, node, env, scope, at):
        return self._call(("call", node[1], node[2], node[3], "[]", node[4], (node[2] - 1, node[2]), None, {}), env, scope, at)

    def _local(self, node, env, scope, at):
        return None if scope.opaque else env.get(node[3])

    def _ivar(self, node, env, scope, at):
        return self.expr("ivar", f"{scope.class_path}{node[3]}", []) if scope.class_path and scope.instance and not scope.rebound else None

    def _assign(self, node, env, scope, at):
        _, _, _, target, op, right = node
        if target[0] == "local":
            env.known.setdefault(target[3], None)  # it is a local from here on, also in its own value
        v = self.value(right, env, scope)
        cast = self.casts.get(self.line(max(node[2] - 1, 0)))
        if cast and op == "=":
            v = self.expr("strip", None, [v]) if cast == "!nil" and v else None if cast in ("!nil", "untyped") else self.expr("declared", cast, [], scope.nesting)
        if op == "||=":
            old = env.get(target[3]) if target[0] == "local" else None
            v = self.union([self.expr("strip", None, [old]), v]) if old and v else None
        elif op != "=":
            v = None
        if target[0] == "local":
            self.bound(target[3], v, env, scope)
        elif target[0] == "ivar" and scope.class_path:
            self.add("ivars", scope.class_path, target[3], v if scope.instance and not scope.rebound else None)
        return self.erased(v) if op == "||=" else v

    def _massign(self, node, env, scope, at):
        _, _, _, targets, values = node
        for name in _locals(targets):
            env.known.setdefault(name, None)
        got = [self.value(v, env, scope) for v in values]
        plain = len(values) > 1 and all(v[0] != "splat" for v in values)
        spread = next((k for k, t in enumerate(targets) if t[0] == "splat"), None)
        for k, t in enumerate(targets):
            v = None
            if plain and (spread is None or k < spread):
                v = got[k] if k < len(got) else self.atom("nil")
            elif plain and k > spread and len(got) >= len(targets) - 1:
                v = got[k - len(targets)]
            self._bind(t, v, env, scope)
        return self.atom("Array") if len(values) > 1 else got[0]

    def _bind(self, target, v, env, scope) -> None:
        """One target of a multiple assignment gets a type; what is taken apart further is unknown."""
        kind = target[0]
        if kind == "splat":
            self._bind(target[3], self.atom("Array"), env, scope)
        elif kind == "targets":
            for t in target[3]:
                self._bind(t, None, env, scope)
        elif kind == "local" or kind == "call" and target[3] is None and not target[5] and not target[7]:
            self.bound(target[3] if kind == "local" else target[4], v, env, scope)
        elif kind == "ivar":
            if scope.class_path:
                self.add("ivars", scope.class_path, target[3], v if scope.instance and not scope.rebound else None)
        elif kind == "const":
            self.add("consts", "::".join([*scope.nesting[-1:], target[3]]), None, scope.nesting, target[1])
        elif kind == "call":
            self._call(("call", target[1], target[2], target[3], target[4] + "=", [], target[6], None, {"splat": True}), env, scope, (target[1], target[2]))
        elif kind == "index":
            self._call(("call", target[1], target[2], target[3], "[]=", target[4], (target[2] - 1, target[2]), None, {"splat": True}), env, scope, (target[1], target[2]))

    def _casein(self, node, env, scope, at):
        """Patterns bind names and may narrow anything: from here on every local is unknown."""
        _, _, _, subject, branches, other = node
        if subject:
            self.value(subject, env, scope)
        for k in [*env.known, *(n for names, _, _ in branches for n in names)]:
            env.set(k, None)
        for _, guard, body in branches:
            inner = env.copy()
            if guard:
                self.value(guard, inner, scope)
            self.block_value(body, inner, scope)
            self.join(env, [env.copy(), inner])
        if other is not None:
            inner = env.copy()
            self.block_value(other, inner, scope)
            self.join(env, [env.copy(), inner])
        return None

    def _attrassign(self, node, env, scope, at):
        _, _, _, recv, name, right, span, op = node
        call = ("call", node[1], node[2], recv, name + "=", [right], span, None, {"splat": True} if op != "=" else {})
        self._call(call, env, scope, at)
        return None

    def _call(self, node, env, scope, at):
        _, _, _, recv, name, args, span, block, flags = node
        if recv is None and not args and not flags.get("paren") and not block and env.has(name):
            return None if scope.opaque else env.get(name)
        if recv is None and name in ("lambda", "proc") and block:
            self.block(block, env, scope, True)
            return None
        r = self.value(recv, env, scope) if recv else self._self(None, env, scope, at)
        got, literals = [], []
        for a in args:
            got.append(self.value(a, env, scope) or "")
            literals.append(a[3] + ":" + str(a[5]) if a[0] == "literal" and len(a) > 5 and a[5] is not None else a[3] if a[0] == "literal" else "")
        for x in flags.get("extra", []):
            self.value(x, env, scope)
        if recv and recv[0] == "const" and recv[3] in ("T", "::T"):
            return self.assertion(name, args, got, scope, span)
        exact = not (flags.get("splat") or flags.get("keywords") or flags.get("blockarg"))
        kind = recv[0] if recv else "implicit"
        silent = (recv is None and scope.rebound) or (recv is None and not scope.class_path) or scope.asserted > 0 or (kind in ("local", "call", "ivar") and name in scope.responds) or bool(flags.get("safe"))
        local = recv[4] if kind == "call" and recv[3] is None and not recv[5] and env.has(recv[4]) else None
        written = self.text[args[0][1] : args[0][2]].replace("_", "") if len(args) == 1 else ""
        first = written if re.fullmatch("-?[0-9]{1,18}", written) else ""
        shape = ("b" if block or flags.get("blockarg") else "") + ("" if exact else "x") + ":" + first
        key = self.expr("call", name, [r or "", *got], scope.nesting, at, shape) if r else None
        self.add("calls", key or f"{self.path}@{span[0]}", r, "local" if local else kind, name, len(args), exact, got, literals, *span, scope.class_path, not scope.instance, scope.name, local, bool(silent))
        self.definer(recv, name, args, env, scope)
        if block:
            core = name in ("each", "map", "select", "reject", "times", "each_with_index", "tap", "find", "any?", "all?", "inject", "reduce", "each_with_object", "then")
            scope.asserted += name in ("assert_raises", "assert_raise") or (name == "expect")
            self.block(block, env, scope, not core)
            scope.asserted -= name in ("assert_raises", "assert_raise") or (name == "expect")
        return key

    def assertion(self, name, args, got, scope, span):
        """``T.let``, ``T.cast`` and ``T.must`` give a type to what follows; the rest is unknown."""
        if name in ("let", "cast", "bind", "assert_type!") and len(args) > 1:
            return self.expr("declared", sorbet.type_of(args[1]), [], scope.nesting)
        if name == "must" and args:
            if args[0][0] == "literal" and args[0][3] == "nil":
                self.add("errors", "E0103", *span, "`T.must` raises on a literal `nil`")
            return self.expr("strip", None, [got[0]]) if got[0] else None
        return None

    def definer(self, recv, name, args, env, scope) -> None:
        """Calls in code that add methods to some class: it is opened, or what they add may be answered anywhere."""
        if name in ("send", "public_send", "__send__") and args and args[0][0] == "literal":
            name, args = args[0][5], args[1:]
        if name not in DEFINERS:
            return
        if recv is not None and recv[0] == "const":
            self.add("anywhere", "open", recv[3], scope.nesting)
        elif scope.class_path is not None:
            self.add("anywhere", "open", "::" + scope.class_path, scope.nesting)
        for a in args:
            if a[0] == "const":
                self.add("anywhere", "module", a[3], scope.nesting)
            elif a[0] == "literal" and len(a) > 5 and a[5]:
                self.add("anywhere", "name", a[5], scope.nesting)
                self.add("anywhere", "name", a[5] + "=", scope.nesting)

    def block(self, node, env, scope, rebinds: bool) -> None:
        inner = env.child(node[3])
        old, scope.rebound = scope.rebound, scope.rebound or rebinds
        self.block_value(node[4], inner, scope)
        scope.rebound = old
        for k in inner.written - set(node[3]):
            if env.has(k):
                env.set(k, self.union([env.get(k), inner.get(k)]))

    def _lambda(self, node, env, scope, at):
        self.block(node[3], env, scope, True)
        return None

    def _not(self, node, env, scope, at):
        self.value(node[3], env, scope)
        return self.atom("bool")

    def _and(self, node, env, scope, at):
        a = self.value(node[3], env, scope)
        then = env.copy()
        self.narrow(node[3], then, scope, True)
        b = self.value(node[4], then, scope)
        return self.union([a, b])

    def _or(self, node, env, scope, at):
        a = self.value(node[3], env, scope)
        other = env.copy()
        self.narrow(node[3], other, scope, False)
        b = self.value(node[4], other, scope)
        return self.union([self.expr("strip", None, [a]) if a else None, b])

    def _defined(self, node, env, scope, at):
        return self.union([self.atom("String"), self.atom("nil")])

    def narrow(self, cond, env, scope, truth: bool) -> None:
        if cond[0] == "not":
            return self.narrow(cond[3], env, scope, not truth)
        if cond[0] == "and" and truth or cond[0] == "or" and not truth:
            self.narrow(cond[3], env, scope, truth)
            return self.narrow(cond[4], env, scope, truth)
        if cond[0] == "begin" and len(cond[3]) == 1:
            return self.narrow(cond[3][0], env, scope, truth)
        if cond[0] == "defined" and truth and cond[3][0] == "const":
            scope.guards.append(cond[3][3])
        if cond[0] != "call":
            return None
        name = lambda n: n[4] if n and n[0] == "call" and n[3] is None and not n[5] and env.has(n[4]) else None
        if (v := name(cond)) and truth and env.get(v):
            env.set(v, self.expr("strip", None, [env.get(v)]))
        v = name(cond[3])
        if cond[4] == "respond_to?" and truth and cond[5] and cond[5][0][0] == "literal":
            scope.responds.append(cond[5][0][5])
        if not v:
            return None
        if cond[4] == "nil?":
            env.set(v, self.atom("nil") if truth else self.expr("strip", None, [env.get(v)]) if env.get(v) else None)
        elif cond[4] in ("is_a?", "kind_of?", "instance_of?") and len(cond[5]) == 1 and cond[5][0][0] == "const" and cond[5][0][3] in ("Class", "Module"):
            env.set(v, None)
        elif cond[4] in ("is_a?", "kind_of?", "instance_of?") and len(cond[5]) == 1 and cond[5][0][0] == "const":
            c = self.expr("const", cond[5][0][3], [], scope.nesting)
            if truth:
                env.set(v, self.expr("narrow", None, [c]))
            elif env.get(v):
                env.set(v, self.expr("minus", None, [env.get(v), c]))
        return None

    def _if(self, node, env, scope, at):
        _, _, _, cond, body, other, negated = node
        self.value(cond, env, scope)
        a, b = env.copy(), env.copy()
        marks = len(scope.guards), len(scope.responds)
        self.narrow(cond, a, scope, not negated)
        x = self.block_value(body, a, scope)
        del scope.guards[marks[0] :], scope.responds[marks[1] :]
        self.narrow(cond, b, scope, negated)
        y = self.block_value(other, b, scope) if other is not None else self.atom("nil")
        del scope.guards[marks[0] :], scope.responds[marks[1] :]
        if _diverges(body):
            env.take(b)
            self.narrow(cond, env.copy(), scope, negated)  # its guards hold for the rest of the scope
        elif other is not None and _diverges(other):
            env.take(a)
        else:
            self.join(env, [a, b])
        return self.union([x, y])

    def join(self, env, branches) -> None:
        for k in {k for b in branches for k in b.written}:
            parts = [b.get(k) if b.has(k) else (env.get(k) if env.has(k) else self.atom("nil")) for b in branches]
            env.set(k, self.union(parts))

    def _while(self, node, env, scope, at):
        self.value(node[3], env, scope)
        inner = env.copy()
        for k in _assigned(node[4]):
            inner.set(k, None)
        self.block_value(node[4], inner, scope)
        self.join(env, [env.copy(), inner])
        return self.atom("nil")

    def _for(self, node, env, scope, at):
        self.value(node[4], env, scope)
        inner = env.copy()
        inner.set(node[3], None)
        for k in _assigned(node[5]):
            inner.set(k, None)
        self.block_value(node[5], inner, scope)
        self.join(env, [env.copy(), inner])
        return None

    def _case(self, node, env, scope, at):
        _, _, _, subject, whens, other = node
        if subject:
            self.value(subject, env, scope)
        name = subject[4] if subject and subject[0] == "call" and subject[3] is None and not subject[5] and env.has(subject[4]) else None
        branches, values = [], []
        for conds, body in whens:
            e = env.copy()
            for c in conds:
                self.value(c, env, scope)
            if name and all(c[0] == "const" for c in conds):
                e.set(name, self.union([self.expr("narrow", None, [self.expr("const", c[3], [], scope.nesting)]) for c in conds]))
            values.append(self.block_value(body, e, scope))
            if not _diverges(body):
                branches.append(e)
        e = env.copy()
        values.append(self.block_value(other, e, scope) if other is not None else self.atom("nil"))
        branches.append(e)
        self.join(env, branches)
        return self.union(values)

    def _begin(self, node, env, scope, at):
        _, _, _, body, rescues, other, ensure = node
        if not rescues:
            out = self.block_value(body, env, scope)
            if other:
                out = self.block_value(other, env, scope)
            if ensure:
                self.block_value(ensure, env, scope)
            return out
        main = env.copy()
        values = [self.block_value(body, main, scope)]
        if other is not None:
            values = [self.block_value(other, main, scope)]
        branches = [main]
        for classes, name, handler in rescues:
            for c in classes:
                self.value(c, env, scope)
            e = env.copy()
            for k in _assigned(body):
                e.set(k, None)
            if name:
                e.set(name, None)
            values.append(self.block_value(handler, e, scope))
            branches.append(e)
        self.join(env, branches)
        if ensure:
            self.block_value(ensure, env, scope)
        return self.union(values)

    def _return(self, node, env, scope, at):
        parts = [self.value(a, env, scope) for a in node[3]]
        scope.returns.append(parts[0] if len(parts) == 1 else self.atom("Array") if parts else self.atom("nil"))
        return None

    def _jump(self, node, env, scope, at):
        for a in node[3]:
            self.value(a, env, scope)
        return None

    def _def(self, node, env, scope, at):
        self.method(node, scope.nesting, scope.class_path, not scope.instance)
        for frag in self.out["fragments"]:
            if frag["class_path"] == scope.class_path:
                self.open(frag, "NestedDefOwner")
        return self.atom("Symbol")

    def _class(self, node, env, scope, at):
        self.definition(node, scope.nesting)
        return None

    _module = _class

    def line(self, offset: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, offset) - 1

    def file(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.sigs: dict[int, tuple] = {}
        self.casts: dict[int, str] = {}
        try:
            nodes, comments = parse(text)
        except Malformed as e:
            self.add("errors", "E0001", e.at, e.at, f"syntax error: {e.message}")
            return self.opaque(text)
        except (Unsupported, RecursionError, IndexError, TypeError):
            return self.opaque(text)
        for s, e, c in comments:
            if m := re.match(r"#: as (!nil|(?:::)?[A-Za-z]\w*(?:::[A-Z]\w*)*)\s*$", c):
                self.casts[self.line(s)] = m[1]
            if c.startswith("#:") and not c.startswith("#: as "):
                self.sigs[self.line(s)] = (s, e, c[2:].strip())
        self.body(nodes, [], None)
        return None

    def opaque(self, text: str) -> None:
        for m in _OPAQUE.finditer(text):
            name = m[2].removeprefix("::")
            # Its nesting is not known: every path that could be meant is open.
            self.add("fragments", name, m[1], None, [], "Unparsed", m.start())


class Env:
    def __init__(self, known: dict | None = None):
        self.known, self.written = dict(known or {}), set()

    def has(self, k: str) -> bool:
        return k in self.known

    def get(self, k: str):
        return self.known.get(k)

    def set(self, k: str, v) -> None:
        self.known[k] = v
        self.written.add(k)

    def copy(self) -> Env:
        return Env(self.known)

    def child(self, params: list[str]) -> Env:
        return Env({**self.known, **dict.fromkeys(params)})

    def take(self, other: Env) -> None:
        for k, v in other.known.items():
            if self.known.get(k, "") != v:
                self.set(k, v)


class Scope:
    def __init__(self, nesting, class_path, singleton: bool, name: str, instance: bool | None = None):
        self.nesting, self.class_path, self.name = list(nesting), class_path, name
        self.instance = (not singleton) if instance is None else instance
        self.returns, self.guards, self.responds, self.writes = [], [], [], {}
        self.rebound, self.opaque, self.asserted = False, False, 0
        #: Locals whose collections nothing changes or hands out; None where that was not looked at.
        self.kept: set[str] | None = None

    def guarded(self, name: str) -> bool:
        return any(name == g or name.startswith(g + "::") for g in self.guards)


def _diverges(nodes: list | None) -> bool:
    if not nodes:
        return False
    n = nodes[-1]
    return n[0] in ("return", "jump") or (n[0] == "call" and n[3] is None and n[4] in ("raise", "fail", "exit", "abort"))


def _nodes(x):
    if isinstance(x, tuple):
        if x and isinstance(x[0], str) and len(x) > 2 and isinstance(x[1], int):
            yield x
        for y in x:
            yield from _nodes(y)
    elif isinstance(x, list):
        for y in x:
            yield from _nodes(y)


def points(nodes: list) -> list[str]:
    """The literal class of every way a body returns; "" where one is no literal."""
    out: list[str] = []

    def tail(body: list | None) -> None:
        if not body:
            return out.append("nil")
        n = body[-1]
        if n[0] == "if":
            tail(n[4])
            return tail(n[5])
        if n[0] == "case":
            for _, b in n[4]:
                tail(b)
            return tail(n[5])
        if n[0] == "begin" and not n[4] and n[6] is None:
            return tail(n[3])
        if n[0] == "return":
            return None
        return out.append(n[3] if n[0] == "literal" else {"array": "Array", "hash": "Hash"}.get(n[0], ""))

    tail(nodes)
    for n in _nodes(nodes):
        if n[0] == "return":
            out.append(n[3][0][3] if len(n[3]) == 1 and n[3][0][0] == "literal" else "nil" if not n[3] else "")
    return out


def kept_elements(defaults: list, body: list) -> set[str]:
    """Locals of a scope that are only ever read to call what neither changes a collection nor answers it, or to iterate over it as a statement."""
    safe, escaped, bail = set(), set(), False

    def read(n) -> str | None:
        return n[4] if isinstance(n, tuple) and n and n[0] == "call" and n[3] is None and not n[5] and not n[7] and not n[8].get("paren") else None

    def statements(nodes) -> None:
        for k, n in enumerate(nodes or []):
            if k < len(nodes) - 1 and n[0] == "call" and n[4] in core.ITERATIONS and (name := read(n[3])):
                safe.add(name)
                visit([n[5], n[7]])
            else:
                visit(n)

    def visit(n) -> None:
        nonlocal bail
        if isinstance(n, list):
            for x in n:
                visit(x)
        elif isinstance(n, dict):
            visit(list(n.values()))
        elif isinstance(n, tuple) and n and n[0] in ("def", "class", "module", "sclass"):
            return
        elif isinstance(n, tuple) and n and n[0] == "call":
            bail |= n[4] in OPAQUE_CALLS
            if name := read(n):
                escaped.add(name)
            elif n[4] in core.KEEPS_ELEMENTS and (name := read(n[3])):
                safe.add(name)
                visit([n[5], n[7], n[8]])
            else:
                visit([n[3], n[5], n[7], n[8]])
        elif isinstance(n, tuple) and n and n[0] == "index" and read(n[3]):
            safe.add(read(n[3]))
            visit(n[4])
        elif isinstance(n, tuple) and n and n[0] == "massign":
            visit([t for t in n[3] if t[0] == "index" or t[0] == "call" and t[3] is not None])  # plain targets are written, not read
            visit(n[4])
        elif isinstance(n, tuple) and n and n[0] == "block":
            statements(n[4])
        elif isinstance(n, tuple) and n and n[0] == "if":
            visit(n[3])
            statements(n[4])
            statements(n[5])
        elif isinstance(n, tuple):
            visit(list(n))

    visit(defaults)
    statements(body)
    return set() if bail else safe - escaped


def _mentions(nodes, names) -> bool:
    return any(n[0] == "call" and n[4] in names for n in _nodes(nodes))


def _locals(targets) -> set[str]:
    """Locals that the targets of a multiple assignment bind."""
    out = set()
    for t in targets:
        if t[0] in ("splat", "targets"):
            out |= _locals(t[3] if t[0] == "targets" else [t[3]])
        elif t[0] == "local" or t[0] == "call" and t[3] is None and not t[5]:
            out.add(t[3] if t[0] == "local" else t[4])
    return out


def _assigned(nodes) -> set[str]:
    out = set()
    for n in _nodes(nodes):
        if n[0] == "assign" and n[3][0] == "local":
            out.add(n[3][3])
        elif n[0] == "massign":
            out |= _locals(n[3])
        elif n[0] == "casein":
            out |= {x for names, _, _ in n[4] for x in names}
    return out


def extract(path: str, text: str | None) -> dict:
    walk = Walk(path)
    if text:
        walk.file(text)
    return walk.out


def slices(texts: list[str | None], files: int = 500, chars: int = 500_000):
    """Bounds of runs of texts, so many files and characters at most, or one file: the facts of one run are held at a time."""
    lo = held = 0
    for k, t in enumerate(texts):
        size = len(t or "")
        if k > lo and (k - lo == files or held + size > chars):
            yield lo, k
            lo, held = k, 0
        held += size
    if texts:
        yield lo, len(texts)


def facts(sources: DataFrame) -> DataFrame:
    """One row per file with its facts in arrays; ``table`` makes one of them a relation."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from factloom.sources.shipping import ship

    ship(sources.sparkSession)

    def run(batches):
        arrow = to_arrow_schema(SCHEMA)
        for b in batches:
            paths, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_pylist([{"path": p, **extract(p, t)} for p, t in zip(paths[lo:hi], texts[lo:hi], strict=True)], schema=arrow)

    rows = sources.select("path", "text")
    # Reading a file takes far longer than moving it: a source in fewer parts than the cluster has cores is dealt out.
    cores = sources.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, SCHEMA)


def table(all_facts: DataFrame, name: str) -> DataFrame:
    return all_facts.select("path", F.explode(name).alias("x")).select("path", "x.*")
