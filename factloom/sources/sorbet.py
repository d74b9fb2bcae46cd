"""Library signatures: ``sig { params(x: Integer).returns(T.nilable(String)) }``."""

from __future__ import annotations

from dataclasses import dataclass, field

UNTYPED = "untyped"
# Generic containers and aliases of the signature library.
GENERIC = {"T::Array": "Array", "T::Hash": "Hash", "T::Boolean": "bool", "TrueClass": "bool", "FalseClass": "bool", "NilClass": "nil"}


@dataclass
class Contract:
    params: dict = field(default_factory=dict)
    returns: str = UNTYPED


def type_of(node) -> str:
    """Canonical members of a type expression; anything not understood is unknown."""
    kind = node[0]
    if kind == "const":
        name = node[3].removeprefix("::")
        return GENERIC.get(name, UNTYPED if name.startswith("T::") else name)
    if kind == "index" and node[3][0] == "const":
        return GENERIC.get(node[3][3].removeprefix("::"), UNTYPED)
    if kind == "call" and node[3] is not None and node[3][0] == "const" and node[3][3] in ("T", "::T"):
        if node[4] == "nilable" and len(node[5]) == 1:
            return _join([type_of(node[5][0]), "nil"])
        if node[4] == "any":
            return _join([type_of(x) for x in node[5]])
    return UNTYPED


def _join(parts: list[str]) -> str:
    members = sorted({y for x in parts for y in x.split(" | ")})
    return UNTYPED if UNTYPED in members or not members else " | ".join(members)


def contract(body: list) -> Contract | None:
    """The clauses of a ``sig`` block; None where one is repeated or not understood."""
    if len(body) != 1:
        return None
    out, seen, node = Contract(), set(), body[0]
    while node is not None:
        if node[0] != "call" or node[4] in seen:
            return None
        name = node[4]
        seen.add(name)
        if name == "params":
            out.params = {k: type_of(v) for k, v in node[8].get("named", [])}
        elif name == "returns":
            if len(node[5]) != 1:
                return None
            out.returns = type_of(node[5][0])
        elif name not in ("void", "abstract", "override", "overridable", "final", "checked", "on_failure", "type_parameters", "implementation"):
            return None
        elif name == "type_parameters":
            return None
        node = node[3]
    return out
