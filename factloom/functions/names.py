"""Naming and text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: Column) -> Column:
    """``HTTPServerLog`` -> ``http_server_log``."""
    split = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1_$2"))


def pluralize(word: Column) -> Column:
    return (
        F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def table_name(class_path: Column) -> Column:
    return pluralize(snake_case(F.substring_index(class_path, "::", -1)))


def join_path(scope: Column, name: Column) -> Column:
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat(scope, F.lit("::"), name))


def is_constant_path(name: Column) -> Column:
    return name.rlike(r"^(::)?[A-Z][A-Za-z0-9_]*(::[A-Z][A-Za-z0-9_]*)*$")


def strip_quotes(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), '^["`\'](.*)["`\']$', "$1")


def sql_type(raw: Column) -> Column:
    """Canonical column type of an SQL spelling, without its precision."""
    bare = F.trim(F.lower(F.regexp_replace(raw, r"\([^)]*\)", "")))
    return (
        F.when(bare.isin("smallint", "integer", "int", "bigint", "serial", "bigserial", "smallserial"), "integer")
        .when(bare.isin("text", "varchar", "char", "character", "character varying", "citext", "uuid"), "string")
        .when(bare.isin("boolean", "bool"), "boolean")
        .otherwise(bare)
    )


def cast_risk(column_type: Column) -> Column:
    """``numeric`` or ``temporal`` where a written literal may fail to cast."""
    return F.when(column_type.isin("integer", "bigint", "decimal", "float"), "numeric").when(column_type.isin("date", "datetime", "time"), "temporal")


NUMBER = r"^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def loses_value(column_type: Column, literal: Column) -> Column:
    """True where the literal is proven not to survive the cast to its column."""
    text = F.lower(F.trim(literal))
    risk = cast_risk(column_type)
    return F.coalesce(F.when(risk == "numeric", ~text.rlike(NUMBER)).when(risk == "temporal", ~text.rlike("[0-9]")), F.lit(False))


def arity_text(required: Column, optional: Column, rest: Column, unknown: Column) -> Column:
    """``2``, ``1..3``, ``1+`` or ``unknown``."""
    most = required + optional
    span = F.when(optional > 0, F.concat(required.cast("string"), F.lit(".."), most.cast("string"))).otherwise(required.cast("string"))
    return F.when(unknown, "unknown").otherwise(F.concat(span, F.when(rest, "+").otherwise("")))


def ignored(path: Column, entry: str) -> Column:
    """Does an ignore entry name the path?  ``/x`` from the root, ``x`` anywhere, by whole segments."""
    import re

    body = re.escape(entry.strip("/"))
    start = "^/" if entry.startswith("/") else "(^|/)"
    return F.concat(F.lit("/"), path).rlike(f"{start}{body}(/|$)") if body else F.lit(False)


def percent_encode(path: Column) -> Column:
    """A path as it stands in a URI: slashes and unreserved characters stay."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decode(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def split_top(text: str, separator: str = ",") -> list[str] | None:
    """Parts of a type expression at separators outside all brackets; None where brackets do not match."""
    depth, parts, last = [], [], 0
    pairs = {")": "(", "]": "[", "}": "{"}
    for k, c in enumerate(text):
        if c in "([{":
            depth.append(c)
        elif c in pairs:
            if not depth or depth.pop() != pairs[c]:
                return None
        elif c == separator and not depth:
            parts.append(text[last:k].strip())
            last = k + 1
    return None if depth else [*parts, text[last:].strip()]
