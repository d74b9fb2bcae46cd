"""Type terms as column expressions: unions of names, class objects and collections with arguments.

A type is a union, its members in order and joined by `` | ``.  A member is a name, ``Class[X]`` for the class object
X, or ``Array[E]`` and ``Hash[K, V]``; without arguments a collection holds what is not known.  A term is its own
key: equal terms are equal strings, so unions and comparisons need no table of terms.  Inside brackets members
are joined by a bare ``|`` and class objects are written ``Class(X)``, so that the members of a type are always found by
splitting it, and arguments by following the depth of brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNTYPED = "untyped"
#: Types whose values hold nothing that ``flatten`` takes apart.
SCALARS = ("Integer", "Float", "String", "Symbol", "bool", "nil")


def members(term) -> Column:
    return F.split(term, " \\| ")


def union(parts) -> Column:
    """The join of types given as one array of members: unknown as soon as one is."""
    return F.when(F.array_contains(parts, UNTYPED), UNTYPED).otherwise(F.array_join(F.array_sort(F.array_distinct(parts)), " | "))


def erase(term) -> Column:
    """The type without what its collections hold."""
    return F.when(F.contains(term, F.lit("[")), F.array_join(F.array_sort(F.array_distinct(F.transform(members(term), bare))), " | ")).otherwise(term)


def inner(term) -> Column:
    """A type as it is written inside brackets."""
    return F.regexp_replace(F.replace(term, F.lit(" | "), F.lit("|")), r"Class\[([^\[\]]*)\]", "Class($1)")


def outer(text) -> Column:
    """What stands inside brackets as a type."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" | ")), r"Class\(([^()]*)\)", "Class[$1]")


def render(term) -> Column:
    """For people: one way to write a union, at any depth."""
    return outer(inner(term))


def bare(member) -> Column:
    """One member without arguments."""
    return F.regexp_replace(member, r"^(Array|Hash)\[.*\]$", "$1")


def _top(text, separator: str) -> Column:
    """The parts of ``text`` between separators outside all brackets."""
    pieces = F.split(text, "(?=[\\[\\]" + separator + "])")
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        first = F.substring(p, 1, 1)
        cut = (first == separator) & (s["depth"] == 0)
        return F.struct(
            (s["depth"] + F.when(first == "[", 1).when(first == "]", -1).otherwise(0)).alias("depth"),
            F.when(cut, F.ltrim(F.substring(p, F.lit(2), F.length(p)))).otherwise(F.concat(s["part"], p)).alias("part"),
            F.when(cut, F.concat(s["out"], F.array(s["part"]))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(pieces, zero, step, lambda s: F.concat(s["out"], F.array(s["part"])))


def held(rows: DataFrame) -> DataFrame:
    """(id, type): what calls on collections answer by what these and their arguments hold.

    ``rows`` has a row per receiver and argument: id, rule, base (``Array`` or ``Hash``), own (the receiver's row) and type,
    null while that is not known; a call with one is left out.  Arguments of terms become rows, so
    that joining them is one aggregation: ``plus`` and ``merge`` join what both sides hold, ``push`` what the receiver holds
    and its arguments, ``elem``, ``keys`` and ``values`` take out.  What is taken out and is a collection itself is shared with
    the one it was in, so it loses its own arguments.
    """
    part = F.regexp_extract("type", r"^(?:Array|Hash)\[(.*)\]$", 1)
    same = (F.col("own") | F.col("rule").isin("plus", "merge")) & F.startswith("type", F.concat("base", F.lit("["))) & ~F.contains("type", F.lit(" | "))
    rows = rows.select("id", "rule", F.when(F.col("type").isNull(), "?").when(same, part).when(~F.col("own") & (F.col("rule") == "push"), inner(F.col("type"))).otherwise("").alias("text"), (~F.col("own") & (F.col("rule") == "push")).alias("whole"))
    nothing = F.array(F.lit(UNTYPED), F.lit(UNTYPED))
    places = rows.select("id", "rule", F.posexplode(F.when(F.col("text") == "", nothing).when(F.col("whole"), F.array("text")).otherwise(_top(F.col("text"), ","))).alias("place", "text"))
    places = places.filter((F.col("rule") == "merge") | (F.col("place") == F.when(F.col("rule") == "values", 1).otherwise(0)) | (F.col("text") == "?"))
    each = places.select("id", "rule", "place", F.explode(_top(F.col("text"), "|")).alias("m"))
    each = each.withColumn("m", F.when(F.col("rule").isin("elem", "keys", "values"), bare(F.col("m"))).otherwise(F.col("m")))
    values = (F.col("rule") == "merge") & (F.col("place") == 1)
    got = each.groupBy("id", "rule").agg(F.array_sort(F.collect_set(F.when(~values, F.col("m")))).alias("a"), F.array_sort(F.collect_set(F.when(values, F.col("m")))).alias("b"))
    got = got.filter(~F.array_contains("a", "?"))
    text = lambda c: F.when(F.array_contains(c, UNTYPED), UNTYPED).otherwise(F.array_join(c, "|"))
    got = got.select("id", "rule", text("a").alias("a"), text("b").alias("b"))
    a, b, rule = F.col("a"), F.col("b"), F.col("rule")
    array = F.when(a == UNTYPED, "Array").otherwise(F.concat(F.lit("Array["), a, F.lit("]")))
    pair = F.when((a == UNTYPED) & (b == UNTYPED), "Hash").otherwise(F.concat(F.lit("Hash["), a, F.lit(", "), b, F.lit("]")))
    return got.select("id", F.when(rule == "elem", outer(a)).when(rule == "merge", pair).otherwise(array).alias("type"))


def flattened(term, whole) -> Column:
    """``Array#flatten``: the array itself where nothing in it can be taken apart, an array of unknown elements where arrays of such are, else unknown."""
    one = "(?:" + "|".join((*SCALARS, r"Hash(?:\[[^|]*\])?")) + ")"
    return F.when(F.rlike(term, F.lit(rf"^Array\[{one}\]$")), term).when(whole & F.rlike(term, F.lit(rf"^(?:Array\[)+{one}\]+$")), "Array").otherwise(UNTYPED)
