"""Signature files of libraries (``.rbs``) as relations: what classes they declare, and what those answer with which arguments.

Lines, nesting and overloads are windows and aggregations: a line's depth is a running sum, what encloses it is the last
opening line of that depth, and a member is its first line and the ones that continue it.  What cannot be read
(brackets that do not match, an untyped parameter list) has no arity, and disagreeing overloads no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OPENS = r"^(class|module|interface)\s+(?!\S+\s*=)((?:::)?_?[A-Z][A-Za-z0-9_]*(?:::[A-Z][A-Za-z0-9_]*)*)"
_STARTS = r"^(?:(?:private|public)\s+)?(?:def|alias|attr_reader|attr_writer|attr_accessor|include|extend|prepend|type|class|module|interface|end|use)\b|^(?:private|public)$|^@|^[A-Z][A-Za-z0-9_]*\s*:(?!:)"


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, content, opens, before): without comments and annotations; ``before`` is the depth around the line."""
    rows = files.filter("text is not null").select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "content"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("content", r"%a(?:\{[^}]*\}|\([^)]*\)|\[[^\]]*\]|<[^>]*>|\|[^|]*\|)", ""), r"(^|\s)#.*$", ""))
    rows = rows.withColumn("content", clean).filter("content <> ''").withColumn("opens", F.col("content").rlike(_OPENS))
    step = F.when(F.col("opens") & ~F.col("content").rlike(r"\bend$"), 1).when(F.col("content").rlike(r"^end\b"), -1).otherwise(0)
    earlier = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("step", step).withColumn("before", F.coalesce(F.sum("step").over(earlier), F.lit(0)).cast("int")).drop("step")


def _inside(asks: DataFrame, openers: DataFrame) -> DataFrame:
    """(path, line, around): the line that opens what encloses each of ``asks`` (path, line, level)."""
    both = openers.select("path", "line", F.col("depth").alias("level"), F.lit(True).alias("opens")).unionAll(asks.select("path", "line", "level", F.lit(False)))
    last = Window.partitionBy("path", "level").orderBy("line", F.col("opens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("around", F.last(F.when(F.col("opens"), F.col("line")), ignorenulls=True).over(last)).filter("not opens").select("path", "line", "around")


def _classes(lines: DataFrame) -> DataFrame:
    """(path, line, class_path, kind, superclass) of each opening line; a name within others has their path before it."""
    opened = lines.filter("opens").select("path", "line", F.regexp_extract("content", _OPENS, 1).alias("kind"), F.regexp_extract("content", _OPENS, 2).alias("name"), F.regexp_extract("content", r"<\s*((?:::)?[A-Z][A-Za-z0-9_:]*)", 1).alias("superclass"), (F.col("before") + 1).alias("depth"))
    around = _inside(opened.filter("depth > 1").select("path", "line", (F.col("depth") - 1).alias("level")), opened)
    linked = opened.join(around, ["path", "line"], "left")
    bare = F.regexp_replace("name", "^::", "")
    done = linked.filter("depth = 1").select("path", "line", bare.alias("class_path"), "kind", "superclass", "depth")
    # A step for each level of nesting that the files have.
    for d in range(2, (opened.agg(F.max("depth")).first()[0] or 1) + 1):
        outer = done.filter(F.col("depth") == d - 1).select("path", F.col("line").alias("around"), F.col("class_path").alias("outer"))
        full = F.when(F.col("name").startswith("::"), bare).otherwise(F.concat_ws("::", "outer", "name"))
        done = done.unionAll(linked.filter(F.col("depth") == d).join(outer, ["path", "around"]).select("path", "line", full.alias("class_path"), "kind", "superclass", "depth"))
    return done.select("path", "line", "class_path", "kind", F.regexp_replace(F.nullif("superclass", F.lit("")), "^::", "").alias("superclass"))


def fragments(files: DataFrame) -> DataFrame:
    """(class_path, kind, superclass): every class, module and interface that some file declares or reopens."""
    return _classes(_lines(files)).select("class_path", "kind", "superclass").distinct()


def _members(files: DataFrame) -> DataFrame:
    """(path, line, class_path, content): whole members, their lines joined."""
    lines = _lines(files)
    starts = F.col("content").rlike(_STARTS)
    n = F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = lines.withColumn("member", n).groupBy("path", "member").agg(F.array_sort(F.collect_list(F.struct("line", "content", "before"))).alias("x"))
    rows = whole.select("path", F.col("x")[0]["line"].alias("line"), F.col("x")[0]["before"].alias("level"), F.array_join("x.content", " ").alias("content"))
    rows = rows.filter((F.col("level") > 0) & ~F.col("content").rlike(_OPENS) & ~F.col("content").rlike(r"^end\b"))
    classes = _classes(lines)
    opened = lines.filter("opens").select("path", "line", (F.col("before") + 1).alias("depth"))
    placed = rows.join(_inside(rows, opened), ["path", "line"])
    return placed.join(classes.select("path", F.col("line").alias("around"), "class_path"), ["path", "around"]).select("path", "line", "class_path", "content")


def _parameters(overload) -> Column:
    """A struct of an overload: ``parts`` of its parameter list, ``tail`` behind it, and ``depth`` (0 where brackets match)."""
    pieces = F.split(overload, r"(?=[()\[\]{},])")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("tail"))

    def step(s, p):
        c = F.substring(p, 1, 1)
        depth = s["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        rest = F.substring(p, F.lit(2), F.length(p))
        closes, begins, comma = ~s["done"] & (depth == 0), ~s["done"] & (s["depth"] == 0) & (depth == 1), ~s["done"] & (s["depth"] == 1) & (c == ",")
        return F.struct(
            depth.alias("depth"),
            (s["done"] | closes).alias("done"),
            F.when(begins | comma, rest).when(s["done"] | closes, s["part"]).otherwise(F.concat(s["part"], p)).alias("part"),
            F.when(comma, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]).alias("parts"),
            F.when(s["done"], F.concat(s["tail"], p)).when(closes, rest).otherwise(s["tail"]).alias("tail"),
        )

    def finish(s):
        every = F.filter(F.transform(F.concat(s["parts"], F.array(s["part"])), lambda x: F.trim(x)), lambda x: x != "")
        return F.struct(every.alias("parts"), s["tail"].alias("tail"), s["depth"].alias("depth"))

    none = F.struct(F.array().cast("array<string>").alias("parts"), overload.alias("tail"), F.lit(0).alias("depth"))
    return F.when(overload.startswith("("), F.aggregate(pieces, zero, step, finish)).otherwise(none)


def methods(files: DataFrame) -> DataFrame:
    """(class, method, singleton, least, most, result): arity over all overloads (``most`` null for no bound, both null where unknown).

    ``result`` is told where all overloads agree on one name and none takes a block.  ``self?`` methods are both kinds.
    """
    m = _members(files)
    shape = r"^(?:(?:private|public)\s+)?def\s+(self\?\.|self\.)?(`[^`]+`|\S+?)\s*:\s*(.*)$"
    defs = m.filter(F.col("content").rlike(shape)).select("class_path", F.regexp_extract("content", shape, 1).alias("on"), F.replace(F.regexp_extract("content", shape, 2), F.lit("`"), F.lit("")).alias("name"), F.split(F.regexp_extract("content", shape, 3), r"\s*\|\s*(?=[\[({]|->|\.\.\.)").alias("overloads"))
    each = defs.select("class_path", "on", "name", F.explode("overloads").alias("o")).withColumn("o", F.trim(F.regexp_replace("o", r"^\s*\[[^\]]*\]\s*", "")))
    each = each.filter("o <> '...'").withColumn("p", _parameters(F.col("o")))
    parts = F.filter("p.parts", lambda x: ~x.startswith("**") & ~x.rlike(r"^\??[a-z_][A-Za-z0-9_]*:(?!:)") & ~x.startswith("&"))
    count = lambda f: F.size(F.filter(parts, f))
    rest, optional = lambda x: x.startswith("*") | x.isin("...", "?"), lambda x: x.startswith("?") & (x != "?")
    after = F.regexp_extract("p.tail", r"^\s*->\s*(.*?)\s*$", 1)
    name = F.regexp_replace(after, r"^::|\[.*\]$", "")
    # A single letter is a type variable.
    told = F.when(~after.rlike("^[A-Z]$") & after.rlike(r"^(?:::)?[A-Z][A-Za-z0-9_:]*(\[.*\])?$") | after.isin("bool", "nil", "self"), name)
    each = each.select("class_path", "on", "name", (F.col("p.depth") == 0).alias("read"), count(lambda x: ~rest(x) & ~optional(x)).alias("least"), count(rest).alias("open"), count(lambda x: ~rest(x)).alias("most"), told.alias("result"))
    ok = F.bool_and("read")
    got = each.groupBy("class_path", "on", "name").agg(F.when(ok, F.min("least")).alias("least"), F.when(ok & (F.max("open") == 0), F.max("most")).alias("most"), F.when((F.count("result") == F.count("*")) & (F.count_distinct("result") == 1), F.min("result")).alias("result"))
    singleton = F.explode(F.when(F.col("on") == "", F.array(F.lit(False))).when(F.col("on") == "self.", F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("singleton")
    own = got.select("class_path", "name", singleton, "least", "most", "result")
    attribute = r"^(?:(?:private|public)\s+)?attr_(reader|writer|accessor)\s+(self\.)?([A-Za-z_][A-Za-z0-9_]*[?!]?)"
    kind, label = F.regexp_extract("content", attribute, 1), F.regexp_extract("content", attribute, 3)
    attrs = m.filter(F.col("content").rlike(attribute)).select("class_path", (F.regexp_extract("content", attribute, 2) != "").alias("singleton"), label.alias("name"), F.explode(F.when(kind == "reader", F.array(F.lit(0))).when(kind == "writer", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("n"))
    none = F.lit(None).cast("string")
    own = own.unionByName(attrs.select("class_path", F.when(F.col("n") == 1, F.concat("name", F.lit("="))).otherwise(F.col("name")).alias("name"), "singleton", F.col("n").alias("least"), F.col("n").alias("most"), none.alias("result")))
    alias = r"^alias\s+(self\.)?(\S+)\s+(?:self\.)?(\S+)$"
    links = m.filter(F.col("content").rlike(alias)).select("class_path", (F.regexp_extract("content", alias, 1) != "").alias("singleton"), F.regexp_extract("content", alias, 2).alias("new"), F.regexp_extract("content", alias, 3).alias("name"))
    same = links.join(own, ["class_path", "singleton", "name"], "left").select("class_path", F.col("new").alias("name"), "singleton", "least", "most", "result")
    # A class reopened in several files answers all of them; files that disagree widen the arity.
    every = own.unionByName(same).groupBy("class_path", "name", "singleton").agg(F.count("*").alias("n"), F.count("least").alias("known"), F.min("least").alias("least"), F.count("most").alias("bounded"), F.max("most").alias("most"), F.count_distinct("result").alias("kinds"), F.count("result").alias("told"), F.min("result").alias("result"))
    sure = F.col("known") == F.col("n")
    return every.select(F.col("class_path").alias("class"), F.col("name").alias("method"), "singleton", F.when(sure, F.col("least")).cast("int").alias("least"), F.when(sure & (F.col("bounded") == F.col("n")), F.col("most")).cast("int").alias("most"), F.when((F.col("told") == F.col("n")) & (F.col("kinds") == 1), F.col("result")).alias("result"))


def inventory(files: DataFrame) -> DataFrame:
    """(class, method, least, most, result) of instance methods, as :class:`factloom.plans.program.Program` takes them."""
    return methods(files).filter("not singleton").drop("singleton")
