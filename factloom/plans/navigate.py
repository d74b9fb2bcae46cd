"""Point queries: definition and hover at positions, as span joins for any number of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import resolve, terms


def offsets(positions: DataFrame, sources: DataFrame) -> DataFrame:
    """``offset`` (characters) of (path, line, column), both from 1, columns in UTF-16 units; clamped to the line."""
    rows = positions.join(sources.select("path", F.col("text").alias("__t")), "path")
    lines = F.split("__t", "\n", -1)
    line = F.greatest(F.lit(1), F.least(F.col("line").cast("int"), F.size(lines)))
    before = F.slice(lines, F.lit(1), line - 1)
    start = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1)
    content = F.element_at(lines, line)
    units = F.transform(F.split(content, ""), lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))
    walked = F.aggregate(units, F.struct(F.lit(0).alias("u"), F.lit(0).alias("n")), lambda s, u: F.when(s["u"] + u <= F.col("column").cast("int") - 1, F.struct((s["u"] + u).alias("u"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1 << 29).alias("u"), s["n"].alias("n"))))
    inside = F.least(walked["n"], F.length(content))
    return rows.withColumn("offset", (start + inside).cast("long")).drop("__t")


def definition(program, positions: DataFrame) -> DataFrame:
    """Where what stands at each (path, line, column) is defined; nulls where it is not known."""
    at = offsets(positions, program.project)
    sites = program.sites.filter("target is not null").select("path", "start", "end", "target")
    methods = program.methods.select(F.col("method").alias("target"), F.col("path").alias("def_path"), F.col("name_start").alias("def_start"), F.concat_ws("#", "class_path", "name").alias("name"))
    calls = sites.join(methods, "target").drop("target")
    refs = program.table("const_refs")
    first = program.table("fragments").groupBy("class_path").agg(F.min(F.struct("path", "start")).alias("b"))
    consts = refs.join(program.to_class(), ["name", "nesting"]).join(first, "class_path").select("path", "start", "end", F.col("b.path").alias("def_path"), F.col("b.start").alias("def_start"), F.col("class_path").alias("name"))
    spans = calls.unionByName(consts).select("path", "start", "end", F.struct("def_path", "def_start", "name").alias("b"))
    best = resolve.point_in_span(at.distinct(), spans, "path", "offset", "start", "end", "b")
    return best.select(*positions.columns, "offset", F.col("b.name").alias("name"), F.col("b.def_path").alias("def_path"), F.col("b.def_start").alias("def_start"))


def hover(program, positions: DataFrame) -> DataFrame:
    """The type of the smallest expression at each position; null where it is unknown."""
    at = offsets(positions, program.project)
    exprs = program.table("exprs").filter("end > start").join(program.types.filter("type <> 'untyped'"), "id").select("path", "start", "end", terms.render(F.col("type")).alias("type"))
    best = resolve.point_in_span(at.distinct(), exprs, "path", "offset", "start", "end", "type")
    return best.select(*positions.columns, "offset", "type")


def super_target(program, methods: DataFrame) -> DataFrame:
    """For each (class_path, name): the next owner along the ancestry; none where the ancestry is not closed."""
    own = program.mro.select(F.col("root").alias("class_path"), F.col("node").alias("owner"), "rank")
    have = program.methods.filter("not singleton").select(F.col("class_path").alias("owner"), "name").distinct()
    here = own.filter("class_path = owner").select("class_path", F.col("rank").alias("own_rank"))
    after = methods.join(own, "class_path").join(here, "class_path").filter("rank > own_rank").join(have, ["owner", "name"])
    after = after.join(program.incomplete, "class_path", "left_anti")
    return methods.join(after.groupBy("class_path", "name").agg(F.min(F.struct("rank", "owner")).alias("b")).select("class_path", "name", F.col("b.owner").alias("super_owner")), ["class_path", "name"], "left")
