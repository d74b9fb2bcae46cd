"""The diagnostics, one query each, over a :class:`factloom.plans.program.Program`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions import core
from factloom.functions import names as text
from factloom.operators import resolve, sequence
from factloom.plans.surfaces import core_chain
from factloom.plans.tables import cut, small

_COLUMNS = ["path", "start", "end", "code", "severity", "message", "suggestion"]


def _row(df: DataFrame, code: str, message, severity: str = "error", suggestion=None) -> DataFrame:
    return df.select("path", "start", "end", F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"))


def source_errors(p) -> DataFrame:
    """E0001, E0105 and a ``T.must`` of nil: what the source alone shows."""
    e = p.table("errors")
    severity = F.when(F.col("code").isin("E0001", "E0103"), "error").otherwise("warning")
    return e.select("path", "start", "end", "code", severity.alias("severity"), "message", F.lit(None).cast("string").alias("suggestion"))


def undefined_methods(p) -> DataFrame:
    """E0101, with the closest name the ancestry has."""
    miss = p.sites.filter("verdict = 'not_found' and not silent").withColumn("of_class", F.col("recv_type").startswith("Class["))
    own = p.methods.filter("not singleton").select(F.col("class_path").alias("node"), F.col("name").alias("candidate"))
    wanted = small(cut(miss.select("class_path", "of_class").distinct(), "misses"))
    of_instances = p.along(wanted.filter("not of_class"), p.orders).join(own, "node").select("class_path", "of_class", "candidate")
    single = p.methods.filter("singleton").select(F.col("class_path").alias("node"), F.col("name").alias("candidate"))
    of_classes = p.along(wanted.filter("of_class"), p.chains).join(single, "node").select("class_path", "of_class", "candidate")
    names_ = of_instances.unionAll(of_classes)
    with_names = resolve.suggest(miss, names_, "name", "candidate", scope=["class_path", "of_class"])
    kind = F.when(F.col("of_class"), "class ").otherwise("")
    return _row(with_names, "E0101", F.concat(F.lit("undefined method `"), "name", F.lit("` for "), kind, F.lit("`"), "class_path", F.lit("`")), suggestion=F.col("suggestion"))


def undefined_core_methods(p) -> DataFrame:
    """E0101 on a value of a core class: only in a closed world, with an inventory of the class, and where nothing could have added the name.

    A class is left alone where the project, an ignored file or an open declaration touches any namespace its
    values run through; a name is where a library, a declaration or a call in the project may add it.
    """
    if not p.closed_world or p.core_inventory is None:
        return _row(p.table("errors").limit(0).select("path", "start", "end"), "E0101", F.lit(""))
    spark = p.spark
    chain = spark.createDataFrame([(c, h) for c in core.CORE_TYPES for h in core_chain(c)], "recv_type string, host string")
    touched = p.classes.select(F.col("class_path").alias("host"))
    if p.evidence is not None:
        from factloom.sources.facts import table

        touched = touched.unionAll(table(p.evidence, "fragments").select("class_path"))
    opened = chain.join(touched.distinct(), "host", "left_semi").select("recv_type").distinct()
    own = chain.join(p.inventory.select(F.col("class").alias("host"), F.col("method").alias("name")), "host").select("recv_type", "host", "name")
    covered = own.select("recv_type").distinct()
    names_ = own.select("recv_type", "name")
    names_ = names_.unionAll(p.core_table.select("class", "name"))
    if p.extensions is not None:
        names_ = names_.unionAll(chain.join(p.extensions.select(F.col("class").alias("host"), F.col("method").alias("name")), "host").select("recv_type", "name"))
    if p.surfaces is not None:
        said = p.surfaces.core_methods()
        names_ = names_.unionAll(said.filter("name is not null").select("class", "name"))
        opened = opened.unionAll(said.filter("name is null").select("class")).distinct()
    rows = p.sites.filter("verdict = 'core' and not silent and target is null").filter(F.col("recv_type").isin(*core.CORE_TYPES))
    if p.surfaces is not None and p.surfaces.type_tests():
        rows = rows.filter("recv_kind = 'literal'")
    always = p._answered().filter("not singleton").select("name").distinct()
    miss = rows.join(covered, "recv_type", "left_semi").join(opened, "recv_type", "left_anti").join(names_.distinct(), ["recv_type", "name"], "left_anti").join(always, "name", "left_anti")
    with_names = resolve.suggest(miss.select("path", "start", "end", "recv_type", "name"), names_.withColumnRenamed("name", "candidate").distinct(), "name", "candidate", scope=["recv_type"], hub=True)
    return _row(with_names, "E0101", F.concat(F.lit("undefined method `"), "name", F.lit("` for `"), "recv_type", F.lit("`")), suggestion=F.col("suggestion"))


def wrong_arity(p) -> DataFrame:
    """E0102: only exact argument lists of methods whose arity is known."""
    m = p.methods.select(F.col("method").alias("target"), "required", "optional", "rest", "arity_unknown", "abstract")
    rows = p.sites.filter("target is not null and exact and not silent").join(m, "target").filter("not arity_unknown and not abstract")
    most = F.when(~F.col("rest"), F.col("required") + F.col("optional"))
    bad = rows.filter(resolve.arity_mismatch(F.col("given"), F.col("required"), most))
    req, opt = F.col("required"), F.col("optional")
    some = F.when(F.col("rest"), F.concat(F.lit("at least "), req.cast("string"))).when(opt > 0, F.concat(req.cast("string"), F.lit(" to "), (req + opt).cast("string"))).otherwise(req.cast("string"))
    unit = F.when(~F.col("rest") & (opt == 0) & (req == 1), " argument").otherwise(" arguments")
    return _row(bad, "E0102", F.concat(F.lit("`"), "name", F.lit("` expects "), some, unit, F.lit(", got "), F.col("given").cast("string")))


def wrong_core_arity(p) -> DataFrame:
    """E0102 on core receivers: counts are known for the built-in table only, and not where the project reopens the class."""
    table = p.core_table.select(F.col("class").alias("recv_type"), "name", "least", "most")
    rows = p.sites.filter("verdict = 'core' and exact and not silent").join(table, ["recv_type", "name"])
    reopened = p.classes.filter(F.col("class_path").isin("Object", "Kernel", "BasicObject", "Comparable", "Enumerable", "Numeric")).limit(1).count()
    bad = rows.filter(resolve.arity_mismatch(F.col("given"), F.col("least"), F.col("most")) & F.lit(not reopened))
    least, most = F.col("least"), F.col("most")
    some = F.when(most.isNull(), F.concat(F.lit("at least "), least.cast("string"))).when(most > least, F.concat(least.cast("string"), F.lit(" to "), most.cast("string"))).otherwise(least.cast("string"))
    unit = F.when(F.coalesce(most == least, F.lit(False)) & (least == 1), " argument").otherwise(" arguments")
    return _row(bad, "E0102", F.concat(F.lit("`"), "name", F.lit("` expects "), some, unit, F.lit(", got "), F.col("given").cast("string")))


def _misfits(p, bound: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (``keys``, literal, declared, nesting) whose literal no member of the declared type admits.

    A member that is neither a core type nor a closed class could admit anything; an
    integer may stand for a float.
    """
    members = bound.select(*keys, "literal", "declared", "nesting", F.explode(F.split("declared", " \\| ")).alias("member"))
    closed = p.classes.filter("not is_module and not open").select("class_path")
    known = p.to_class().withColumnRenamed("name", "member").join(closed, "class_path", "left_semi")
    own = members.join(known, ["member", "nesting"], "left")
    core_name = F.col("member").isin(*core.CORE_TYPES)
    same = (F.col("member") == F.col("literal")) | ((F.col("member") == "Float") & (F.col("literal") == "Integer"))
    admits = F.when(core_name, same).otherwise(F.col("class_path").isNull())
    return own.groupBy(*keys, "literal", "declared").agg(F.bool_or(admits).alias("fits")).filter("not fits")


def broken_signatures(p) -> DataFrame:
    """E0103: a literal argument that no member of the declared type admits (inline and library signatures)."""
    args = p.sites.filter("target is not null and not silent").select("path", "start", "end", "name", "target", F.posexplode("literals").alias("k", "literal")).filter("literal <> ''")
    args = args.withColumn("literal", F.substring_index("literal", ":", 1)).filter(F.col("literal").isin(*core.CORE_TYPES))
    m = p.methods.select(F.col("method").alias("target"), "param_types", "sig_types", "params", "nesting")
    inline = m.filter(F.size("param_types") > 0).select("target", "nesting", F.posexplode("param_types").alias("k", "declared")).withColumn("param", F.lit(None).cast("string"))
    library = m.filter("sig_types is not null").select("target", "nesting", F.posexplode(F.arrays_zip("sig_types", "params")).alias("k", "x")).select("target", "nesting", "k", F.col("x.sig_types").alias("declared"), F.col("x.params").alias("param"))
    bound = args.join(inline.unionByName(library), ["target", "k"]).filter("declared <> 'untyped'")
    bad = _misfits(p, bound, ["path", "start", "end", "name", "k", "param"])
    which = F.coalesce(F.concat(F.lit("`"), "param", F.lit("`")), (F.col("k") + 1).cast("string"))
    return _row(bad, "E0103", F.concat(F.lit("argument "), which, F.lit(" of `"), "name", F.lit("` expects "), "declared", F.lit(", got "), "literal"))


def broken_returns(p) -> DataFrame:
    """E0109: every way a method returns is a literal, and none fits its library signature."""
    m = p.methods.filter("sig_returns is not null and sig_returns <> 'untyped' and size(points) > 0 and not array_contains(points, '')")
    m = m.select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"), "name", F.col("sig_returns").alias("declared"), "nesting", F.array_sort(F.array_distinct("points")).alias("points"))
    each = m.filter(F.forall("points", lambda x: x.isin(*core.CORE_TYPES))).select("path", "start", "end", "name", "declared", "nesting", "points", F.explode("points").alias("literal"))
    bad = _misfits(p, each, ["path", "start", "end", "name", "points"]).groupBy("path", "start", "end", "name", "points", "declared").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("points"))
    return _row(bad, "E0109", F.concat(F.lit("return of `"), "name", F.lit("` expects "), "declared", F.lit(", got "), F.array_join("points", " | ")))


def unresolved_constants(p) -> DataFrame:
    """E0104: a chain of anti joins; any evidence silences."""
    refs = p.table("const_refs").withColumn("bare", F.regexp_replace("name", "^::", ""))
    # What the program defines is most of it: the rest is a table, in which every look-up below is asked for what is left only.
    rest = cut(refs.join(p.resolved, ["name", "nesting"], "left_anti"), "unfound")
    spark = p.spark
    first = F.substring_index("bare", "::", 1)
    always = F.broadcast(spark.createDataFrame([(x,) for x in [*core.CORE_CONSTANTS, *core.LIBRARY_CONSTANTS]], "head string"))
    rest = rest.withColumn("head", first).join(always, "head", "left_anti")
    # Inherited constants exist: innermost scope's ancestors.
    # A name from the root has no scope.
    scope = F.element_at(F.when(F.size("nesting") > 0, F.col("nesting")).otherwise(F.array(F.lit(""))), -1)
    inner = rest.withColumn("root", F.when(~F.col("name").startswith("::"), scope))
    scoped = small(cut(inner.select("name", "nesting", F.col("root").alias("class_path"), "bare").distinct(), "scoped"))
    through = p.along(scoped, p.orders).withColumn("candidate", text.join_path(F.col("node"), F.col("bare"))).join(p.known.select(F.col("name").alias("candidate")), "candidate", "left_semi")
    rest = inner.join(through.select("name", "nesting").distinct(), ["name", "nesting"], "left_anti")
    # A scope whose ancestry is not closed may have it.
    rest = rest.join(p.incomplete.select(F.col("class_path").alias("root")), "root", "left_anti")
    if p.surfaces is not None:
        links = p.table("consts").filter("alias_of is not null").select("name", F.col("alias_of").alias("target"))
        rest = rest.join(p.surfaces.declared_constants(rest, links, p.hosts), ["name", "nesting"], "left_anti")
    if p.rbi_names is not None:
        rest = rest.join(p.rbi_names.select(F.col("name").alias("bare")).distinct(), "bare", "left_anti")
    if p.evidence is not None:
        from factloom.sources.facts import table

        other = table(p.evidence, "fragments").select(F.col("class_path").alias("bare")).unionAll(table(p.evidence, "consts").select(F.col("name").alias("bare"))).distinct()
        rest = rest.join(other, "bare", "left_anti")
    # Below an opaque or open namespace anything may exist.
    parent = F.regexp_replace("bare", "(^|::)[^:]+$", "")
    rest = rest.withColumn("space", parent).join(p.classes.filter("open").select(F.col("class_path").alias("space")), "space", "left_anti")
    # A name that is no class (a value, or an alias of something unknown) may have anything below it.
    plain = p.table("consts").select(F.col("name").alias("target")).join(p.aliases.select(F.col("name").alias("target")), "target", "left_anti").distinct()
    heads = refs.select(F.regexp_replace("name", "::[^:]+$", "").alias("name"), "nesting", F.col("name").alias("whole")).filter("name <> whole").distinct()
    vague = p.lexical(heads).join(plain, "target", "left_semi").join(heads, ["name", "nesting"]).select(F.col("whole").alias("name"), "nesting").distinct()
    rest = rest.join(vague, ["name", "nesting"], "left_anti")
    # So may a namespace that answers for missing constants, to itself and to what is written inside it.
    hooks = p.anywhere.filter("kind = 'const_missing'").select(F.col("name").alias("hook"))
    around = rest.select("name", "nesting", "space", F.explode(F.concat("nesting", F.array("space"))).alias("hook")).join(hooks, "hook", "left_semi").select("name", "nesting").distinct()
    rest = rest.join(around, ["name", "nesting"], "left_anti")
    named = resolve.suggest(rest.select("path", "start", "end", "name", "bare"), p.known.select(F.col("name").alias("candidate")), "bare", "candidate")
    return _row(named, "E0104", F.concat(F.lit("unresolved constant `"), "bare", F.lit("`")), "warning", F.col("suggestion"))


def lost_values(p) -> DataFrame:
    """E0106: a string literal that its column cannot hold."""
    if p.schema is None:
        return _row(p.table("errors").limit(0).select("path", "start", "end"), "E0106", F.lit(""), "warning")
    models = p.classes.select("class_path", text.table_name(F.col("class_path")).alias("table")).join(p.schema, "table")
    sets = p.sites.filter(F.col("name").endswith("=") & (F.size("literals") == 1)).withColumn("column", F.regexp_replace("name", "=$", "")).withColumn("literal", F.element_at("literals", 1)).filter(F.col("literal").startswith("String:"))
    own = p.methods.filter("path <> '(schema)'").select(F.col("method").alias("target"))
    rows = sets.join(own, "target", "left_anti").join(models, ["class_path", "column"]).withColumn("value", F.substring_index("literal", "String:", -1))
    bad = rows.filter(text.loses_value(F.col("type"), F.col("value")))
    return _row(bad, "E0106", F.concat(F.lit("`"), "column", F.lit("` is a "), "type", F.lit(" column; \""), "value", F.lit("\" is dropped by the cast")), "warning")


def contradictions(p) -> DataFrame:
    """E0107: a local whose calls no single type answers; only in a closed world with a core inventory."""
    empty = _row(p.table("errors").limit(0).select("path", "start", "end"), "E0107", F.lit(""), "warning")
    if not p.closed_world or p.core_inventory is None:
        return empty
    calls = p.sites.filter("local is not null and recv_type = 'untyped'").select("path", "start", "end", F.concat_ws("|", "scope", "local").alias("binding"), "local", "name")
    closed = p.classes.join(p.incomplete, "class_path", "left_anti")
    answers = p.mro.withColumnRenamed("root", "class_path").join(closed.select("class_path"), "class_path", "left_semi").join(p.methods.filter("not singleton").select(F.col("class_path").alias("node"), "name"), "node").select("name", F.col("class_path").alias("provider"))
    answers = answers.unionAll(p.inventory.select(F.col("method").alias("name"), F.col("class").alias("provider")))
    bad = resolve.candidate_intersection(calls, answers, "binding", "name", "provider").filter("outcome = 'contradiction'").select("binding")
    rows = calls.join(bad, "binding").groupBy("binding", "path", "local").agg(F.min(F.struct("start", "end")).alias("at"), F.array_sort(F.collect_set("name")).alias("names"))
    rows = rows.select("path", "at.start", "at.end", "local", "names")
    used = F.array_join(F.transform("names", lambda x: F.concat(F.lit("`."), x, F.lit("`"))), ", ")
    return _row(rows, "E0107", F.concat(F.lit("`"), "local", F.lit("` is used as "), used, F.lit(", but no type defines all of them")), "warning")


def operands(p) -> DataFrame:
    """E0108: arithmetic between proven types that never works, unless the project patches them."""
    arg = p.types.select(F.col("id").alias("arg"), F.col("type").alias("arg_type"))
    rows = p.sites.filter(F.col("name").isin("+", "-", "*", "/", "%") & (F.size("args") == 1) & ~F.col("silent")).withColumn("arg", F.element_at("args", 1)).join(arg, "arg")
    numeric = F.col("recv_type").isin("Integer", "Float") & F.col("arg_type").isin("String", "nil")
    string = (F.col("recv_type") == "String") & (F.col("name") == "+") & F.col("arg_type").isin("Integer", "Float", "nil")
    patched = p.classes.filter(F.col("class_path").isin("Integer", "Float", "Numeric", "Comparable", "Object", "Kernel", "String", "NilClass")).limit(1).count()
    if patched:
        rows = rows.limit(0)
    want = F.when(numeric, "a numeric operand").otherwise("String")
    return _row(rows.filter(numeric | string), "E0108", F.concat(F.lit("`"), "name", F.lit("` on "), "recv_type", F.lit(" expects "), want, F.lit(", got "), "arg_type"))


def all_of(p) -> DataFrame:
    rows = source_errors(p)
    for part in (undefined_methods, undefined_core_methods, wrong_arity, wrong_core_arity, broken_signatures, broken_returns, unresolved_constants, lost_values, contradictions, operands):
        rows = rows.unionByName(part(p))
    return located(rows.distinct(), p.project)


def located(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Line from 1 and UTF-16 column from 1 of each start (character offsets): lines and starts are swept together in order."""
    texts = sources.join(rows.select("path").distinct(), "path", "left_semi").filter("text is not null")
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    before = F.sum(F.length("content") + 1).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("at"), F.struct((F.col("line") + 1).cast("long").alias("line"), "content").alias("on"), F.lit(None).cast(T.StructType(rows.schema.fields)).alias("row"))
    asked = rows.select("path", F.col("start").cast("long").alias("at"), F.lit(None).cast(lines.schema["on"].dataType).alias("on"), F.struct(*rows.columns).alias("row"))
    w = Window.partitionBy("path").orderBy("at", F.col("on").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = lines.unionAll(asked).select("row", F.last(F.when(F.col("on").isNotNull(), F.struct(F.col("on.line").alias("line"), F.col("on.content").alias("content"), "at")), ignorenulls=True).over(w).alias("here")).filter("row is not null")
    head = F.substring("here.content", F.lit(1), (F.col("row.start") - F.col("here.at")).cast("int"))
    column = (F.octet_length(F.encode(head, "UTF-16BE")) / 2).cast("long") + 1
    return swept.select("row.path", F.col("here.line").alias("line"), column.alias("column"), "row.start", "row.end", "row.code", "row.severity", "row.message", "row.suggestion").filter("line is not null")


__all__ = ["all_of", "located", "sequence"]
