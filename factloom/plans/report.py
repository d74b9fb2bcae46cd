"""Sinks and censuses of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import lattice


def text_lines(diagnostics: DataFrame, sources: DataFrame) -> DataFrame:
    """``path:line:column: level[code]: message``, the source line, carets below the span, and the suggestion."""
    rows = diagnostics.join(sources.select("path", F.col("text").alias("__t")), "path")
    content = F.element_at(F.split("__t", "\n", -1), F.col("line").cast("int"))
    width = F.greatest(F.lit(1), F.least(F.col("end") - F.col("start"), F.length(content) - F.col("column") + 1)).cast("int")
    head = F.concat("path", F.lit(":"), "line", F.lit(":"), "column", F.lit(": "), "severity", F.lit("["), "code", F.lit("]: "), "message")
    caret = F.concat(F.repeat(F.lit(" "), F.col("column").cast("int") - 1), F.repeat(F.lit("^"), width))
    hint = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("did you mean `"), "suggestion", F.lit("`?")))
    return rows.select("path", "line", "column", "start", "code", F.concat_ws("\n", head, F.concat(F.lit("    "), content), F.concat(F.lit("    "), caret), hint).alias("text"))


def json_lines(diagnostics: DataFrame) -> DataFrame:
    """One JSON object per row, keys in order."""
    return diagnostics.orderBy("path", "start", "code").select(F.to_json(F.struct("path", "line", "column", "code", "severity", "message")).alias("value"))


def editor(diagnostics: DataFrame) -> DataFrame:
    """Positions from 0, severity 1 for errors and 2 for warnings."""
    return diagnostics.select("path", (F.col("line") - 1).alias("line"), (F.col("column") - 1).alias("character"), F.when(F.col("severity") == "error", 1).otherwise(2).alias("severity"), "code", "message")


def exit_status(diagnostics: DataFrame) -> int:
    return int(bool(diagnostics.filter("severity = 'error'").limit(1).count()))


def buckets(program) -> DataFrame:
    """Every call in one bucket, with the sub-bucket that says why it is blind."""
    verdict = F.col("verdict")
    union = F.col("recv_type").contains(" | ")
    why = (
        F.when(verdict == "unknown", F.when(union, "union").otherwise(F.coalesce("recv_kind", F.lit("other"))))
        .when(verdict == "inconclusive", F.when(F.col("is_module"), "module").otherwise("open ancestry"))
        .when(verdict == "found", F.when(F.col("recv_type").startswith("Class["), "class").otherwise("instance"))
    )
    return program.sites.select("path", verdict.alias("bucket"), F.coalesce(why, F.lit("-")).alias("reason"))


# The buckets of what opens an ancestry.
BUCKETS = {
    "unresolved": "Unresolved",
    "declared": "Declared",
    "dsl": "UnknownClassBodyCall",
    "block": "ClassBodyBlock BlockNestedDefinition",
    "meta": "DynamicSuperclass DynamicMixinReceiver DynamicMixinArg DynamicAttrArg DynamicDefineMethod DynamicAliasMethod EvalOrSend SingletonClassExpr NestedDefOwner StringSourceDefined",
    "missing": "MethodMissing AbstractRaise",
}


def bucket_of(reason) -> F.Column:
    out = F.when(reason.isNull(), "na")
    for bucket, reasons in BUCKETS.items():
        out = out.when(reason.isin(*reasons.split()), bucket)
    return out.otherwise("other")


def blocked(program) -> DataFrame:
    """Calls whose look-up ended in a class of the project, with what keeps its ancestry open (null: nothing) and its bucket."""
    rows = program.sites.filter(F.col("verdict").isin("inconclusive", "not_found") & F.col("is_module").isNotNull())
    got = rows.select("path", "start", "class_path", "name", "singleton", "verdict").join(program.blockers, "class_path", "left")
    got = got.join(program.record_classes.withColumn("record", F.lit(True)), "class_path", "left")
    # Of classes that only declarations know, those that a record's own methods do not answer.
    return got.withColumn("bucket", bucket_of(F.col("reason"))).withColumn("not_record_api", F.coalesce("record", F.lit(False)) & (F.col("reason") == "Declared")).drop("record")


def totals(program) -> DataFrame:
    """One row: calls in all buckets, and the blind ones (undecided, or of an unknown receiver)."""
    rows = buckets(program)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("bucket").isin("inconclusive", "unknown")).alias("blind")).withColumn("blind_share", F.round(lattice.percent(F.col("blind"), F.col("total")), 2))


def census(program) -> DataFrame:
    """Counts by bucket and reason with their subtotals, and each one's share of its parent."""
    rows = lattice.census(buckets(program), ["bucket", "reason"])
    parents = rows.filter("all_bucket = 0 and all_reason = 1").select(F.col("bucket").alias("b"), F.col("n").alias("of"))
    # A row for each bucket and reason: a few dozen, whatever the input.
    got = rows.withColumn("whole", F.max(F.when(F.col("all_bucket") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))).join(parents, F.col("bucket") == F.col("b"), "left")
    share = lattice.percent(F.col("n"), F.when(F.col("all_reason") == 1, F.col("whole")).otherwise(F.col("of")))
    return got.select("bucket", "reason", "n", F.round(share, 2).alias("share"))


def dark(program) -> DataFrame:
    """Calls on class objects: would they be accused, and if not, why not?"""
    rows = program.sites.filter(F.col("recv_type").startswith("Class["))
    verdict = F.when(F.col("verdict") == "not_found", "closed_notfound").when(F.col("verdict") == "found", "known_tail").otherwise("open")
    rows = rows.select("path", "start", F.col("class_path").alias("receiver"), F.col("name").alias("method"), verdict.alias("verdict"))
    why = program.blockers.select(F.col("class_path").alias("receiver"), "reason")
    return rows.join(why, "receiver", "left").select("path", "start", "receiver", "method", "verdict", F.when(F.col("verdict") == "open", F.col("reason")).alias("reason"))


def dark_lines(program) -> DataFrame:
    """One JSON object for each call on a class object, with its place."""
    from factloom.plans import diagnose

    rows = dark(program)
    spots = rows.select("path", "start", F.col("start").alias("end"), F.lit("").alias("code"), F.lit("").alias("severity"), F.lit("").alias("message"), F.lit(None).cast("string").alias("suggestion")).distinct()
    placed = diagnose.located(spots, program.project).select("path", "start", "line", "column")
    byte = F.octet_length(F.substring("__t", F.lit(1), F.col("start").cast("int")))
    got = rows.join(placed, ["path", "start"]).join(program.project.select("path", F.col("text").alias("__t")), "path").withColumn("byte", byte)
    return got.orderBy("path", "start", "method").select(F.to_json(F.struct(F.col("path").alias("file"), "line", "column", "byte", "receiver", "method", "verdict", "reason")).alias("value"))


def dark_summary(program, k: int = 12) -> DataFrame:
    """The commonest receiver and method pairs that a closed class object does not answer."""
    rows = dark(program).filter("verdict = 'closed_notfound'").select(F.concat_ws("#", "receiver", "method").alias("call"))
    return lattice.top(rows, "call", k)


def candidates(program) -> DataFrame:
    """Untyped locals and what the methods called on them prove: inferred, a union, or a contradiction."""
    from factloom.operators import resolve

    calls = program.sites.filter("local is not null and recv_type = 'untyped'").select(F.concat_ws("|", "scope", "local").alias("binding"), "name")
    closed = program.classes.join(program.incomplete, "class_path", "left_anti").select(F.col("class_path").alias("root"))
    answers = program.mro.join(closed, "root", "left_semi").join(program.methods.filter("not singleton").select(F.col("class_path").alias("node"), "name"), "node").select("name", F.col("root").alias("provider")).distinct()
    return resolve.candidate_intersection(calls, answers, "binding", "name", "provider")


def agent_blocks(program) -> DataFrame:
    """Markdown for what the calls on untyped locals prove: one block for each binding."""
    calls = program.sites.filter("local is not null and recv_type = 'untyped'").select("path", "start", F.concat_ws("|", "scope", "local").alias("binding"), "local", "name")
    closed = program.classes.join(program.incomplete, "class_path", "left_anti").select(F.col("class_path").alias("root"))
    answers = program.mro.join(closed, "root", "left_semi").join(program.methods.filter("not singleton").select(F.col("class_path").alias("node"), "name"), "node").select("name", F.col("root").alias("provider")).distinct()
    outcome = candidates(program).filter("outcome <> 'nothing'").select("binding", "needs", "outcome")
    want = calls.select("binding", "name").distinct().join(answers, "name").groupBy("binding", "provider").agg(F.count("*").alias("n"))
    able = outcome.join(want, "binding").filter("n = needs").groupBy("binding").agg(F.array_sort(F.collect_set("provider")).alias("able"))
    used = calls.join(outcome.select("binding"), "binding", "left_semi").groupBy("binding", "path", "local").agg(F.min("start").alias("start"), F.array_sort(F.collect_set("name")).alias("names"))
    rows = used.join(outcome, "binding").join(able, "binding", "left")
    tick = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    text = F.concat(F.lit("## `"), "local", F.lit("` in "), "path", F.lit("\n\n- calls: "), tick(F.col("names")), F.lit("\n- outcome: "), "outcome", F.coalesce(F.concat(F.lit("\n- types: "), tick(F.col("able"))), F.lit("")), F.lit("\n"))
    return rows.select("path", "start", "outcome", text.alias("text"))
