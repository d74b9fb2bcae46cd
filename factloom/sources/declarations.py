"""Declaration files as relations: schemas, RBI headers, lock files, ignore lists.

Line-oriented inputs stay in DataFrame functions; the stateful ones are small state
machines run per file on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as text
from factloom.operators import sequence

# Column methods of a schema file, and words that end a column's type in a dump.
COLUMN_TYPES = "string text integer bigint boolean decimal float date datetime json jsonb inet".split()
STOP_WORDS = "not null default primary unique references check constraint collate generated".split()
_CREATE = r'^\s*create_table\s*\(?\s*["\':]([A-Za-z0-9_.]+)'


def _lines(files: DataFrame) -> DataFrame:
    return files.filter("text is not null").select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))


def schema_rb(files: DataFrame) -> DataFrame:
    """(path, table, column, type, line) of ``create_table`` blocks; ``id`` is implicit unless ``id: false``."""
    rows = _lines(files)
    head = F.regexp_extract("content", _CREATE, 1)
    mark = F.when(head != "", head).when(F.col("content").rlike(r"^\s*end\b"), "")
    within = sequence.carry_forward(rows.withColumn("mark", mark), ["path"], ["line"], "mark", "table").filter(F.coalesce("table", F.lit("")) != "")
    kind = F.regexp_extract("content", r"^\s*t\.([a-z]+)\b", 1)
    cols = within.filter(kind.isin(COLUMN_TYPES)).select("path", "table", kind.alias("type"), F.explode(F.expr("regexp_extract_all(regexp_replace(content, '^\\\\s*t\\\\.[a-z]+', ''), '(?:^|,)\\\\s*\\\\(?\\\\s*[\"\\':]([A-Za-z0-9_]+)[\"\\']?(?=\\\\s*(?:,|\\\\)|$))', 1)")).alias("column"), "line")
    ids = within.filter("mark <> ''").filter(~F.col("content").rlike(r"id:\s*false")).select("path", "table", F.lit("integer").alias("type"), F.lit("id").alias("column"), "line")
    return cols.unionByName(ids).select("path", "table", "column", "type", F.col("line").cast("long").alias("line"))


def structure_sql(files: DataFrame) -> DataFrame:
    """(path, table, column, type, line) of ``CREATE TABLE`` statements; an unterminated one is dropped whole."""
    rows = _lines(files)
    head = r'(?i)^\s*create\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?(?:"?[A-Za-z0-9_]+"?\.)?"?([A-Za-z0-9_]+)"?\s*\($'
    name = F.regexp_extract("content", head, 1)
    opens, closes = name != "", F.col("content").rlike(r"^\)\s*[^,]*;\s*$")
    marked = rows.withColumn("mark", F.when(opens, F.concat(name, F.lit("@"), F.col("line").cast("string"))).when(closes, "")).withColumn("close", F.when(closes, True))
    within = sequence.carry_forward(marked, ["path"], ["line"], "mark", "block").filter(F.coalesce("block", F.lit("")) != "")
    ended = sequence.carry_forward(marked.withColumn("minus", -F.col("line")).withColumn("next", F.when(opens, F.lit("open")).when(closes, "close")), ["path"], ["minus"], "next", "ending").select("path", "line", "ending")
    body = within.filter(F.col("mark").isNull()).join(ended.filter("ending = 'close'").select("path", "line"), ["path", "line"])
    shape = r'^\s*("?[A-Za-z_][A-Za-z0-9_$]*"?)\s+(.+?),?\s*$'
    column, rest = text.strip_quotes(F.regexp_extract("content", shape, 1)), F.regexp_extract("content", shape, 2)
    stop = "(?i)\\s+(" + "|".join(STOP_WORDS) + ")\\b.*$"
    rows = body.select("path", F.substring_index("block", "@", 1).alias("table"), column.alias("column"), text.sql_type(F.regexp_replace(rest, stop, "")).alias("type"), F.col("line").cast("long").alias("line"))
    return rows.filter((F.col("column") != "") & ~F.lower("column").isin("constraint", "primary", "unique", "foreign", "check", "exclude", "like"))


def rbi_headers(files: DataFrame) -> DataFrame:
    """(name, path, kind): every file that declares a name keeps its row; nothing is first-wins."""
    rows = _lines(files)
    klass = F.regexp_extract("content", r"^\s*(?:class|module)\s+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)", 1)
    const = F.regexp_extract("content", r"^([A-Z]\w*)\s*=[^=~>]", 1)
    test = F.col("content").rlike(r"^\s*def\s+(self\.)?(is_a\?|kind_of\?|instance_of\?|nil\?|===)")
    kind = F.when(klass != "", "class").when(const != "", "constant").when(test, "type_test")
    name = F.when(klass != "", F.regexp_replace(klass, "^::", "")).when(const != "", const).otherwise(F.lit(""))
    return rows.select(name.alias("name"), "path", kind.alias("kind")).filter("kind is not null").distinct()


def lock_entries(files: DataFrame) -> DataFrame:
    """(path, section, gem, version): four-space lines of the ``specs`` of each section."""
    rows = _lines(files)
    section = F.when(F.col("content").rlike(r"^[A-Z][A-Z ]*$"), F.trim("content")).when(F.col("content") == "", F.lit(""))
    marked = sequence.carry_forward(rows.withColumn("head", section), ["path"], ["line"], "head", "section").filter("section <> ''")
    shape = r"^ {4}([A-Za-z0-9_.-]+)(?: \(([^)]*)\))?$"
    got = marked.select("path", "section", F.regexp_extract("content", shape, 1).alias("gem"), F.regexp_extract("content", shape, 2).alias("version"))
    return got.filter("gem <> ''")


def gem_namespace(gem) -> F.Column:
    """The constant a gem name suggests: ``active-model_x`` -> ``Active::ModelX``."""
    parts = F.split(gem, "-")
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")), "::")


def runtime_locked(locks: DataFrame) -> DataFrame:
    """One row: does a lock name the runtime gem, and not its stub?"""
    return locks.agg(F.coalesce(F.bool_or(F.col("gem") == "sorbet-runtime"), F.lit(False)).alias("runtime"), F.coalesce(F.bool_or(F.col("gem") == "sorbet-runtime-stub"), F.lit(False)).alias("stub")).select((F.col("runtime") & ~F.col("stub")).alias("locked"))


def ignore_entries(config: str) -> list[str]:
    """``--ignore`` entries of a checker's configuration text."""
    out, words = [], config.split()
    for k, w in enumerate(words):
        m = re.match(r"--ignore=(.+)", w)
        if m:
            out.append(m[1])
        elif w == "--ignore" and k + 1 < len(words):
            out.append(words[k + 1])
    return out
