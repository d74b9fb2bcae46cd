"""Program-analysis queries over a source tree written from the ``part`` table.

Each part becomes a Ruby file: a class below the class of half its key, with one signed
method and one call on the class before it.  Every seventh call is misspelt, every
eleventh lacks its argument, every thirteenth passes a string, so the SQL can state
what must be found without knowing anything of the analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import navigate, report
from factloom.plans.program import Program
from factloom.plans.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the whole table."""
    n = F.col("p_partkey")
    s = lambda x: x.cast("string")
    parent = F.when(n >= 2, F.concat(F.lit(" < Part"), s(F.floor(n / 2)))).otherwise("")
    called = F.when(n % 7 == 0, "lable").otherwise("label")
    args = F.when(n % 11 == 0, "").when(n % 13 == 0, '"x"').otherwise("1")
    text = F.concat(
        F.lit("class Part"), s(n), parent, F.lit("\n  #: (Integer) -> String\n  def label(number)\n    \""), F.coalesce("p_brand", F.lit("")),
        F.lit("\"\n  end\n  def link\n    Part"), s(F.greatest(n - 1, F.lit(1))), F.lit(".new."), called, F.lit("("), args, F.lit(")\n  end\nend\n"),
    )
    return read(spark, sf_dir, "part").filter(n.isNotNull()).select(F.concat(F.lit("part/"), s(n), F.lit(".rb")).alias("path"), text.alias("text"))


def program(spark: SparkSession, sf_dir: str) -> Program:
    return Program(sources(spark, sf_dir))


_CALLS = """
WITH calls AS (SELECT p_partkey AS n, greatest(p_partkey - 1, 1) AS prev FROM part),
found AS (SELECT n, prev, CASE WHEN n % 7 = 0 THEN 'E0101' WHEN n % 11 = 0 THEN 'E0102' WHEN n % 13 = 0 THEN 'E0103' END AS code FROM calls)
"""


@query(_CALLS + """
SELECT 'part/' || n || '.rb' AS path, CAST(7 AS BIGINT) AS line, CAST(length('    Part' || prev || '.new.') + 1 AS BIGINT) AS "column", code, 'error' AS severity,
  CASE code WHEN 'E0101' THEN 'undefined method `lable` for `Part' || prev || '`' WHEN 'E0102' THEN '`label` expects 1 argument, got 0'
    ELSE 'argument 1 of `label` expects Integer, got String' END AS message, CASE code WHEN 'E0101' THEN 'label' END AS suggestion FROM found WHERE code IS NOT NULL
""")
def program_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(spark, sf_dir).diagnostics.select("path", "line", "column", "code", "severity", "message", "suggestion")


@query("""
WITH RECURSIVE up(root, node, rank) AS (SELECT p_partkey, p_partkey, CAST(1 AS BIGINT) FROM part
  UNION ALL SELECT root, node // 2, rank + 1 FROM up WHERE node >= 2)
SELECT 'Part' || root AS root, 'Part' || node AS node, rank FROM up
""")
def program_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up order of every class."""
    mro = program(spark, sf_dir).mro
    return mro.select("root", "node", "rank")


@query(_CALLS + """
SELECT CASE WHEN code = 'E0101' THEN 'not_found' ELSE 'found' END AS bucket, CASE WHEN code = 'E0101' THEN '-' ELSE 'instance' END AS reason, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY 1, 2
UNION ALL SELECT 'inconclusive', 'open ancestry', CAST(count(*) AS BIGINT) FROM calls HAVING count(*) > 0
""")
def program_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of all calls: ``new`` of a class without ``initialize`` is answered by every class."""
    return report.buckets(program(spark, sf_dir)).groupBy("bucket", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT 'part/' || p_partkey || '.rb' AS path, 'Part' || greatest(p_partkey - 1, 1) AS type FROM part
""")
def program_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type at ``new`` in every file."""
    p = program(spark, sf_dir)
    column = F.instr(F.regexp_extract("text", r"\n(    Part\d+\.new)", 1), "new")
    at = p.sources.select("path", F.lit(7).cast("long").alias("line"), column.cast("long").alias("column"))
    return navigate.hover(p, at).select("path", "type")


@query(_CALLS + """
SELECT 'part/' || n || '.rb' AS path, CASE WHEN n % 7 = 0 THEN NULL ELSE 'Part' || prev || '#label' END AS name, CASE WHEN n % 7 = 0 THEN NULL ELSE 'part/' || prev || '.rb' END AS def_path FROM calls
""")
def program_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the called method of every file is defined."""
    p = program(spark, sf_dir)
    column = F.length(F.regexp_extract("text", r"\n(    Part\d+\.new\.)", 1)) + 1
    at = p.sources.select("path", F.lit(7).cast("long").alias("line"), column.cast("long").alias("column"))
    return navigate.definition(p, at).select("path", "name", "def_path")


@query("""
SELECT 'Part' || p_partkey AS class_path, m AS name, CASE m WHEN 'label' THEN '1' ELSE '0' END AS arity FROM part, (VALUES ('label'), ('link')) AS v(m)
""")
def program_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.functions import names

    m = program(spark, sf_dir).table("methods")
    return m.select("class_path", "name", names.arity_text(F.col("required"), F.col("optional"), F.col("rest"), F.col("arity_unknown")).alias("arity"))
