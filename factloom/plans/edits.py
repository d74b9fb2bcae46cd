"""A query over edits: files written from the ``supplier`` table, of which every fifth changes in a second batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import shop
from factloom.plans.increment import Incremental
from factloom.plans.tables import shared_dir

STEP = """class Step{k}
  def make{k}
    {value}
  end

  def pass{k}
    Step{p}.new.make{p}
  end

  def use{k}
    Step{p}.new.pass{p} + 1
  end
end
"""


def program_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every file after the edit, and whether the edit had it asked again: the changed, those after them and those after these."""
    k = F.col("s_suppkey")
    inc = Incremental(spark, f"{shared_dir(spark)}/factloom/edits-{uuid.uuid4().hex}")
    inc.update(0, shop.keyed(spark, sf_dir, "steps/s{k}.rb", STEP, value=F.lit("1")).select("path", "text"))
    edited = shop.keyed(spark, sf_dir, "steps/s{k}.rb", STEP, value=F.lit('"a"')).filter("k % 5 = 0")
    asked = inc.update(1, edited.select("path", "text"))
    rows = inc.sources(1).select("path").join(inc.diagnostics(1).select("path", "code", "message"), "path", "left")
    return rows.join(asked.withColumn("asked", F.lit(True)), "path", "left").select("path", "code", "message", F.coalesce("asked", F.lit(False)).alias("asked"))


QUERIES = {"program_edits": program_edits}
ORACLES = {
    "program_edits": """
WITH k AS (SELECT s_suppkey AS k, greatest(s_suppkey - 1, 0) AS p, greatest(s_suppkey - 2, 0) AS pp FROM supplier),
s AS (SELECT k, 'steps/s' || k || '.rb' AS path, p IN (SELECT k FROM k) AS has_p, p IN (SELECT k FROM k) AND p % 5 = 0 AS p_changed, p IN (SELECT k FROM k) AND pp IN (SELECT k FROM k) AND pp % 5 = 0 AS pp_changed FROM k),
found AS (
  SELECT path, 'E0104' AS code, 'unresolved constant `Step0`' AS message FROM s, (VALUES (1), (2)) v(n) WHERE NOT has_p
  UNION ALL SELECT path, 'E0108', '`+` on String expects String, got Integer' FROM s WHERE pp_changed)
SELECT s.path, code, message, k % 5 = 0 OR p_changed OR pp_changed AS asked FROM s LEFT JOIN found ON found.path = s.path
"""
}
