"""Drift between two snapshots, as set operations that account for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def set_drift(fresh: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct rows in one snapshot only, marked ``new`` or ``gone``."""
    new = fresh.exceptAll(fresh.limit(0)).distinct().subtract(baseline).withColumn("change", F.lit("new"))
    return new.unionAll(baseline.subtract(fresh).withColumn("change", F.lit("gone")))


def line_hash(line) -> F.Column:
    """Sixteen hex digits that stand for a line and its end."""
    return F.substring(F.sha2(F.concat(line, F.lit("\n")), 256), 1, 16)


def hash_drift(fresh: DataFrame, baseline: DataFrame, line: str) -> DataFrame:
    one = lambda df: df.select(line_hash(F.col(line)).alias("hash"))
    return set_drift(one(fresh), one(baseline))


def attribute(fresh: DataFrame, baseline: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Each row of either side once: ``moved`` (a pair), ``new`` or ``gone``.

    Rows of equal keys are paired in the order of their lines; unpaired rows are new or gone.
    Rows that stand unchanged in both (keys and line) are left out first, copy by copy.
    """
    only_fresh, only_base = fresh.select(*keys, line).exceptAll(baseline.select(*keys, line)), baseline.select(*keys, line).exceptAll(fresh.select(*keys, line))
    w = Window.partitionBy(*keys).orderBy(line)
    a = only_fresh.withColumn("nth", F.row_number().over(w)).withColumnRenamed(line, "to_line")
    b = only_base.withColumn("nth", F.row_number().over(w)).withColumnRenamed(line, "from_line")
    kind = F.when(F.col("to_line").isNull(), "gone").when(F.col("from_line").isNull(), "new").otherwise("moved")
    return a.join(b, [*keys, "nth"], "full").select(*keys, "from_line", "to_line", kind.alias("change"))
