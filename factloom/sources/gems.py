"""Open-world evidence: what locked gems may add, and whether every gem is accounted for.

Everything here only silences; a gem that cannot be accounted for keeps the world open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources import facts as source_facts


def covered(locks: DataFrame, rbi_versions: DataFrame) -> DataFrame:
    """Gems whose declarations are of the locked version: the same, or that version and a revision after a dash."""
    pairs = locks.select("gem", "version").distinct().join(rbi_versions.select("gem", F.col("version").alias("declared")), "gem")
    return pairs.filter((F.col("declared") == F.col("version")) | F.col("declared").startswith(F.concat("version", F.lit("-")))).select("gem", "version").distinct()


def accounting(locks: DataFrame, rbi_versions: DataFrame, curated: DataFrame, installed: DataFrame) -> DataFrame:
    """``status`` of each locked gem: declared, curated, installed, native or missing, in that order.

    ``installed``: (gem, version, native).  Only the last two keep the world open.
    """
    gems = locks.select("gem", "version").distinct()
    got = gems.join(covered(locks, rbi_versions).withColumn("d", F.lit(True)), ["gem", "version"], "left")
    got = got.join(curated.select("gem").distinct().withColumn("c", F.lit(True)), "gem", "left").join(installed.groupBy("gem", "version").agg(F.bool_or("native").alias("native")), ["gem", "version"], "left")
    status = F.when(F.col("d"), "declared").when(F.col("c"), "curated").when(F.col("native"), "native").when(F.col("native").isNotNull(), "installed").otherwise("missing")
    return got.select("gem", "version", status.alias("status"))


def evidence(status: DataFrame) -> DataFrame:
    """One row: is the world closed, and the first reason why not."""
    bad = F.when(F.col("status").isin("native", "missing"), F.concat("gem", F.lit(": "), "status"))
    return status.agg(F.min(bad).alias("reason")).select(F.col("reason").isNull().alias("closed"), "reason")


def harvest(sources: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(namespace, name) that files add to the ``chain`` of namespaces (name), and the namespaces they leave open."""
    found = source_facts.facts(sources)
    want = chain.select(F.col("name").alias("class_path"))
    names = source_facts.table(found, "methods").join(want, "class_path", "left_semi").select(F.col("class_path").alias("namespace"), "name").distinct()
    opened = source_facts.table(found, "fragments").filter("open_reason is not null").join(want, "class_path", "left_semi").select(F.col("class_path").alias("namespace")).distinct()
    return names, opened


def unloaded(listing: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files of a project that a run does not load."""
    return listing.join(loaded.select("path"), "path", "left_anti")


def hazards(sources: DataFrame) -> DataFrame:
    """Paths that redefine type tests or reopen the signature library: their contracts prove nothing."""
    likely = sources.filter(F.col("text").contains("is_a?") | F.col("text").contains("kind_of?") | F.col("text").contains("T::") | F.col("text").contains("module T"))
    found = source_facts.facts(likely)
    tests = source_facts.table(found, "methods").filter(F.col("name").isin("is_a?", "kind_of?", "instance_of?", "===", "nil?")).select("path")
    opened = source_facts.table(found, "fragments").filter(F.col("class_path") == "T").select("path")
    return tests.unionAll(opened).distinct()
