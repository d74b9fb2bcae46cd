"""Order within a key: lines, carried values, last writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start_byte, end_byte, utf16, content): lines from 0, and the bytes they take without their end."""
    parts = F.split(F.col(text), "\n", -1)
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("line", "content"))
    before = F.sum(F.octet_length("content") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    utf16 = (F.octet_length(F.encode("content", "UTF-16BE")) / 2).cast("long")
    return rows.select(key, F.col("line").cast("long").alias("line"), start.alias("start_byte"), (start + F.octet_length("content")).alias("end_byte"), utf16.alias("utf16"), "content")


def line_of(offsets: DataFrame, line_rows: DataFrame, key: str, offset: str) -> DataFrame:
    """The line of each byte offset: the last one that starts at or before it; offsets beyond the end are clamped.

    Lines and offsets are swept together in order: one exchange, no product of a key's lines and offsets.
    """
    at = F.greatest(F.col(offset), F.lit(0)).cast("long")
    kind = offsets.schema[key].dataType
    asked = offsets.select(F.struct(*offsets.columns).alias("__row"), F.col(key).alias("__key"), at.alias("__at"), F.lit(None).cast("struct<line:bigint,s:bigint,e:bigint>").alias("__line"))
    known = line_rows.select(F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), F.col(key).cast(kind).alias("__key"), F.col("start_byte").alias("__at"), F.struct(F.col("line").alias("line"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e")).alias("__line"))
    # At one place the line comes before the offsets.
    w = Window.partitionBy("__key").orderBy("__at", F.col("__line").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = asked.unionAll(known).withColumn("__line", F.last("__line", ignorenulls=True).over(w)).filter("__row is not null and __line is not null")
    return got.select("__row.*", F.col("__line.line").alias("line"), (F.least(F.col("__at"), F.col("__line.e")) - F.col("__line.s")).alias("byte_column"))


def offset_of(places: DataFrame, line_rows: DataFrame, key: str, line: str, column: str) -> DataFrame:
    """Byte offset of (line, UTF-16 column): columns beyond the line end at it."""
    text = line_rows.select(key, F.col("line").alias(line), "start_byte", "content")
    units = F.transform(F.split("content", ""), lambda c: F.struct((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long").alias("u"), F.octet_length(c).cast("long").alias("b")))
    walked = F.aggregate(units, F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("b")), lambda s, x: F.when(s["u"] + x["u"] <= F.col(column), F.struct((s["u"] + x["u"]).alias("u"), (s["b"] + x["b"]).alias("b"))).otherwise(F.struct(F.lit(1 << 40).cast("long").alias("u"), s["b"].alias("b"))))
    return places.join(text, [key, line]).withColumn("offset", F.col("start_byte") + walked["b"]).drop("start_byte", "content")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value at or before each row of its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version of each key."""
    rest = [c for c in rows.columns if c not in keys and c not in version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{c}").alias(c) for c in version + rest))


def after_last(rows: DataFrame, keys: list[str], order: str, is_write) -> DataFrame:
    """Rows after the last write of their key; all of them where there is none."""
    last = rows.groupBy(*keys).agg(F.max(F.when(is_write, F.col(order))).alias("__w"))
    return rows.join(last, keys).filter(F.col("__w").isNull() | (F.col(order) > F.col("__w"))).drop("__w")
