"""SimHash fingerprints and a Hamming search by permuted block tables, in DataFrame functions only.

Features are neighbouring word pairs (the last word pairs with nothing), weighted
by their length, which stands in for rarity without a pass over the corpus.  Each
feature's 64-bit hash votes with its weight on every bit; a bit is set where the
votes for it are the majority.  Votes are kept as 32 long sums of two 32-bit lanes
each, so the sums stay in generated code (a text may have 2**31 units of weight).

The search: ``BLOCKS`` blocks of bits, and a table for each choice of ``BLOCKS`` -
``radius`` of them; two fingerprints within the radius agree in all blocks of some
table.  Equal fingerprints are searched once.  A pair is met in its first table only.

Null texts count as empty; a text without a word has fingerprint 0.  Rows of one id
are ordered by their text's hash.  Rows without an id come first.
"""

from __future__ import annotations

from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm import base

NOT_WORD = r"[^\p{L}\p{N}]+"
BLOCKS, RADIUS = 6, 3
#: Bytes (estimated) of a range of neighbouring documents, ranges at most (a few MB to broadcast), and quantiles that part the ids first.
RANGE_BYTES, MOST_RANGES, COARSE = 256 << 20, 400_000, 500


def _lane(h: Column, k: int) -> Column:
    return F.shiftright(h, k).bitwiseAND(F.lit(1)) + F.shiftleft(F.shiftright(h, k + 32).bitwiseAND(F.lit(1)), 32)


def _votes(h: str, weight: str) -> list[Column]:
    return [F.sum(_lane(F.col(h), k) * F.col(weight)).alias(f"__v{k}") for k in range(32)] + [F.sum(weight).alias("__total")]


def _majority() -> Column:
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"__v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(f"__v{k}", 32)
        for at, x in ((k, low), (k + 32, high)):
            out = out.bitwiseOR(F.when(x * 2 > F.col("__total"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp`` (long) of each row; rows of equal keys are one text in parts."""
    words = rows.select(*keys, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, " ")), " ").alias("__w"))
    pairs = words.select(*keys, F.inline_outer(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.size("__w")).alias("b"))))
    b = F.coalesce("b", F.lit(""))
    one = pairs.select(*keys, F.xxhash64("a", b).alias("__h"), F.when(F.coalesce("a", F.lit("")) == "", 0).otherwise(1 + F.least(F.floor((F.length("a") + F.length(b)) / 4), F.lit(5))).cast("long").alias("__weight"))
    return one.groupBy(*keys).agg(*_votes("__h", "__weight")).select(*keys, _majority().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the features, from the share of differing bits; 0 where negative."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (pi / 64)))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ranged(rows: DataFrame, per_task: int = RANGE_BYTES) -> DataFrame:
    """Rows (id, tie, ...) dealt to ranges ``part`` of (id, tie); each range also has the first rows of the next one that
    has any (``ghost`` 1), the last that of the first (2).

    So a row's successor is in its own range, and no task sees the whole order.  There are as many
    ranges as the engine's estimate of the bytes asks for: first by quantiles of the ids, then, where
    these are too few, by equal parts between two quantiles.  Rows without an id are parted by their
    tie.  Ids that are no numbers make one range.  Only ids are read to find the ranges.
    """
    kind = rows.schema["id"].dataType
    numeric = isinstance(kind, T.NumericType)
    # Text is about a third in files of what it is in memory.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * 3
    want = max(4 * base.parts(rows.sparkSession), min(-(-size // per_task), MOST_RANGES))
    coarse = min(want, COARSE)
    quantiles = F.percentile_approx("id", [k / coarse for k in range(coarse + 1)], 20 * COARSE) if numeric else F.array()
    stats = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("no_id"), quantiles.alias("edges")).first()
    edges, loose = sorted(set(stats.edges or [])), -(-want * stats.no_id // max(stats.rows, 1))
    parts = -(-want // coarse)
    own = F.lit(0)
    if len(edges) > 1:
        at = F.least(F.greatest(F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in edges)), lambda x: x <= F.col("id"))), F.lit(1)), F.lit(len(edges) - 1))
        low, high = (F.element_at(F.array(*(F.lit(float(x)) for x in edges)), at + k) for k in (0, 1))
        place = F.least(F.floor((F.col("id").cast("double") - low) / (high - low) * parts), F.lit(parts - 1))
        own = (at - 1) * parts + F.greatest(place, F.lit(0))
    tie = F.lit(None).cast("long")
    if loose:
        tie = F.when(F.col("id").isNull(), F.col("tie"))
        free = F.least(F.greatest(F.floor((F.col("tie") / float(1 << 64) + 0.5) * loose), F.lit(0)), F.lit(loose - 1))
        own = F.when(F.col("id").isNull(), free).otherwise(own + loose)
    rows = rows.withColumn("b", own.cast("long"))
    # One row for each range that has any, MOST_RANGES and the rounding at most, so a single window can order them.
    first = rows.groupBy("b").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), F.col("id"), tie.alias("tie"))).alias("first"))
    w = Window.orderBy("b")
    first = first.select("b", "first", F.lag("b").over(w).alias("before"), F.max("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    met = rows.join(F.broadcast(first), "b")
    heads = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("id").isNotNull() | F.col("tie").eqNullSafe(F.col("first.tie")))
    stays = F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))
    goes = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("b"), F.lit(1).alias("ghost"))).otherwise(F.struct(F.col("last").alias("b"), F.lit(2).alias("ghost")))
    return met.withColumn("to", F.explode(F.when(heads, F.array(stays, goes)).otherwise(F.array(stays)))).select(*(c for c in rows.columns if c != "b"), F.col("to.b").alias("part"), "to.ghost")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the next document's beginning)."""
    src = docs.select(base.column(doc_id).alias("id"), F.coalesce(base.column(text), F.lit("")).alias("text"))
    src = src.select("id", F.xxhash64("text").alias("tie"), F.length("text").cast("long").alias("n_chars"), "text")
    rows = ranged(src)
    w = Window.partitionBy("part").orderBy("ghost", F.col("id").asc_nulls_first(), "tie")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(w))
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))))
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    # Repeated rows are equal in all of these, so a place among them tells them apart.
    rows = rows.withColumn("k", F.row_number().over(w))
    keys = ["part", "ghost", "id", "tie", "k", "n_chars", "sha"]
    both = rows.select(*keys, F.explode(F.filter(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))), lambda x: x["t"].isNotNull())).alias("x")).select(*keys, "x.which", "x.t")
    # Grouped within the ranges they are dealt to: no further exchange.
    fp = fingerprints(both, "t", [*keys, "which"])
    per = fp.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    w = Window.partitionBy("part").orderBy("ghost", F.col("id").asc_nulls_first(), "tie", "k")
    per = per.withColumn("next_fp", F.lead("fp").over(w)).filter("ghost = 0")
    return per.select("id", "n_chars", F.col("sha").alias("edited_sha256"), "fp", "efp", likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def _masks(radius: int, blocks: int) -> list[int]:
    """A bit mask for each table: the blocks that must agree."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    of = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(blocks)]
    out = [sum(of[k] for k in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query, found) fingerprints within ``radius`` bits; both inputs have a long column ``fp``."""
    masks = _masks(radius, blocks)
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    deal = lambda df, name: df.select("fp").distinct().select(F.col("fp").alias(name), F.inline(tables))
    x = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for k in range(len(masks) - 1, -1, -1):
        first = F.when(x.bitwiseAND(F.lit(masks[k])) == 0, k).otherwise(first)
    q, i = deal(queries, "query").alias("q"), deal(index, "found").alias("i")
    on = (F.col("q.table") == F.col("i.table")) & (F.col("q.key") == F.col("i.key")) & (F.bit_count(x) <= radius) & (first == F.col("q.table"))
    return q.join(i, on).select("query", "found")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 50) -> DataFrame:
    """The report of each document; ``n_within``: documents within RADIUS bits of it, for ids divisible by ``every``."""
    fps = base.cut(edited(docs, doc_id, text), "simhash")
    is_query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    copies = base.cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.bool_or(is_query).alias("asked")), "simhash-prints")
    within = search(copies.filter("asked"), copies).join(copies.select(F.col("fp").alias("found"), "n"), "found").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("n_within"))
    # A table of its own: the join with it has plain exchanges, which the engine splits where a print has very many documents.
    within = base.cut(within, "simhash-within")
    got = fps.filter(is_query).join(within, "fp").unionByName(fps.filter(~is_query).withColumn("n_within", F.lit(None).cast("long")))
    return got.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_within")
