"""Resolution as joins: ranked, three-valued, suppressing, recursive and spatial look-ups.

Every function takes and returns DataFrames and leaves the physical strategy to the
optimiser.  What is not known stays apart from what is not there: look-ups answer
``found``, ``not_found`` or ``inconclusive``, never by a null alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.tables import cut, drop, small

FOUND, NOT_FOUND, INCONCLUSIVE = "found", "not_found", "inconclusive"


def first_by_rank(rows: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The row of least rank of each key (all columns); the rank must be a total order.

    One hash-partial aggregation on the keys: nothing is sorted, and hot keys are combined before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys and c not in rank]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*rank, *rest)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rank + rest))


def three_valued_lookup(probes: DataFrame, facts: DataFrame, keys: list[str], incomplete: str) -> DataFrame:
    """``verdict`` for each probe: found where a fact has its key, else inconclusive where ``incomplete`` holds or is null."""
    known = facts.select(*keys).distinct().withColumn("__hit", F.lit(True))
    verdict = F.when(F.col("__hit"), FOUND).when(F.coalesce(F.col(incomplete), F.lit(True)), INCONCLUSIVE).otherwise(NOT_FOUND)
    return probes.join(known, keys, "left").withColumn("verdict", verdict).drop("__hit")


def suppress(rows: DataFrame, sources: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows no source speaks for: a chain of anti joins, each on its own key."""
    for source, keys in sources:
        rows = rows.join(source.select(*keys).distinct(), keys, "left_anti")
    return rows


def priority_coalesce(rows: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]], out: str = "answer") -> DataFrame:
    """The first non-null answer of the sources in their order, and the name of the source that gave it."""
    for k, (_, source, value) in enumerate(sources):
        rows = rows.join(source.select(F.col(key), F.col(value).alias(f"__a{k}")), key, "left")
    label = F.lit(None).cast("string")
    for k in range(len(sources) - 1, -1, -1):
        label = F.when(F.col(f"__a{k}").isNotNull(), sources[k][0]).otherwise(label)
    answers = [F.col(f"__a{k}") for k in range(len(sources))]
    return rows.withColumn(out, F.coalesce(*answers)).withColumn(f"{out}_source", label).drop(*(f"__a{k}" for k in range(len(sources))))


def closure(edges: DataFrame, child: str, parent: str, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the least depth at which each ancestor is reached, up to ``most`` steps where given.

    Path lengths double in each round, so a chain of n steps takes log n rounds: a pair further
    than 2^k apart has a node 2^k from its start, and only pairs of just that depth are carried
    on.  Pairs keep their least depth, so cycles end.  Each round is a table in the shared folder,
    which keeps the plan short and survives lost executors.
    """
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node is not null and ancestor is not null").distinct()
    known, reach = cut(step.withColumn("depth", F.lit(1).cast("long")), "closure"), 1
    while most is None or reach < most:
        far = known.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        rest = known.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        if most is not None:
            rest = rest.filter(F.col("depth") <= most)
        found = known.unionAll(far.join(rest, "via").select("node", "ancestor", "depth"))
        new = cut(found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        drop(known)
        known, reach = new, reach * 2
        if (known.agg(F.max("depth")).first()[0] or 0) < reach:
            break
    return known


def point_in_span(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """The narrowest span of the same key that contains each point, both ends inclusive (ties: least start, then name).

    A span of a width below 2^l touches two blocks of 2^l places at most; points and spans meet on
    (key, l, block), so a key with very many spans is split over many blocks and no
    product of its points and spans is made.  Points in no span stay, with nulls.
    """
    wide = spans.select(key, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(name).alias("__name")).filter("__e >= __s")
    level = F.length(F.bin(F.col("__e") - F.col("__s"))).cast("int")
    wide = wide.withColumn("__l", level)
    block = lambda c: F.expr(f"shiftright({c}, __l)")
    wide = wide.withColumn("__b", F.explode(F.array_distinct(F.array(block("__s"), block("__e")))))
    # Only the levels that some span has: a row each, 64 at most.
    used = [r[0] for r in wide.select("__l").distinct().collect()]
    levels = F.array(*(F.lit(k) for k in sorted(used))).cast("array<int>")
    asked = points.select(key, F.col(at).alias("__at")).distinct()
    asked = asked.withColumn("__l", F.explode(levels)).withColumn("__b", F.expr("shiftright(cast(__at as bigint), __l)"))
    hit = asked.join(wide, [key, "__l", "__b"]).filter("__at >= __s and __at <= __e")
    best = hit.groupBy(key, "__at").agg(F.min(F.struct((F.col("__e") - F.col("__s")).alias("w"), F.col("__s").alias("s"), F.col("__name").alias("name"), F.col("__e").alias("e"))).alias("__hit"))
    got = points.join(best.withColumnRenamed("__at", at), [key, at], "left")
    return got.select(*points.columns, F.col("__hit.name").alias(name), F.col("__hit.s").alias(start), F.col("__hit.e").alias(end))


def suggest(misses: DataFrame, names: DataFrame, typo: str, name: str, within: int = 2, scope: list[str] | None = None, hub: bool = False) -> DataFrame:
    """The closest other name within an edit distance, ties by name; misses without one stay.

    Without a scope, or in one that may have very many names (``hub``), candidates meet on shared deletion
    variants: two words within distance d agree after deleting at most d characters each, so an
    equi join on them finds all and no product of the two sides is made.  The nearest words are
    asked first: a miss that has one takes no part in the next distance, where there are many more variants.
    """
    keys = scope or []

    def variants(col: str, most: int) -> Column:
        c = F.col(col)
        size = F.length(c)
        drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, size)))
        out = F.array(c)
        layer = F.array(c)
        for _ in range(most):
            layer = F.array_distinct(F.flatten(F.transform(layer, drop)))
            out = F.concat(out, layer)
        return F.array_distinct(out)

    def nearest(pairs: DataFrame, most: int) -> DataFrame:
        near = pairs.withColumn("__d", F.levenshtein(F.col(typo), F.col("__name"), most)).filter((F.col("__d") >= 1) & (F.col(typo) != F.col("__name")))
        return near.groupBy(*keys, typo).agg(F.min(F.struct("__d", "__name")).alias("b"))

    left = misses.select(*keys, typo).distinct().filter(F.col(typo).isNotNull())
    right = names.select(*keys, F.col(name).alias("__name")).distinct().filter("__name is not null")
    if scope and not hub:
        best = nearest(left.join(right, keys), within)
    else:
        left, best = cut(left, "typos"), None
        right = cut(right, "names")
        for most in range(1, within + 1):
            # No name is near whose length is not that of a typo, give or take: a few dozen lengths.
            sizes = left.select(*keys, F.explode(F.sequence(F.length(typo) - most, F.length(typo) + most)).alias("__size")).distinct()
            able = right.withColumn("__size", F.length("__name")).join(sizes, [*keys, "__size"], "left_semi").drop("__size")
            # A name becomes very many rows, which no estimate knows: they are never broadcast.
            spread = able.withColumn("__v", F.explode(variants("__name", most))).hint("merge")
            found = nearest(left.withColumn("__v", F.explode(variants(typo, most))).join(spread, [*keys, "__v"]), most)
            best = found if best is None else best.unionAll(found)
            if most < within:
                best = cut(best, "near")
                left = left.join(best.select(*keys, typo), [*keys, typo], "left_anti")
    best = best.select(*keys, typo, F.col("b.__name").alias("suggestion"), F.col("b.__d").cast("long").alias("distance"))
    return misses.join(best, [*keys, typo], "left")


#: 64-bit words of the bits that stand for the providers of a need, and the one bit of a provider, by its hash.
MARKS = [f"__m{k}" for k in range(4)]
BIT = f"cast(pmod(xxhash64(__by), {64 * len(MARKS)}) as int)"


def _mark(k: int) -> Column:
    """Word ``k`` of a provider's bit."""
    return F.expr(f"if(shiftright({BIT}, 6) = {k}, shiftleft(1L, {BIT} & 63), 0L)")


def _marked() -> Column:
    """Whether a provider's bit is among those of its row."""
    words = " ".join(f"when {k} then {m}" for k, m in enumerate(MARKS))
    return F.expr(f"getbit(case shiftright({BIT}, 6) {words} end, {BIT} & 63) = 1")


def candidate_intersection(calls: DataFrame, providers: DataFrame, group: str, need: str, provider: str) -> DataFrame:
    """Providers that answer every distinct need of a group, and what that proves.

    Fewer than two needs prove nothing; a need nobody answers proves nothing; an empty
    intersection is a contradiction; one provider is inferred, two to four are a union.
    Providers of a need are first met as a few words of hashed bits.  Groups whose needs have no bit in common have no
    candidate; of the others only offers whose bit all needs of some group share are looked at, exactly.
    Groups with the same needs have the same answer, and providers of the same offers answer alike: one of each
    kind is asked, and counts for all.  Kinds are told by the number and two 64-bit hashes of their members.
    """
    kind = [F.count("*").alias("__size"), F.bit_xor(F.xxhash64(need)).alias("__h1"), F.bit_xor(F.xxhash64(F.lit(1), F.col(need))).alias("__h2")]
    same = ["__size", "__h1", "__h2"]
    every = cut(calls.select(group, need).distinct(), "needs")
    # What has no key meets nobody.
    offered = cut(providers.select(need, F.col(provider).alias("__by")).filter("__by is not null").distinct(), "offered")
    known = offered.groupBy(need).agg(F.count("*").alias("__n"), *(F.bit_or(_mark(k)).alias(m) for k, m in enumerate(MARKS)))
    # With as many providers as there are bits, these say little: such needs are left to the exact step.
    known = cut(known.select(need, "__n", *(F.when(F.col("__n") < 64 * len(MARKS), F.col(m)).otherwise(-1).alias(m) for m in MARKS)), "known")
    told = every.join(small(known), need, "left").groupBy(group)
    told = cut(told.agg(F.count("*").alias("needs"), F.count("__n").alias("answered"), F.min("__n").alias("__n"), *(F.bit_and(m).alias(m) for m in MARKS)), "told")
    drop(known)
    unsure = told.filter(F.col(group).isNotNull()).filter("needs > 1 and answered = needs").filter(" or ".join(f"{m} <> 0" for m in MARKS))
    marked = cut(every.join(unsure.select(group, *MARKS), group), "unsure")
    drop(every)
    groups = cut(marked.groupBy(group).agg(*kind), "groups")
    asked = groups.groupBy(*same).agg(F.min(group).alias(group))
    wanted = cut(marked.join(asked.select(group), group, "left_semi"), "wanted")
    drop(marked)
    useful = wanted.groupBy(need).agg(*(F.bit_or(m).alias(m) for m in MARKS))
    offers = cut(offered.join(useful, need).filter(_marked()).select(need, "__by"), "offers")
    drop(offered)
    alike = cut(offers.groupBy("__by").agg(*kind), "alike")
    first = alike.groupBy(*same).agg(F.min("__by").alias("__first"), F.count("*").alias("__many")).filter("__many > 1")
    copies = cut(alike.join(first, same).select("__by", "__first", "__many"), "copies")
    if not copies.isEmpty():
        offers = cut(offers.join(copies.filter("__by <> __first").select("__by"), "__by", "left_anti"), "kinds")
    count = offers.groupBy(need).agg(F.count("*").alias("__n"))
    wants = cut(wanted.join(count, need, "left"), "wants")
    drop(wanted)
    size = wants.groupBy(group, *MARKS).agg(F.count("*").alias("__needs"), F.count("__n").alias("__answered"), F.min(F.struct("__n", need)).alias("__rare"))
    # Whoever answers everything answers the rarest need: only its providers are tried on the others.
    tried = cut(size.filter("__answered = __needs").select(group, "__needs", F.col(f"__rare.{need}").alias("__need"), *MARKS), "tried")
    start = tried.join(offers.withColumnRenamed(need, "__need"), "__need").filter(_marked()).select(group, "__by", "__needs")
    rest = wants.join(tried.select(group, "__need"), group).filter(F.col(need) != F.col("__need")).select(group, need)
    able = start.join(rest, group).join(offers.select(need, "__by"), [need, "__by"], "left_semi")
    able = able.groupBy(group, "__by", "__needs").agg(F.count("*").alias("__k")).filter("__k = __needs - 1").select(group, "__by")
    able = able.join(copies.select("__by", "__many"), "__by", "left").groupBy(group).agg(F.sum(F.coalesce("__many", F.lit(1).cast("long"))).alias("candidates"))
    able = groups.join(able.join(groups, group).drop(group), same).select(group, "candidates")
    alone = F.when((F.col("needs") == 1) & F.col(group).isNotNull(), F.col("__n"))
    got = told.join(able, group, "left").select(group, "needs", "answered", F.coalesce("candidates", alone, F.lit(0).cast("long")).alias("candidates"))
    outcome = F.when((F.col("needs") < 2) | (F.col("answered") < F.col("needs")), "nothing").when(F.col("candidates") == 0, "contradiction").when(F.col("candidates") == 1, "inferred").when(F.col("candidates") <= 4, "union").otherwise("nothing")
    return got.withColumn("outcome", outcome)


def bind_args(calls: DataFrame, call: str, args: str, params: DataFrame, callee: str, names: str) -> DataFrame:
    """(call, ordinal, argument, parameter): arguments bound by position; those beyond the parameters have none."""
    a = calls.select(call, callee, F.posexplode(args).alias("ordinal", "argument"))
    p = params.select(callee, F.posexplode(names).alias("ordinal", "parameter"))
    return a.join(p, [callee, "ordinal"], "left").select(call, callee, F.col("ordinal").cast("long").alias("ordinal"), "argument", "parameter")


def arity_mismatch(given: Column, required: Column, most: Column) -> Column:
    """True where a count is outside its range; an unknown upper bound is none; anything else unknown is no mismatch."""
    return F.coalesce((given < required) | (most.isNotNull() & (given > most)), F.lit(False))


def ranked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``rank`` from 1 within each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
