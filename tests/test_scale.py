"""What grows with the input: estimates of tables, facts held at a time, suggestions and candidates among very many names."""

import random

from pyspark.sql import functions as F

from factloom.operators import resolve
from factloom.plans.program import Program
from factloom.plans.tables import cut
from factloom.sources import facts


def test_tables_are_estimated_by_their_rows(spark):
    table = cut(spark.range(20_000).select(F.concat(F.lit("shop/supplier"), F.col("id").cast("string"), F.lit(".rb")).alias("path"), F.lit("Integer").alias("type")), "estimate")
    held = table.agg(F.sum(F.length("path") + F.length("type"))).first()[0]
    assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > held


def test_facts_of_a_batch_are_made_in_runs(spark):
    texts = ["x" * n for n in (0, 10, 700_000, 10, 400_000, 200_000)] + [None] * 1200
    bounds = list(facts.slices(texts))
    assert [k for lo, hi in bounds for k in range(lo, hi)] == list(range(len(texts)))
    for lo, hi in bounds:
        assert hi - lo <= 500 and (hi - lo == 1 or sum(len(t or "") for t in texts[lo:hi]) <= 500_000)
    assert list(facts.slices([])) == []


def test_suggestions_in_a_scope_of_very_many_names(spark):
    names = spark.range(3000).select(F.lit("String").alias("c"), F.concat(F.lit("only"), F.col("id").cast("string")).alias("n"))
    misses = names.select("c", F.regexp_replace("n", "only", "onlyy").alias("w")).unionAll(spark.createDataFrame([("String", "oly12x"), ("String", "far_away"), ("Other", "only1")], "c string, w string"))
    got = resolve.suggest(misses, names, "w", "n", scope=["c"], hub=True)
    # Variants are rows that no estimate knows: the side that makes them is not sent to the driver.
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.c, r.w): (r.suggestion, r.distance) for r in got.collect()}
    assert len(rows) == 3003
    for k in range(3000):
        near = [f"only{k}"] + [f"only{d}{k}" for d in range(1, 10) if int(f"{d}{k}") < 3000]
        assert rows["String", f"onlyy{k}"] == (min(near), 1)
    assert rows["String", "oly12x"] == ("only12", 2) and rows["String", "far_away"] == (None, None) and rows["Other", "only1"] == (None, None)


def test_candidates_of_one_kind_are_asked_once(spark, monkeypatch):
    seen = {}

    def watched(df, label):
        out = cut(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(resolve, "cut", watched)
    n = 300
    ids = spark.range(n).select(F.col("id").cast("string").alias("k"), "id")
    calls = ids.select(F.concat(F.lit("g"), "k").alias("g"), F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("lid"), F.lit("glass"))).when(F.col("id") % 3 == 1, F.array(F.lit("lid"), F.lit("upcase"))).otherwise(F.array(F.lit("lid"), F.lit("rare")))).alias("need"))
    offers = ids.select(F.explode(F.array(F.lit("lid"), F.lit("glass"))).alias("need"), F.concat(F.lit("Jar"), "k").alias("p")).unionAll(ids.select(F.lit("lid"), F.concat(F.lit("Tin"), "k"))).unionAll(ids.select(F.lit("other"), F.concat(F.lit("Tin"), "k")))
    offers = offers.unionAll(spark.createDataFrame([("upcase", "String"), ("rare", "Jar7"), ("rare", "Jar8")], "need string, p string"))
    got = {r.g: (r.needs, r.answered, r.candidates, r.outcome) for r in resolve.candidate_intersection(calls, offers, "g", "need", "p").collect()}
    want = [(2, 2, n, "nothing"), (2, 2, 0, "contradiction"), (2, 2, 2, "union")]
    assert got == {f"g{k}": want[k % 3] for k in range(n)}
    assert seen["wants"] == 6


def test_candidates_of_a_group_without_a_key(spark):
    calls = spark.createDataFrame([(None, "a"), (None, "b"), ("one", "a"), ("one", "b")], "g string, need string")
    offers = spark.createDataFrame([("a", "P"), ("b", "P")], "need string, p string")
    got = {r.g: tuple(r)[1:] for r in resolve.candidate_intersection(calls, offers, "g", "need", "p").collect()}
    assert got == {None: (2, 2, 0, "contradiction"), "one": (2, 2, 1, "inferred")}


def _shuffled(spark):
    """Records shuffled by all stages so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs, seen, total = store.jobsList(None), set(), 0
    for k in range(jobs.size()):
        stages = jobs.apply(k).stageIds().iterator()
        while stages.hasNext():
            seen.add(stages.next())
    for stage in seen:
        try:
            total += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception:  # noqa: BLE001 - the store forgets old stages
            continue
    return total


def test_candidates_are_sought_among_what_all_needs_share(spark, monkeypatch):
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    rng = random.Random(4)
    offers = {k: set(rng.sample(range(2000), 40)) for k in range(200)}
    calls = {g: set(rng.sample(range(200), 3)) for g in range(3000)}
    # Some share a provider, or five.
    for g in range(0, 100, 2):
        for k in calls[g]:
            offers[k] |= {5000} if g < 50 else set(range(5000 + g, 5005 + g))
    make = lambda d, names: spark.createDataFrame([(k, x) for k, v in d.items() for x in sorted(v)], names).repartition(4)
    asked, offered = cut(make(calls, "g long, need long"), "asked"), cut(make(offers, "need long, p long"), "offered")
    before = _shuffled(spark)
    # As with tables too large to broadcast.
    monkeypatch.setattr(resolve, "small", lambda df: df)
    had = [spark.conf.get(c, None) for c in limits]
    for c in limits:
        spark.conf.set(c, "-1")
    try:
        got = {r.g: (r.needs, r.answered, r.candidates) for r in resolve.candidate_intersection(asked, offered, "g", "need", "p").collect()}
    finally:
        for c, old in zip(limits, had):
            spark.conf.unset(c) if old is None else spark.conf.set(c, old)
    want = {g: (3, 3, len(set.intersection(*(offers[k] for k in needs)))) for g, needs in calls.items()}
    assert got == want and len({n for _, _, n in want.values()}) > 2
    # The providers of a need do not go with every group that has it, once and again for its other needs.
    assert _shuffled(spark) - before < 2 * len(calls) * 40


def test_orders_and_look_ups_shuffle_classes_not_pairs(spark):
    n = 400
    text = lambda k: f"class C{k}{f' < C{k - 1}' if k else ''}\n  def label\n    1\n  end\n  def link\n    C{max(k - 1, 0)}.new.label\n  end\nend\n"
    p = Program(spark.createDataFrame([(f"{k}.rb", text(k)) for k in range(n)], "path string, text string"))
    pairs = n * (n + 1) // 2
    before = _shuffled(spark)
    assert {(r.root, r.node, r.rank) for r in p.mro.collect()} == {(f"C{k}", f"C{k - j}", j + 1) for k in range(n) for j in range(k + 1)}
    assert _shuffled(spark) - before < pairs // 2
    before = _shuffled(spark)
    rows = p.sites.select("name", "class_path", "target", "verdict").collect()
    assert _shuffled(spark) - before < pairs // 2
    assert {(r.class_path, r.verdict) for r in rows if r.name == "label"} == {(f"C{k}", "found") for k in range(n - 1)}
    assert all(r.target.endswith("#label#false") and r.target.startswith(r.class_path[1:] + ".rb#") for r in rows if r.name == "label")
