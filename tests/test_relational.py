"""The generic operators: laws, edge cases, and the SQL of every query."""

import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import drift, lattice, resolve, sequence
from factloom.plans import registry
from factloom.sources import gems

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_by_rank_and_three_values(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "z")], "k string, r int, v string")
    assert rows(resolve.first_by_rank(df, ["k"], ["r"])) == sorted([("a", 1, "y"), ("b", 5, None), (None, 1, "z")], key=repr)
    probes = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", None)], "k string, open boolean")
    facts = spark.createDataFrame([("a",), ("a",)], "k string")
    assert {r.k: r.verdict for r in resolve.three_valued_lookup(probes, facts, ["k"], "open").collect()} == {"a": "found", "b": "not_found", "c": "inconclusive", "d": "inconclusive"}


def test_closure_ends_on_cycles_and_caps(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "c int, p int")
    assert rows(resolve.closure(edges, "c", "p")) == sorted([(a, b, d) for a in (1, 2, 3) for b in (1, 2, 3) for d in [(b - a) % 3 or 3]] + [(4, 4, 1)], key=repr)
    assert resolve.closure(edges, "c", "p", 1).count() == 4
    assert resolve.closure(edges.limit(0), "c", "p").count() == 0


def test_point_in_span(spark):
    points = spark.createDataFrame([("a", 5), ("a", 99), ("b", 1)], "k string, at int")
    spans = spark.createDataFrame([("a", 0, 9, "wide"), ("a", 5, 6, "narrow"), ("a", 4, 5, "left")], "k string, s int, e int, name string")
    got = {(r.k, r["at"]): r.name for r in resolve.point_in_span(points, spans, "k", "at", "s", "e", "name").collect()}
    assert got == {("a", 5): "left", ("a", 99): None, ("b", 1): None}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25))
def test_suggest_equals_all_pairs(spark, words):
    df = spark.createDataFrame([(w,) for w in set(words)], "w string")
    got = {r.w: r.suggestion for r in resolve.suggest(df, df.select(F.col("w").alias("n")), "w", "n").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for w in set(words):
        near = [(distance(w, x), x) for x in set(words) if x != w and distance(w, x) <= 2]
        assert got[w] == (min(near)[1] if near else None)


def test_candidate_intersection(spark):
    calls = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b"), ("none", "a"), ("none", "c"), ("bad", "b"), ("bad", "d"), ("two", "a")], "g string, need string")
    offers = spark.createDataFrame([("a", "P"), ("b", "P"), ("a", "Q"), ("d", "Q")], "need string, p string")
    got = {r.g: r.outcome for r in resolve.candidate_intersection(calls, offers, "g", "need", "p").collect()}
    assert got == {"one": "nothing", "two": "inferred", "none": "nothing", "bad": "contradiction"}


ATOMS = st.lists(st.sampled_from(["Integer", "String", "nil", "Foo", "untyped"]), min_size=1, max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(ATOMS, min_size=1, max_size=4))
def test_type_join_laws(spark, groups):
    df = spark.createDataFrame([(k, g) for k, g in enumerate(groups)], "k int, t array<string>")
    joined = df.agg(lattice.type_join(F.col("t")).alias("t")).first().t
    flat = {x for g in groups for x in g}
    assert joined == (["untyped"] if "untyped" in flat else sorted(flat))
    twice = df.unionAll(df.orderBy(F.desc("k"))).agg(lattice.type_join(F.col("t")).alias("t")).first().t
    assert twice == joined


def test_strip(spark):
    df = spark.createDataFrame([(["A", "nil"],), (["nil"],), (["A", "untyped"],), (["A"],), (["A", "B"],)], "t array<string>")
    assert [r.x for r in df.select(lattice.strip(F.col("t"), F.lit("A")).alias("x")).collect()] == [["nil"], None, None, None, ["B"]]
    assert [r.x for r in df.select(lattice.strip_nil(F.col("t")).alias("x")).collect()] == [["A"], ["untyped"], ["A", "untyped"], ["A"], ["A", "B"]]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 4)), max_size=12), st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 4)), max_size=12))
def test_drift_accounts_for_every_row(spark, fresh, base):
    make = lambda x: spark.createDataFrame(x, "code string, line int")
    got = drift.attribute(make(fresh), make(base), ["code"], "line").collect()
    count = lambda kind: sum(r.change == kind for r in got)
    same = sum(min(fresh.count(x), base.count(x)) for x in set(fresh))
    assert count("new") + count("moved") == len(fresh) - same and count("gone") + count("moved") == len(base) - same
    both = drift.set_drift(make(fresh), make(base)).collect()
    assert {(r.code, r.line) for r in both if r.change == "new"} == set(fresh) - set(base)


def test_lines_and_offsets(spark):
    text = "ab\né😀x\n\nlast"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    lines = sequence.lines(df, "k", "t")
    got = [(r.line, r.start_byte, r.end_byte, r.utf16) for r in lines.filter("k = 1").orderBy("line").collect()]
    assert got == [(0, 0, 2, 2), (1, 3, 10, 4), (2, 11, 11, 0), (3, 12, 16, 4)]
    at = spark.createDataFrame([(1, 0), (1, 9), (1, 11), (1, 999), (2, 0), (2, 5)], "k int, o long")
    assert {(r.k, r.o): (r.line, r.byte_column) for r in sequence.line_of(at, lines, "k", "o").collect()} == {(1, 0): (0, 0), (1, 9): (1, 6), (1, 11): (2, 0), (1, 999): (3, 4), (2, 0): (0, 0), (2, 5): (0, 0)}
    places = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 1, 3), (1, 1, 2), (1, 1, 99)], "k int, l long, c long")
    assert {r.c: r.offset for r in sequence.offset_of(places, lines, "k", "l", "c").collect()} == {0: 3, 1: 5, 3: 9, 2: 5, 99: 10}


def test_names(spark):
    df = spark.createDataFrame([("HTTPServerLog",), ("Admin::Category",), ("Box",), ("Day",)], "n string")
    assert [r.t for r in df.select(names.table_name(F.col("n")).alias("t")).collect()] == ["http_server_logs", "categories", "boxes", "days"]
    paths = spark.createDataFrame([("app/a.rb",), ("vendor/app/x",), ("myapp/x",), ("lib/app",)], "p string")
    assert [r.x for r in paths.select(names.ignored(F.col("p"), "app").alias("x")).collect()] == [True, True, False, True]
    assert [r.x for r in paths.select(names.ignored(F.col("p"), "/app").alias("x")).collect()] == [True, False, False, False]
    cast = spark.createDataFrame([("integer", "1e5"), ("integer", "1d"), ("decimal", " -.5 "), ("date", "soon"), ("date", "2024"), ("string", "x"), (None, "x")], "t string, v string")
    assert [r.x for r in cast.select(names.loses_value(F.col("t"), F.col("v")).alias("x")).collect()] == [False, True, False, True, False, False, False]


def test_uris_and_splits(spark):
    df = spark.createDataFrame([("/a b/c+d~é*.rb",)], "p string")
    coded = df.select(names.percent_encode(F.col("p")).alias("x"))
    assert coded.first().x == "/a%20b/c%2Bd~%C3%A9%2A.rb"
    assert coded.select(names.percent_decode(F.col("x")).alias("p")).first().p == "/a b/c+d~é*.rb"
    assert names.split_top("A, B[C, D], (E, F)") == ["A", "B[C, D]", "(E, F)"] and names.split_top("A[B") is None and names.split_top("A)") is None


def test_gem_accounting(spark):
    locks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], "gem string, version string")
    rbi = spark.createDataFrame([("a", "1-abc"), ("b", "20")], "gem string, version string")
    got = gems.accounting(locks, rbi, spark.createDataFrame([("b",)], "gem string"), spark.createDataFrame([("c", "3", False), ("d", "4", True)], "gem string, version string, native boolean"))
    assert {r.gem: r.status for r in got.collect()} == {"a": "declared", "b": "curated", "c": "installed", "d": "native", "e": "missing"}
    assert tuple(gems.evidence(got).first()) == (False, "d: native")
    chain = spark.createDataFrame([("Kernel",), ("Object",)], "name string")
    added, opened = gems.harvest(spark.createDataFrame([("g.rb", "module Kernel\n  def extra; end\nend\nclass Object\n  some_macro\nend\n")], "path string, text string"), chain)
    assert rows(added) == [("Kernel", "extra")] and rows(opened) == [("Object",)]
    assert rows(gems.hazards(spark.createDataFrame([("x.rb", "class A\n def is_a?(x); end\nend\n"), ("y.rb", "class A; end\n")], "path string, text string"))) == [("x.rb",)]


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    order = [[d[0] for d in want.description].index(c) for c in got.columns]
    a, b = rows(got), sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert len(a) == len(b) and all(same(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))
