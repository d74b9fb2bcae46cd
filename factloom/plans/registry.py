"""Queries over the driver tables: each applies one operator, with the SQL it must equal.

These are the same functions the program-analysis plans use, under test on other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import drift, lattice, resolve, sequence
from factloom.plans import bags, corpus, declared, edits, shop
from factloom.plans.tables import read

QUERIES: dict = corpus.QUERIES | shop.QUERIES | declared.QUERIES | bags.QUERIES | edits.QUERIES
ORACLES: dict[str, str] = corpus.ORACLES | shop.ORACLES | declared.ORACLES | bags.ORACLES | edits.ORACLES
FLAGSHIP = "census_rollup"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def first_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return resolve.first_by_rank(rows, ["o_custkey"], ["o_orderpriority", "o_orderkey"])


@query("""
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'found'
  WHEN c_acctbal < 0 THEN 'inconclusive' ELSE 'not_found' END AS verdict FROM customer
""")
def three_valued_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("open"))
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.three_valued_lookup(probes, facts, ["c_custkey"], "open").drop("open")


_TREE = """
WITH RECURSIVE up(node, ancestor, depth) AS (
  SELECT p_partkey, p_partkey // 2, CAST(1 AS BIGINT) FROM part WHERE p_partkey // 2 >= 1
  UNION ALL SELECT node, ancestor // 2, depth + 1 FROM up WHERE ancestor // 2 >= 1 AND depth < {most})
SELECT node, ancestor, depth FROM up WHERE ancestor IN (SELECT p_partkey FROM part) OR ancestor >= 1
"""


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent")).filter("parent >= 1")


@query(_TREE.format(most=64))
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.closure(_part_edges(spark, sf_dir), "child", "parent").select("node", "ancestor", "depth")


@query(_TREE.format(most=8))
def closure_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.closure(_part_edges(spark, sf_dir), "child", "parent", 8).select("node", "ancestor", "depth")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
  AND (c_nationkey, c_mktsegment) NOT IN (SELECT (s_nationkey, 'BUILDING') FROM supplier)
""")
def suppress_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    buyers = read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    local = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return resolve.suppress(rows, [(orders, ["c_custkey"]), (buyers, ["c_custkey"]), (local, ["c_nationkey", "c_mktsegment"])]).select("c_custkey", "c_name")


@query("""
WITH a AS (SELECT o_custkey k, min(o_orderkey) v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
  b AS (SELECT o_custkey k, min(o_orderkey) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  c AS (SELECT user_id k, min(event_id) v FROM events GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v, c.v) AS answer,
  CASE WHEN a.v IS NOT NULL THEN 'urgent' WHEN b.v IS NOT NULL THEN 'final' WHEN c.v IS NOT NULL THEN 'event' END AS answer_source
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN c ON c.k = c_custkey
""")
def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = read(spark, sf_dir, "orders"), read(spark, sf_dir, "events")
    least = lambda df, key, value: df.groupBy(F.col(key).alias("c_custkey")).agg(F.min(value).alias("v"))
    sources = [("urgent", least(orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderkey"), "v"), ("final", least(orders.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey"), "v"), ("event", least(events, "user_id", "event_id"), "v")]
    return resolve.priority_coalesce(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", sources)


_LINES = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, unnest(a) AS content, unnest(range(len(a))) AS line FROM parts),
lines AS (SELECT doc_id, CAST(line AS BIGINT) AS line, content,
  CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM rows)
"""


@query(_LINES + "SELECT doc_id, line, start_byte, CAST(start_byte + strlen(content) AS BIGINT) AS end_byte FROM lines")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "line", "start_byte", "end_byte")


@query(_LINES + """, points AS (SELECT doc_id, CAST(doc_id * 37 % (strlen(text) + 1) AS BIGINT) AS at FROM documents WHERE text IS NOT NULL)
SELECT p.doc_id, p.at, l.line, p.at - l.start_byte AS byte_column FROM points p JOIN lines l ON l.doc_id = p.doc_id AND p.at BETWEEN l.start_byte AND l.start_byte + strlen(l.content)
""")
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    points = docs.select("doc_id", (F.col("doc_id") * 37 % (F.octet_length("text") + 1)).cast("long").alias("at"))
    return sequence.line_of(points, sequence.lines(docs.select("doc_id", "text"), "doc_id", "text"), "doc_id", "at")


@query(_LINES + """, points AS (SELECT doc_id, CAST(doc_id * 37 % (strlen(text) + 1) AS BIGINT) AS at FROM documents WHERE text IS NOT NULL),
spans AS (SELECT doc_id, 'line ' || line AS name, start_byte AS s, CAST(start_byte + strlen(content) AS BIGINT) AS e FROM lines
  UNION ALL SELECT doc_id, 'text', 0, CAST(strlen(text) AS BIGINT) FROM documents WHERE text IS NOT NULL)
SELECT doc_id, "at", name, s, e FROM (SELECT p.doc_id, p.at, n.name, n.s, n.e, row_number() OVER (PARTITION BY p.doc_id, p.at ORDER BY n.e - n.s, n.s, n.name) AS r
  FROM points p JOIN spans n ON n.doc_id = p.doc_id AND p.at BETWEEN n.s AND n.e) WHERE r = 1
""")
def point_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    points = docs.select("doc_id", (F.col("doc_id") * 37 % (F.octet_length("text") + 1)).cast("long").alias("at"))
    of_lines = sequence.lines(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", F.concat(F.lit("line "), F.col("line").cast("string")).alias("name"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    spans = of_lines.unionAll(docs.select("doc_id", F.lit("text"), F.lit(0).cast("long"), F.octet_length("text").cast("long")))
    return resolve.point_in_span(points, spans, "doc_id", "at", "s", "e", "name")


@query("""
WITH names AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand IS NOT NULL),
near AS (SELECT a.name AS typo, b.name AS other, levenshtein(a.name, b.name) AS d FROM names a JOIN names b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 2)
SELECT n.name AS typo, arg_min(other, (d, other)) AS suggestion, CAST(min(d) AS BIGINT) AS distance FROM names n LEFT JOIN near ON typo = n.name GROUP BY n.name
""")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part").select(F.col("p_brand").alias("typo")).filter("typo is not null").distinct()
    return resolve.suggest(own, own.select(F.col("typo").alias("name")), "typo", "name")


@query("""
SELECT user_id, event_id % 20 AS slot, CASE WHEN bool_or(event_type = 'error') THEN 'untyped' ELSE array_to_string(list_sort(list_distinct(list(event_type))), '|') END AS type FROM events GROUP BY 1, 2
""")
def type_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    atom = F.when(F.col("event_type") == "error", lattice.UNKNOWN).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("slot"), atom.alias("atom"))
    return rows.groupBy("user_id", "slot").agg(F.array_join(lattice.atoms_join(F.col("atom")), "|").alias("type"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'untyped' END AS type FROM orders GROUP BY 1")
def all_equal_or_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(lattice.all_equal_or_unknown(F.col("o_orderstatus")).alias("type"))


@query("""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS all_l_returnflag,
  CAST(grouping(l_linestatus) AS BIGINT) AS all_l_linestatus FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def census_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.census(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])


@query("""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (l_discount = 0) AS BIGINT) AS plain,
  CAST(count(*) FILTER (l_quantity > 45) AS BIGINT) AS large,
  round(coalesce(count(*) FILTER (l_quantity > 45) * 100.0 / nullif(count(*), 0), 0), 6) AS large_pct FROM lineitem GROUP BY 1
""")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("total"), F.count_if(F.col("l_discount") == 0).alias("plain"), F.count_if(F.col("l_quantity") > 45).alias("large"))
    return got.withColumn("large_pct", F.round(lattice.percent(F.col("large"), F.col("total")), 6))


@query("""
WITH wants AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), offers AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
needs AS (SELECT l_orderkey, count(*) AS needs FROM wants GROUP BY 1),
pairs AS (SELECT l_orderkey, l_suppkey, count(*) AS n, FROM wants JOIN offers USING (l_partkey) GROUP BY 1, 2),
hits AS (SELECT l_orderkey, count(*) AS candidates FROM pairs JOIN needs USING (l_orderkey) WHERE n = needs GROUP BY 1)
SELECT l_orderkey, CAST(needs AS BIGINT) AS needs, CAST(needs AS BIGINT) AS answered, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates,
  CASE WHEN needs < 2 THEN 'nothing' WHEN coalesce(candidates, 0) = 0 THEN 'contradiction' WHEN candidates = 1 THEN 'inferred' WHEN candidates <= 4 THEN 'union' ELSE 'nothing' END AS outcome
FROM needs LEFT JOIN hits USING (l_orderkey)
""")
def candidate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return resolve.candidate_intersection(items, items, "l_orderkey", "l_partkey", "l_suppkey")


@query("""
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN NULL ELSE array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') END AS lines FROM lineitem GROUP BY 1
""")
def poisoned_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("bad"))
    got = rows.groupBy("l_orderkey").agg(lattice.poisoned(F.col("l_linenumber"), F.col("bad")).alias("x"))
    return got.select("l_orderkey", F.array_join("x", ",").alias("lines"))


_SNAPSHOTS = """
WITH base AS (SELECT o_orderpriority AS code, CAST(o_custkey % 100 AS BIGINT) AS path, o_orderkey AS line FROM orders WHERE o_orderkey % 11 <> 3),
fresh AS (SELECT o_orderpriority AS code, CAST(o_custkey % 100 AS BIGINT) AS path, o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS line FROM orders WHERE o_orderkey % 13 <> 5)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A baseline and a fresh snapshot: some rows gone, some new, some on another line."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), (F.col("o_custkey") % 100).alias("path"), F.col("o_orderkey").alias("line"))
    moved = F.col("line") + F.when(F.col("line") % 7 == 0, 1).otherwise(0)
    return o.filter("line % 11 <> 3"), o.filter("line % 13 <> 5").withColumn("line", moved)


@query(_SNAPSHOTS + "SELECT *, 'new' AS change FROM (SELECT * FROM fresh EXCEPT SELECT * FROM base) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM base EXCEPT SELECT * FROM fresh)")
def set_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, fresh = _snapshots(spark, sf_dir)
    return drift.set_drift(fresh, baseline)


@query(_SNAPSHOTS + """, b AS (SELECT substr(sha256(code || ':' || path || ':' || line || chr(10)), 1, 16) AS hash FROM base),
f AS (SELECT substr(sha256(code || ':' || path || ':' || line || chr(10)), 1, 16) AS hash FROM fresh)
SELECT *, 'new' AS change FROM (SELECT * FROM f EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM b EXCEPT SELECT * FROM f)
""")
def hash_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(":", "code", F.col("path").cast("string"), F.col("line").cast("string")).alias("text")
    baseline, fresh = (x.select(text) for x in _snapshots(spark, sf_dir))
    return drift.hash_drift(fresh, baseline, "text")


@query(_SNAPSHOTS + """, f AS (SELECT code, path, line, row_number() OVER (PARTITION BY code, path ORDER BY line) AS nth FROM (SELECT * FROM fresh EXCEPT ALL SELECT * FROM base)),
b AS (SELECT code, path, line, row_number() OVER (PARTITION BY code, path ORDER BY line) AS nth FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM fresh))
SELECT coalesce(f.code, b.code) AS code, coalesce(f.path, b.path) AS path, b.line AS from_line, f.line AS to_line,
  CASE WHEN f.line IS NULL THEN 'gone' WHEN b.line IS NULL THEN 'new' ELSE 'moved' END AS change
FROM f FULL JOIN b ON f.code = b.code AND f.path = b.path AND f.nth = b.nth
""")
def drift_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, fresh = _snapshots(spark, sf_dir)
    return drift.attribute(fresh, baseline, ["code", "path"], "line")


@query("""
WITH t AS (SELECT user_id, event_id % 20 AS slot, list_sort(list_distinct(list(event_type))) AS m FROM events GROUP BY 1, 2)
SELECT user_id, slot, CASE WHEN len(m) > 1 AND NOT list_contains(m, 'error') AND list_contains(m, 'view') THEN array_to_string(list_filter(m, lambda x: x <> 'view'), '|') END AS rest FROM t
""")
def strip_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    atom = F.when(F.col("event_type") == "error", lattice.UNKNOWN).otherwise(F.col("event_type"))
    got = read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 20).alias("slot")).agg(F.array_sort(F.collect_set(atom)).alias("m"))
    return got.select("user_id", "slot", F.array_join(lattice.strip(F.col("m"), F.lit("view")), "|").alias("rest"))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS given FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(given AS BIGINT) AS given FROM c JOIN orders ON o_orderkey = l_orderkey
WHERE given < 2 OR (o_orderstatus <> 'O' AND given > 5)
""")
def arity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("given"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", 5).alias("most"))
    return given.join(orders, "o_orderkey").filter(resolve.arity_mismatch(F.col("given"), F.lit(2), F.col("most"))).select("o_orderkey", "given")


@query("""
WITH x AS (SELECT event_id, event_type, regexp_extract(props, '"k": *([^}]*)', 1) || CASE WHEN event_id % 3 = 0 THEN 'd' ELSE '' END AS literal FROM events)
SELECT event_id, literal FROM x WHERE CASE WHEN event_type = 'view' THEN NOT regexp_matches(lower(trim(literal)), '^[+-]?(inf|infinity|nan|([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?)$')
  WHEN event_type = 'click' THEN NOT regexp_matches(literal, '[0-9]') ELSE false END
""")
def cast_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("event_id") % 3 == 0, "d").otherwise("")
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.regexp_extract("props", '"k": *([^}]*)', 1), suffix).alias("literal"))
    kind = F.when(F.col("event_type") == "view", "integer").when(F.col("event_type") == "click", "date").otherwise("string")
    return rows.filter(names.loses_value(kind, F.col("literal"))).select("event_id", "literal")


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS points FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N') AND bool_and(NOT l_quantity < 10)
""")
def all_literal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("points"), F.bool_and(F.col("l_returnflag") == "N").alias("literal"), F.bool_and(~(F.col("l_quantity") < 10)).alias("misfit"))
    return rows.filter("points > 0 and literal and misfit").select("l_orderkey", "points")


@query("""
WITH a AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS argument, unnest(range(len(string_split(p_name, ' ')))) AS ordinal FROM part),
t AS (SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY 1),
p AS (SELECT p_brand, unnest(string_split(p_type, ' ')) AS parameter, unnest(range(len(string_split(p_type, ' ')))) AS ordinal FROM t)
SELECT a.p_partkey, a.p_brand, CAST(a.ordinal AS BIGINT) AS ordinal, a.argument, p.parameter FROM a LEFT JOIN p ON a.p_brand = p.p_brand AND a.ordinal = p.ordinal
""")
def bind_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    calls = part.select("p_partkey", "p_brand", F.split("p_name", " ").alias("args"))
    params = part.groupBy("p_brand").agg(F.min("p_type").alias("t")).select("p_brand", F.split("t", " ").alias("names"))
    return resolve.bind_args(calls, "p_partkey", "args", params, "p_brand", "names")


@query("""
WITH n AS (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS name FROM part),
s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS w FROM n)
SELECT p_partkey, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', 'ies') WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS table_name FROM s
""")
def table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Shop::"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return read(spark, sf_dir, "part").select("p_partkey", names.table_name(name).alias("table_name"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", head.alias("head"))
    return sequence.carry_forward(rows, ["user_id"], ["ts", "event_id"], "head", "section").select("event_id", "user_id", "section")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("""
WITH w AS (SELECT user_id AS u, max(event_id) FILTER (event_type = 'signup') AS last FROM events GROUP BY 1)
SELECT user_id, event_id, event_type FROM events JOIN w ON u = user_id WHERE last IS NULL OR event_id > last
""")
def after_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sequence.after_last(rows, ["user_id"], "event_id", F.col("event_type") == "signup")


@query("""
WITH r AS (SELECT page_id, unnest(string_split(html, chr(10))) AS content, unnest(range(len(string_split(html, chr(10))))) AS line FROM pages)
SELECT page_id, CAST(line AS BIGINT) AS line, regexp_extract(content, '<(h[1-6]|title)[^>]*>', 1) AS tag FROM r WHERE regexp_matches(content, '<(h[1-6]|title)[^>]*>')
""")
def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n", -1)).alias("line", "content"))
    head = "<(h[1-6]|title)[^>]*>"
    return rows.filter(F.col("content").rlike(head)).select("page_id", F.col("line").cast("long").alias("line"), F.regexp_extract("content", head, 1).alias("tag"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)
SELECT page_id, path, regexp_matches('/' || path, '(^|/)a(/|$)') OR regexp_matches('/' || path, '^/page(/|$)') OR regexp_matches('/' || path, '(^|/)1(/|$)') AS ignored FROM p
""")
def path_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    any_entry = F.lit(False)
    for entry in ("a", "/page", "1"):
        any_entry = any_entry | names.ignored(F.col("path"), entry)
    return rows.withColumn("ignored", any_entry)


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 12")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.top(read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", 12)
