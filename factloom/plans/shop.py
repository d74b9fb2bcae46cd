"""More program-analysis queries: a second source tree, written from the ``supplier`` table.

Each supplier becomes a file with one class inside a module.  Which mistakes it has depends
on its key, so the SQL states every finding, type and definition without knowing
anything of the analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.plans import navigate, report
from factloom.plans.program import Program
from factloom.plans.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Lines of each file; ``{k}`` is the supplier's key and ``{p}`` the key before it, the rest depends on the key.
TEXT = """module Shop
  class Node{k}{parent}
    LIMIT = {k}
    attr_reader :size
    #: (Integer, ?String) -> String
    def tag(count, name = "x")
      name
    end

    def initialize(size)
      @size = 1
    end

    def self.build(size)
      new(size)
    end

    def run(thing)
      first, second = 1, "z"
      Node{p}.{build}(1)
      {node}{p}.build(2)
      "x".{upcase}
      "x".reverse{reverse}
      first + {plus}
      if thing.is_a?(Node{p})
        thing.{tag}(1)
      end
      Node{p}.build(1).tag({arg})
    end
  end
end
"""
#: Placeholder: divisor of the key, the text where it divides, and where it does not.
FAULTS = {"build": (6, "biuld", "build"), "node": (7, "Noed", "Node"), "upcase": (8, "upcasee", "upcase"), "reverse": (9, "(1)", ""), "plus": (5, '"a"', "2"), "tag": (10, "tagg", "tag"), "arg": (3, '"s"', "1")}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def keyed(spark: SparkSession, sf_dir: str, path: str, text: str, **parts) -> DataFrame:
    """(k, path, text) of the whole table: a template with ``{k}``, ``{p}`` (the key before) and columns for the other parts."""
    k = F.col("s_suppkey")
    parts = {"k": k.cast("string"), "p": F.greatest(k - 1, F.lit(0)).cast("string"), **parts}

    def fill(template: str):
        out = F.lit(template)
        for name, value in parts.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    return read(spark, sf_dir, "supplier").filter(k.isNotNull()).select(k.alias("k"), fill(path).alias("path"), fill(text).alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    parts = {name: F.when(k % n == 0, bad).otherwise(good) for name, (n, bad, good) in FAULTS.items()}
    parent = F.when(k >= 2, F.concat(F.lit(" < Node"), F.floor(k / 2).cast("string"))).otherwise("")
    return keyed(spark, sf_dir, "shop/s{k}.rb", TEXT, parent=parent, **parts).select("path", "text")


def inventory(spark: SparkSession) -> DataFrame:
    """(class, method) of the small built-in table: enough for the calls in the tree."""
    rows = sorted({(c, m) for c, m, *_ in core.core_results() if c in ("String", "Integer")})
    return spark.createDataFrame(rows, "class string, method string")


def program(spark: SparkSession, sf_dir: str) -> Program:
    return Program(sources(spark, sf_dir), core_inventory=inventory(spark), closed_world=True)


_KEYS = """
WITH s AS (SELECT s_suppkey AS k, greatest(s_suppkey - 1, 0) AS p, 'shop/s' || s_suppkey || '.rb' AS path FROM supplier),
"""
_FOUND = _KEYS + """
found AS (
  SELECT path, 20 AS line, length('      Node' || p || '.') + 1 AS "column", 'E0101' AS code, 'error' AS severity, 'undefined method `biuld` for class `Shop::Node' || p || '`' AS message, 'build' AS suggestion FROM s WHERE k % 6 = 0
  UNION ALL SELECT path, 21, 7, 'E0104', 'warning', 'unresolved constant `Noed' || p || '`', NULL FROM s WHERE k % 7 = 0
  UNION ALL SELECT path, 22, 11, 'E0101', 'error', 'undefined method `upcasee` for `String`', 'upcase' FROM s WHERE k % 8 = 0
  UNION ALL SELECT path, 23, 11, 'E0102', 'error', '`reverse` expects 0 arguments, got 1', NULL FROM s WHERE k % 9 = 0
  UNION ALL SELECT path, 24, 13, 'E0108', 'error', '`+` on Integer expects a numeric operand, got String', NULL FROM s WHERE k % 5 = 0
  UNION ALL SELECT path, 26, 15, 'E0101', 'error', 'undefined method `tagg` for `Shop::Node' || p || '`', 'tag' FROM s WHERE k % 10 = 0
  UNION ALL SELECT path, 28, length('      Node' || p || '.build(1).') + 1, 'E0103', 'error', 'argument 1 of `tag` expects Integer, got String', NULL FROM s WHERE k % 3 = 0)
"""


@query(_FOUND + 'SELECT path, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", code, severity, message, suggestion FROM found')
def program_shop_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of mistakes: class methods, constants, core methods and their arity, operands, narrowed values, signatures."""
    return program(spark, sf_dir).diagnostics.select("path", "line", "column", "code", "severity", "message", "suggestion")


@query(_FOUND + """SELECT path || ':' || line || ':' || "column" || ': ' || severity || '[' || code || ']: ' || message AS head, CASE WHEN suggestion IS NOT NULL THEN 'did you mean `' || suggestion || '`?' ELSE '' END AS hint FROM found""")
def program_shop_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each finding as text, and its hint."""
    p = program(spark, sf_dir)
    rows = report.text_lines(p.diagnostics, p.project)
    return rows.select(F.substring_index("text", "\n", 1).alias("head"), F.regexp_extract("text", r"(did you mean `[^`]*`\?)$", 1).alias("hint"))


@query(_FOUND + """SELECT '{"path":"' || path || '","line":' || line || ',"column":' || "column" || ',"code":"' || code || '","severity":"' || severity || '","message":"' || message || '"}' AS value FROM found""")
def program_shop_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_lines(program(spark, sf_dir).diagnostics)


@query(_FOUND + """SELECT path, CAST(line - 1 AS BIGINT) AS line, CAST("column" - 1 AS BIGINT) AS "character", CASE severity WHEN 'error' THEN 1 ELSE 2 END AS severity, code, message FROM found""")
def program_shop_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.editor(program(spark, sf_dir).diagnostics).select("path", "line", "character", "severity", "code", "message")


@query(_KEYS + """
spots AS (SELECT path, 20 AS line, 7 AS "column", 'Class[Shop::Node' || p || ']' AS type FROM s
  UNION ALL SELECT path, 28, length('      Node' || p || '.') + 1, 'Shop::Node' || p FROM s
  UNION ALL SELECT path, 28, length('      Node' || p || '.build(1).') + 1, 'String' FROM s
  UNION ALL SELECT path, 22, 11, CASE WHEN k % 8 = 0 THEN NULL ELSE 'String' END FROM s)
SELECT path, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", type FROM spots
""")
def program_shop_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a constant, of what a class method makes, of a signed method's result, and of a core method's."""
    p = program(spark, sf_dir)
    before = F.regexp_extract("text", r"\n      (Node\d+)\.build\(1\)\.tag", 1)
    spots = F.array(
        F.struct(F.lit(20).alias("line"), F.lit(7).alias("column")),
        *(F.struct(F.lit(line).alias("line"), column.alias("column")) for line, column in ((28, F.length(before) + 8), (28, F.length(before) + 17), (22, F.lit(11)))),
    )
    at = p.sources.select("path", F.explode(spots).alias("x")).select("path", F.col("x.line").cast("long").alias("line"), F.col("x.column").cast("long").alias("column"))
    return navigate.hover(p, at).select("path", "line", "column", "type")


@query(_KEYS + """
spots AS (SELECT path, 20 AS line, 7 AS "column", 'Shop::Node' || p AS name FROM s
  UNION ALL SELECT path, 28, length('      Node' || p || '.') + 1, 'Shop::Node' || p || '#build' FROM s
  UNION ALL SELECT path, 28, length('      Node' || p || '.build(1).') + 1, 'Shop::Node' || p || '#tag' FROM s
  UNION ALL SELECT path, 26, 15, CASE WHEN k % 10 = 0 THEN NULL ELSE 'Shop::Node' || p || '#tag' END FROM s)
SELECT spots.path, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", name, CASE WHEN name IS NOT NULL THEN 'shop/s' || p || '.rb' END AS def_path FROM spots JOIN s ON s.path = spots.path
""")
def program_shop_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a constant, a class method, an instance method, and a method of a narrowed value."""
    p = program(spark, sf_dir)
    before = F.regexp_extract("text", r"\n      (Node\d+)\.build\(1\)\.tag", 1)
    spots = F.array(
        F.struct(F.lit(20).alias("line"), F.lit(7).alias("column")),
        *(F.struct(F.lit(line).alias("line"), column.alias("column")) for line, column in ((28, F.length(before) + 8), (28, F.length(before) + 17), (26, F.lit(15)))),
    )
    at = p.sources.select("path", F.explode(spots).alias("x")).select("path", F.col("x.line").cast("long").alias("line"), F.col("x.column").cast("long").alias("column"))
    return navigate.definition(p, at).select("path", "line", "column", "name", "def_path")


@query(_KEYS + """
tree AS (SELECT k AS root, k AS node FROM s),
up AS (WITH RECURSIVE u(root, node, rank) AS (SELECT k, k, 1 FROM s UNION ALL SELECT root, node // 2, rank + 1 FROM u WHERE node >= 2) SELECT * FROM u)
SELECT 'Shop::Node' || root AS root, 'Shop::Node' || node AS node, CAST(rank AS BIGINT) AS rank FROM up
""")
def program_shop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superclasses of every class, in the order in which class methods are looked up; the module of the tree has itself."""
    return program(spark, sf_dir).chain.filter("root <> 'Shop'")


@query(_KEYS + """
m AS (SELECT * FROM (VALUES ('size', false, '0', '', NULL), ('tag', false, '1..2', 'Integer,String', 'String'), ('initialize', false, '1', '', NULL), ('build', true, '1', '', NULL), ('run', false, '1', '', NULL)) v(name, singleton, arity, params, declared))
SELECT 'Shop::Node' || k AS class_path, name, singleton, arity, params, declared FROM s, m
""")
def program_shop_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method with its arity and what its signature comment declares."""
    from factloom.functions import names

    m = program(spark, sf_dir).table("methods")
    return m.select("class_path", "name", "singleton", names.arity_text(F.col("required"), F.col("optional"), F.col("rest"), F.col("arity_unknown")).alias("arity"), F.array_join("param_types", ",").alias("params"), "declared")


# -- columns, contracts, open classes, declarations ---------------------------
RECORD = """class Item{k} < Record{k}
  def change
    self.count = {count}
    self.made_on = {made}
    label.upcase
  end
end

class Record{k}
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'records/r' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(3 AS BIGINT) AS line, 'E0106' AS code, '`count` is a integer column; "many" is dropped by the cast' AS message FROM s WHERE k % 4 = 0
UNION ALL SELECT path, 4, 'E0106', '`made_on` is a date column; "soon" is dropped by the cast' FROM s WHERE k % 5 = 0
""")
def program_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals that the column of a model's table cannot hold; the columns come from a schema file written from the same table."""
    from factloom.sources import declarations

    k = F.col("s_suppkey")
    text = keyed(spark, sf_dir, "records/r{k}.rb", RECORD, count=F.when(k % 4 == 0, '"many"').otherwise('"12"'), made=F.when(k % 5 == 0, '"soon"').otherwise('"2020-01-01"'))
    schema = keyed(spark, sf_dir, "db{k}/schema.rb", 'create_table "item{k}s" do |t|\n  t.integer "count"\n  t.date "made_on"\n  t.string "label"\nend\n')
    columns = declarations.schema_rb(schema.select("path", "text")).select("table", "column", "type")
    return Program(text.select("path", "text"), schema=columns).diagnostics.select("path", "line", "code", "message")


CONTRACT = """class Deal{k}
  sig { params(count: Integer, name: String).returns(String) }
  def close(count, name)
    {result}
  end

  def run
    Deal{k}.new.close({count}, "a")
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'deals/d' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(3 AS BIGINT) AS line, 'E0109' AS code, 'return of `close` expects String, got Integer' AS message FROM s WHERE k % 3 = 0
UNION ALL SELECT path, 8, 'E0103', 'argument `count` of `close` expects Integer, got String' FROM s WHERE k % 4 = 0
""")
def program_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments and returns against library signatures."""
    k = F.col("s_suppkey")
    text = keyed(spark, sf_dir, "deals/d{k}.rb", CONTRACT, result=F.when(k % 3 == 0, "1").otherwise('"ok"'), count=F.when(k % 4 == 0, '"b"').otherwise("1"))
    return Program(text.select("path", "text")).diagnostics.select("path", "line", "code", "message")


OPEN = """class Origin{k}
  {body}
end

class Part{k} < {parent}
  def run
    Part{k}.new.nothing_known
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'Part' || k AS class_path, CASE k % 5 WHEN 0 THEN 'UnknownClassBodyCall' WHEN 1 THEN 'MethodMissing' WHEN 2 THEN 'Unresolved' WHEN 3 THEN 'ClassBodyBlock' END AS reason,
  CASE k % 5 WHEN 0 THEN 'dsl' WHEN 1 THEN 'missing' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'block' ELSE 'na' END AS bucket,
  CASE WHEN k % 5 = 4 THEN 'not_found' ELSE 'inconclusive' END AS verdict FROM s
""")
def program_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a call is not decided: what opens the receiver's ancestry, and its bucket."""
    k = F.col("s_suppkey")
    body = F.when(k % 5 == 0, "has_things :a").when(k % 5 == 1, "def method_missing(name); end").when(k % 5 == 3, "if ENV\n  end").otherwise("LIMIT = 1")
    parent = F.when(k % 5 == 2, F.concat(F.lit("Nowhere::Origin"), k.cast("string"))).otherwise(F.concat(F.lit("Origin"), k.cast("string")))
    p = Program(keyed(spark, sf_dir, "open/o{k}.rb", OPEN, body=body, parent=parent).select("path", "text"))
    rows = report.blocked(p).filter("name = 'nothing_known'")
    return rows.select("class_path", "reason", "bucket", "verdict")


CALLER = """module App{k}
  class Page < Lib{k}::Base
    def show
      title.upcase
      {call}.size
      {const}
    end
  end

  Short = Lib{k}
  Short::Leaf
end
"""
LIBRARY = """module Lib{k}
  class Root
    LIMIT = T.let(3, Integer)
    def from_root; end
  end

  class Base < Root
    sig { returns(String) }
    def title; end
  end

  class Leaf; end
  Other = Lib{k}::Leaf
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'app/a' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, name, verdict, CAST(tier AS INT) AS tier FROM (
  SELECT path, 'title' AS name, 'inconclusive' AS verdict, 1 AS tier FROM s
  UNION ALL SELECT path, 'upcase', 'core', NULL FROM s
  UNION ALL SELECT path, CASE k % 3 WHEN 0 THEN 'from_root' WHEN 1 THEN 'made_here' ELSE 'nowhere_at_all' END, 'inconclusive', CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END FROM s) t
""")
def program_rbi_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that signature files answer: of an unresolved superclass, of its own ancestors, and generated for the class itself."""
    rows = _with_rbi(spark, sf_dir).sites.filter("name <> 'size'")
    return rows.select("path", "name", "verdict", F.col("declared_tier").alias("tier"))


@query("""
WITH s AS (SELECT s_suppkey AS k, 'app/a' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(6 AS BIGINT) AS line, 'E0104' AS code, 'unresolved constant `Missing' || k || '`' AS message FROM s WHERE k % 4 = 3
""")
def program_rbi_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants that signature files declare, as written, inherited, through an alias of theirs and through one of the project's, are not reported; others are."""
    return _with_rbi(spark, sf_dir).diagnostics.select("path", "line", "code", "message")


def _with_rbi(spark: SparkSession, sf_dir: str) -> Program:
    k = F.col("s_suppkey")
    call = F.when(k % 3 == 0, "from_root").when(k % 3 == 1, "made_here").otherwise("nowhere_at_all")
    const = F.when(k % 4 == 0, F.concat(F.lit("Lib"), k.cast("string"), F.lit("::Root"))).when(k % 4 == 1, F.concat(F.lit("Lib"), k.cast("string"), F.lit("::Base::LIMIT"))).when(k % 4 == 2, F.concat(F.lit("Lib"), k.cast("string"), F.lit("::Other"))).otherwise(F.concat(F.lit("::Missing"), k.cast("string")))
    app = keyed(spark, sf_dir, "app/a{k}.rb", CALLER, call=call, const=const)
    library = keyed(spark, sf_dir, "sorbet/rbi/gems/lib{k}.rbi", LIBRARY)
    made = keyed(spark, sf_dir, "sorbet/rbi/dsl/page{k}.rbi", "class App{k}::Page\n  sig { returns(Integer) }\n  def made_here; end\nend\n")
    return Program(app.select("path", "text"), rbi=library.select("path", "text").unionAll(made.select("path", "text")))


USES = """class Tin{k}
  def lid; end
end

class Jar{k}
  def lid; end
  def glass; end
end

class User{k}
  def open(thing)
    thing.lid
    thing.{second}
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'uses/u' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(12 AS BIGINT) AS line, 'E0107' AS code, '`thing` is used as `.lid`, `.upcase`, but no type defines all of them' AS message FROM s WHERE k % 2 = 0
""")
def program_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locals on which methods are called that no one type answers: only in a closed world."""
    k = F.col("s_suppkey")
    text = keyed(spark, sf_dir, "uses/u{k}.rb", USES, second=F.when(k % 2 == 0, "upcase").otherwise(F.concat(F.lit("glass"))))
    return Program(text.select("path", "text"), core_inventory=inventory(spark), closed_world=True).diagnostics.select("path", "line", "code", "message")


SUPERS = """module Loud{k}
  def say; end
end

class Pet{k}
  def say; end
  def walk; end
end

class Dog{k} < Pet{k}
  {mixin} Loud{k}
  def say; end
  def walk; end
  def sit; end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'Dog' || k AS class_path, 'say' AS name, CASE WHEN k % 2 = 0 THEN 'Loud' || k ELSE 'Pet' || k END AS super_owner FROM s
UNION ALL SELECT 'Dog' || k, 'walk', 'Pet' || k FROM s UNION ALL SELECT 'Dog' || k, 'sit', NULL FROM s
""")
def program_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``super`` goes on to: the next owner after the class itself; a prepended module comes before it."""
    k = F.col("s_suppkey")
    p = Program(keyed(spark, sf_dir, "pets/p{k}.rb", SUPERS, mixin=F.when(k % 2 == 0, "include").otherwise("prepend")).select("path", "text"))
    own = p.methods.filter("class_path like 'Dog%'").select("class_path", "name").distinct()
    return navigate.super_target(p, own)
