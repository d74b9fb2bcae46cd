"""Queries over what collections hold and what signature files of libraries say: source trees written from the whole ``supplier`` table.

Each supplier becomes a class with one method per kind of expression, so that the SQL states the type of
every element, pair and result, and which operands cannot be added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import navigate
from factloom.plans.program import Program
from factloom.plans.shop import keyed
from factloom.sources import library

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Expression and the type of what it answers; ``{k}`` is the supplier's key.
KINDS = [
    ("[{k}].first", "Integer"),
    ('[{k}, "x", {k}].last', "Integer | String"),
    ('[{k}] + ["s"]', "Array[Integer | String]"),
    ("[{k}] << :s", "Array[Integer | Symbol]"),
    ('[{k}].push("s", nil)', "Array[Integer | String | nil]"),
    ("[[{k}]].first", "Array"),
    ("[[{k}]].flatten", "Array"),
    ("[{k}].flatten", "Array[Integer]"),
    ("[{k}, 2].first(1)", "Array[Integer]"),
    ("[Bag{k}].first", "Class[Bag{k}]"),
    ("[Bag{k}.new].last", "Bag{k}"),
    ("{a: {k}}.keys", "Array[Symbol]"),
    ('{a: {k}, "b" => 1.5}.values', "Array[Float | Integer]"),
    ('{a: {k}}.merge({b: "x"})', "Hash[Symbol, Integer | String]"),
    ('{a: {k}}.merge({"b" => nil}, {1 => 2.5})', "Hash[Integer | String | Symbol, Float | Integer | nil]"),
    ("{a: [{k}]}.values", "Array[Array]"),
    ('"a b{k}".split(" ").first', "String"),
    ("[{k}].each { |x| x }", "Array[Integer]"),
    ("[{k}].each", None),
    ("[{k}].map { |x| x }", None),
    ("2 ** {k}", "Integer"),
    ("2 ** -1{k}", None),
    ("{k}.5.round", "Integer"),
    ("{k}.5.round(1)", "Float"),
    ("{k} + 1.5", "Float"),
    ("{k}.clamp(1, 9)", "Integer"),
    ('"{k}".gsub("a")', None),
    ('"{k}".gsub("a", "b")', "String"),
    ("[].first", None),
    ("[{k}, *self].first", None),
]
_HEAD = "class Bag{k}\n"


def _text() -> str:
    made = "".join(f"  def m{n}\n    {e}\n  end\n" for n, (e, _) in enumerate(KINDS))
    used = "".join(f"    self.m{n}\n" for n in range(len(KINDS)))
    return f"{_HEAD}{made}  def use\n{used}  end\nend\n"


def _types() -> str:
    first = 2 + 3 * len(KINDS) + 1
    quote = lambda t: "NULL" if t is None else "'" + t.replace("{k}", "' || k || '") + "'"
    rows = " UNION ALL ".join(f"SELECT 'bags/b' || k || '.rb' AS path, CAST({first + n} AS BIGINT) AS line, {quote(t)} AS type FROM s" for n, (_, t) in enumerate(KINDS))
    return f"WITH s AS (SELECT s_suppkey AS k FROM supplier) {rows}"


@query(_types())
def program_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrays and hashes hold, through literals, element reads, concatenation, merging, flattening and a method's result."""
    files = keyed(spark, sf_dir, "bags/b{k}.rb", _text()).select("path", "text")
    first = 2 + 3 * len(KINDS) + 1
    lines = F.array(*(F.struct(F.lit(first + n).cast("long").alias("line"), F.lit(len(f"    self.m{n}") + 1).cast("long").alias("column")) for n in range(len(KINDS))))
    at = files.select("path", F.explode(lines).alias("x")).select("path", "x.*")
    return navigate.hover(Program(files), at).select("path", "line", "type")


LOCALS = """class Sum{k}
  def run(other)
    list = [{k}, 2]
    {read}
    list.first + "a"
    pairs = {a: {k}}
    pairs.each { |x| x }
    pairs.values.last + {plus}
    @kept = [{k}]
    @kept.first + "a"
    sum = [1.5, {k}].last
    sum + "a"
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'sums/s' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(5 AS BIGINT) AS line, 'E0108' AS code, '`+` on Integer expects a numeric operand, got String' AS message FROM s WHERE k % 4 IN (0, 1)
UNION ALL SELECT path, 8, 'E0108', '`+` on Integer expects a numeric operand, got ' || CASE k % 3 WHEN 0 THEN 'String' ELSE 'nil' END FROM s WHERE k % 3 < 2
""")
def program_element_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands taken out of a collection: proven where every read of its local leaves it alone, unknown where it is changed, handed out or kept by an object."""
    k = F.col("s_suppkey")
    read = F.when(k % 4 == 0, "list.size").when(k % 4 == 1, "list.each { |x| x }").when(k % 4 == 2, 'list << "s"').otherwise("other.call(list)")
    plus = F.when(k % 3 == 0, '"a"').when(k % 3 == 1, "nil").otherwise("1")
    files = keyed(spark, sf_dir, "sums/s{k}.rb", LOCALS, read=read, plus=plus).select("path", "text")
    return Program(files).diagnostics.select("path", "line", "code", "message")


RBS = """# A library of supplier {k}
%a{pure}
module Lib{k}
  interface _Each
    def each: () { (Integer) -> void } -> void
  end

  class Item{k}[T] < ::Base
    include Comparable

    attr_accessor label: String
    def self.make: (?Integer size, *String names, **untyped) -> instance
    def <=>: (untyped other) -> Integer?
    def []=: [K] (Integer | Hash[K, T] at, T value) -> T
    def pick: (Integer) -> String
            | (Integer, ?Array[String]) -> String
            | ({ (Integer) -> T }) -> String
    alias take pick
    def wide: (?) -> void
    class Deep
      def self?.both: (a: Integer, ?b: String) -> ::Integer # keywords
      private def {name}: () { (T) -> void } -> self
    end
  end

  class Gone < StandardError end
end

class String
  def only{k}: (Integer count) -> Integer
  def {name}: (Integer) -> void
end
"""
_METHODS = [
    ("Lib{k}::_Each", "each", False, 0, 0, None),
    ("Lib{k}::Item{k}", "label", False, 0, 0, None),
    ("Lib{k}::Item{k}", "label=", False, 1, 1, None),
    ("Lib{k}::Item{k}", "make", True, 0, None, None),
    ("Lib{k}::Item{k}", "<=>", False, 1, 1, None),
    ("Lib{k}::Item{k}", "[]=", False, 2, 2, None),
    ("Lib{k}::Item{k}", "pick", False, 1, 2, "String"),
    ("Lib{k}::Item{k}", "take", False, 1, 2, "String"),
    ("Lib{k}::Item{k}", "wide", False, 0, None, None),
    ("Lib{k}::Item{k}::Deep", "both", False, 0, 0, "Integer"),
    ("Lib{k}::Item{k}::Deep", "both", True, 0, 0, "Integer"),
    ("Lib{k}::Item{k}::Deep", "{name}", False, 0, 0, None),
    ("String", "only{k}", False, 1, 1, "Integer"),
]


def _said(x) -> str:
    if x is None or isinstance(x, (bool, int)):
        return "NULL" if x is None else str(x)
    return "'" + x.replace("{k}", "' || k || '").replace("{name}", "' || CASE WHEN k % 2 = 0 THEN 'hidden?' ELSE 'walk' END || '") + "'"


@query(
    "WITH s AS (SELECT s_suppkey AS k FROM supplier) "
    + " UNION ALL ".join("SELECT " + ", ".join(f"{_said(x)} AS {c}" for x, c in zip(m, ('"class"', "method", "singleton", "least", "most", "result"), strict=True)) + " FROM s" for m in _METHODS)
    + " UNION ALL SELECT DISTINCT 'String', CASE WHEN k % 2 = 0 THEN 'hidden?' ELSE 'walk' END, false, 1, 1, NULL FROM s"
)
def library_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What signature files declare: nesting, overloads, optional, rest and keyword parameters, aliases, attributes, both kinds of methods."""
    name = F.when(F.col("s_suppkey") % 2 == 0, "hidden?").otherwise("walk")
    return library.methods(keyed(spark, sf_dir, "sig/l{k}.rbs", RBS, name=name).select("path", "text"))


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'Lib' || k AS class_path, 'module' AS kind, NULL AS superclass FROM s UNION ALL SELECT 'Lib' || k || '::_Each', 'interface', NULL FROM s
UNION ALL SELECT 'Lib' || k || '::Item' || k, 'class', 'Base' FROM s UNION ALL SELECT 'Lib' || k || '::Item' || k || '::Deep', 'class', NULL FROM s
UNION ALL SELECT 'Lib' || k || '::Gone', 'class', 'StandardError' FROM s UNION ALL SELECT DISTINCT 'String', 'class', NULL FROM s
""")
def library_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, modules and interfaces of signature files by their whole path, with superclasses."""
    return library.fragments(keyed(spark, sf_dir, "sig/l{k}.rbs", RBS, name=F.lit("walk")).select("path", "text"))


CALLS = """class Use{k}
  def run
    "x".only{k}(1) + "a"
    "x".only{k}(1, 2)
    "x".onlyy{k}(1)
    "x".upcase
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'uses/u' || s_suppkey || '.rb' AS path FROM supplier)
SELECT path, CAST(3 AS BIGINT) AS line, 'E0108' AS code, '`+` on Integer expects a numeric operand, got String' AS message FROM s
UNION ALL SELECT path, 4, 'E0102', '`only' || k || '` expects 1 argument, got 2' FROM s UNION ALL SELECT path, 5, 'E0101', 'undefined method `onlyy' || k || '` for `String`' FROM s
""")
def program_library_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on core values against an inventory that is read from signature files: results, argument counts and missing methods."""
    files = keyed(spark, sf_dir, "uses/u{k}.rb", CALLS).select("path", "text")
    said = library.inventory(keyed(spark, sf_dir, "sig/l{k}.rbs", RBS, name=F.lit("walk")).select("path", "text"))
    return Program(files, closed_world=True, core_inventory=said).diagnostics.select("path", "line", "code", "message")
