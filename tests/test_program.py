"""The program analysis on small projects: what must be reported, and what must stay silent."""

import pytest

from factloom.plans import navigate, report
from factloom.plans.program import Program
from factloom.sources import declarations, project, rbs
from factloom.sources.facts import extract
from factloom.sources.ruby import Malformed, Unsupported, parse

MAIN = '''class Shelf
  #: (Integer) -> String
  def label(number)
    "shelf"
  end

  def self.build(size)
    new
  end
end

class Rack < Shelf
  attr_reader :size

  def initialize(size, color = nil)
    @size = size
  end

  def fill(flag)
    shelf = Shelf.new
    shelf.lable(1)
    Shelf.new.label("x")
    Rack.new
    Rack.new(1).label(1).upcase
    Rakc.new(1)
    helper
    1 + "a"
    Rack.create
    other = flag ? Shelf.new : nil
    other.anything_at_all
    if other.is_a?(Rack)
      other.missing_on_rack
    end
  end
end

module Greeting
  def hello
    "hi" + 1
  end
end

class Hall < Rack
  include Greeting

  def run
    hello
    helo
    Shelf.build
  end
end
'''
SILENT = '''class Rack
  def helper; end
end

class Loose < Nowhere::Base
  def work
    whatever
  end
end

class Ghost
  def method_missing(name, *args); end

  def act
    anything
  end
end

module Mixin
  def self.included(base)
    base.extend(Tools)
  end
end

class Host
  include Mixin

  def act
    injected
  end
end

class Base
  def act
    hook_method
  end
end

class Derived < Base
  def hook_method; end
end

class Guarded
  def act(thing)
    return unless thing.respond_to?(:maybe)
    thing.maybe
    if defined?(Optional::Thing)
      Optional::Thing
    end
  end
end
'''
BROKEN = "class Broken\n  def a(b\n  end\nend\n"


@pytest.fixture(scope="module")
def program(spark):
    rows = [("main.rb", MAIN), ("silent.rb", SILENT), ("broken.rb", BROKEN), ("empty.rb", ""), ("null.rb", None)]
    return Program(spark.createDataFrame(rows, "path string, text string"))


def test_diagnostics(program):
    got = {(r.path, r.line, r.code): (r.message, r.suggestion) for r in program.diagnostics.collect()}
    want = {
        ("main.rb", 21, "E0101"): ("undefined method `lable` for `Shelf`", "label"),
        ("main.rb", 22, "E0103"): ("argument 1 of `label` expects Integer, got String", None),
        ("main.rb", 23, "E0102"): ("`new` expects 1 to 2 arguments, got 0", None),
        ("main.rb", 25, "E0104"): ("unresolved constant `Rakc`", "Rack"),
        ("main.rb", 27, "E0108"): ("`+` on Integer expects a numeric operand, got String", None),
        ("main.rb", 28, "E0101"): ("undefined method `create` for class `Rack`", None),
        ("main.rb", 32, "E0101"): ("undefined method `missing_on_rack` for `Rack`", None),
        ("main.rb", 39, "E0108"): ("`+` on String expects String, got Integer", None),
        ("main.rb", 48, "E0101"): ("undefined method `helo` for `Hall`", "hello"),
        ("main.rb", 49, "E0102"): ("`build` expects 1 argument, got 0", None),
        ("silent.rb", 5, "E0104"): ("unresolved constant `Nowhere::Base`", None),
        ("broken.rb", 2, "E0001"): ("syntax error: expected `)` to close the parameters", None),
    }
    assert got == want


def test_definition_and_hover(spark, program):
    at = spark.createDataFrame([("main.rb", 22, 15), ("main.rb", 20, 13), ("main.rb", 1, 1)], "path string, line long, column long")
    got = {(r.line, r.column): (r.name, r.def_path) for r in navigate.definition(program, at).collect()}
    assert got == {(22, 15): ("Shelf#label", "main.rb"), (20, 13): ("Shelf", "main.rb"), (1, 1): (None, None)}
    types = {(r.line, r.column): r.type for r in navigate.hover(program, at).collect()}
    assert types[22, 15] == "String" and types[20, 13] == "Class[Shelf]"


def test_reports(program):
    lines = [r.text for r in report.text_lines(program.diagnostics, program.project).collect()]
    assert any(x.startswith("main.rb:21:11: error[E0101]: undefined method `lable` for `Shelf`\n        shelf.lable(1)\n              ^^^^^\ndid you mean `label`?") for x in lines)
    assert report.exit_status(program.diagnostics) == 1
    rows = report.census(program).collect()
    whole = next(r.n for r in rows if r.bucket is None)
    assert whole == program.table("calls").count() == sum(r.n for r in rows if r.bucket is not None and r.reason is None)
    assert {r.verdict for r in report.dark(program).collect()} <= {"closed_notfound", "known_tail", "open"}
    assert [r.call for r in report.dark_summary(program).collect()] == ["Rack#create"]


def test_super_target(spark, program):
    rows = spark.createDataFrame([("Hall", "label"), ("Hall", "fill"), ("Shelf", "label")], "class_path string, name string")
    got = {(r.class_path, r.name): r.super_owner for r in navigate.super_target(program, rows).collect()}
    assert got == {("Hall", "label"): "Shelf", ("Hall", "fill"): "Rack", ("Shelf", "label"): None}


def test_order_of_files_does_not_matter(spark, program):
    rows = [("silent.rb", SILENT), ("broken.rb", BROKEN), ("main.rb", MAIN)]
    again = Program(spark.createDataFrame(rows, "path string, text string").repartition(3))
    key = lambda p: sorted((r.path, r.start, r.code, r.message) for r in p.diagnostics.collect())
    assert key(again) == key(program)


def test_ignored_files_and_declarations_silence(spark):
    rows = [("a.rb", "class A\n  def x\n    missing\n    Other::Thing\n    Declared\n  end\nend\n", "project"), ("b.rb", "class A\n  def missing; end\nend\nmodule Other\n class Thing; end\nend\n", "ignored")]
    files = spark.createDataFrame(rows, "path string, text string, role string")
    names = spark.createDataFrame([("Declared",)], "name string")
    assert Program(files, rbi_names=names).diagnostics.count() == 0
    alone = Program(files.filter("role = 'project'")).diagnostics.collect()
    assert sorted(r.code for r in alone) == ["E0101", "E0104", "E0104"]


def test_schema_models(spark):
    files = spark.createDataFrame(
        [
            ("db/schema.rb", 'ActiveRecord::Schema.define do\n  create_table "gadgets" do |t|\n    t.string "title"\n    t.integer "amount"\n    t.index ["title"]\n  end\nend\n'),
            ("db/structure.sql", "CREATE TABLE public.parts (\n  id bigint NOT NULL,\n  code character varying(20) DEFAULT ''::character varying,\n  size integer,\n  CONSTRAINT x CHECK (size > 0)\n);\nCREATE TABLE broken (\n  a integer\n"),
            ("app/gadget.rb", 'class Gadget\n  def act\n    self.amount = "many"\n    self.amount = "12"\n    title.upcase\n    amuont\n  end\nend\n'),
            ("sorbet/rbi/x.rbi", "module Outside\n  class Inner; end\nend\nLIMIT = 3\n"),
            ("Gemfile.lock", "GEM\n  remote: https://example.org/\n  specs:\n    rack (3.0.1)\n      webrick (~> 1.0)\n    sorbet-runtime (0.5)\n\nPLATFORMS\n  ruby\n"),
            ("sorbet/config", "--dir\n.\n--ignore=/skip\n"),
            ("skip/x.rb", "class Skipped; end\n"),
        ],
        "path string, text string",
    )
    got = project.classify(files)
    roles = {r.path: r.role for r in got.collect()}
    assert roles["skip/x.rb"] == "ignored" and roles["app/gadget.rb"] == "project" and roles["db/schema.rb"] == "schema_rb"
    table = lambda df: {(r.table, r.column, r.type) for r in df.collect()}
    assert table(declarations.schema_rb(got.filter("role = 'schema_rb'"))) == {("gadgets", "id", "integer"), ("gadgets", "title", "string"), ("gadgets", "amount", "integer")}
    assert table(declarations.structure_sql(got.filter("role = 'structure_sql'"))) == {("parts", "id", "integer"), ("parts", "code", "string"), ("parts", "size", "integer")}
    assert {(r.name, r.kind) for r in declarations.rbi_headers(got.filter("role = 'rbi'")).collect()} == {("Outside", "class"), ("Inner", "class"), ("LIMIT", "constant")}
    locks = declarations.lock_entries(got.filter("role = 'lock'"))
    assert {(r.gem, r.version) for r in locks.collect()} == {("rack", "3.0.1"), ("sorbet-runtime", "0.5")}
    assert declarations.runtime_locked(locks).first().locked
    found = {(r.line, r.code): (r.message, r.suggestion) for r in project.program(got).diagnostics.collect()}
    assert found == {(3, "E0106"): ('`amount` is a integer column; "many" is dropped by the cast', None), (6, "E0101"): ("undefined method `amuont` for `Gadget`", "amount")}


def test_contradiction_needs_a_closed_world(spark):
    files = spark.createDataFrame([("a.rb", "class P\n  def left; end\nend\nclass Q\n  def right; end\nend\nclass R\n  def go(x)\n    x.left\n    x.right\n  end\nend\n")], "path string, text string")
    core = spark.createDataFrame([("String", "upcase")], "class string, method string")
    assert Program(files).diagnostics.count() == 0
    closed = Program(files, closed_world=True, core_inventory=core)
    assert [(r.code, r.line, r.message) for r in closed.diagnostics.collect()] == [("E0107", 9, "`x` is used as `.left`, `.right`, but no type defines all of them")]
    assert [r.outcome for r in report.candidates(closed).collect()] == ["contradiction"]


@pytest.mark.parametrize("text", ["", "a = [1, 2,\n 3]\n", "x = <<~EOS\n  hi #{1}\nEOS\nputs x\n", "def a = 1\n", "foo.bar { |x, (y, z)| x }\n", "a ? b : c\n", "{a: 1, 'b' => 2, **c}\n", "begin\n 1\nrescue A, B => e\n 2\nensure\n 3\nend\n", "puts %w[a b].map(&:to_s)\n", "x = if a then 1 else 2 end\n", "class << self\n def x; end\nend\n", "a&.b&.c ||= 3\n", "while x do y end\n", "case x\nwhen 1, 2 then 3\nelse 4\nend\n", "foo 1, b: 2 do |z|\n z\nend\n", "->(x) { x }.call(1)\n", "private def a; end\n"])
def test_parser_reads(text):
    parse(text)


@pytest.mark.parametrize("text", ["class A\n def b\n end\n", "def a(b\nend\n", "class A; end; end\n", "foo(1, 2\n", 'x = "abc\n'])
def test_parser_proves_errors(text):
    with pytest.raises(Malformed):
        parse(text)


def test_unsupported_files_are_opaque():
    with pytest.raises(Unsupported):
        parse("x = a ? b : :c ? 1 : 2 => d\n")
    facts = extract("x.rb", "class A\n  def x; y; end\n  v => {a:}\nend\n")
    assert [f["open_reason"] for f in facts["fragments"]] == ["Unparsed"] and not facts["errors"] and not facts["calls"]


@pytest.mark.parametrize(
    "text,params,returns",
    [("(Integer) -> String", ["Integer"], "String"), ("(?Integer x, String?) -> (nil | Foo::Bar)", ["Integer", "String | nil"], "Foo::Bar | nil"), ("[T] (T, Array[String]) { (Integer) -> void } -> void", ["untyped", "Array"], "untyped"), ("-> bool", [], "bool"), ("(a: Integer, *String, **untyped) -> [Integer, String]", [], "untyped"), ("(^(Integer) -> String) -> singleton(Foo)", ["untyped"], "untyped")],
)
def test_signatures(text, params, returns):
    sig = rbs.signature(text)
    assert [rbs.render(t) for _, t in sig.params] == params and rbs.render(sig.returns) == returns


@pytest.mark.parametrize("text", ["(Integer -> String", "() ->", "() -> String junk", "(,) -> x", "Integer"])
def test_bad_signatures(text):
    with pytest.raises(rbs.Invalid):
        rbs.signature(text)


SIGNED = '''class Till
  extend T::Sig

  sig { params(amount: Integer, note: T.nilable(String)).returns(String) }
  def pay(amount, note)
    "paid"
  end

  sig { returns(Integer) }
  def count
    "three"
  end

  sig { returns(T.any(Integer, String)) }
  def fine
    "three"
  end

  sig { returns(Till) }
  def other
    unknown_source.thing
  end

  def act(x)
    pay("ten", nil)
    pay(1, 2)
    other.pey(1, nil)
    kept = x.read #: as Till
    kept.cuont
    T.must(nil)
    T.let(x, Till).act
    loose = x.read #: as untyped
    loose.anything
  end

  def unknown_source
    @source
  end
end
'''


def test_library_signatures_and_casts(spark):
    p = Program(spark.createDataFrame([("till.rb", SIGNED)], "path string, text string"))
    got = sorted((r.line, r.code, r.message) for r in p.diagnostics.collect())
    assert got == [
        (10, "E0109", "return of `count` expects Integer, got String"),
        (25, "E0103", "argument `amount` of `pay` expects Integer, got String"),
        (26, "E0103", "argument `note` of `pay` expects String | nil, got Integer"),
        (27, "E0101", "undefined method `pey` for `Till`"),
        (29, "E0101", "undefined method `cuont` for `Till`"),
        (30, "E0103", "`T.must` raises on a literal `nil`"),
        (31, "E0102", "`act` expects 1 argument, got 0"),
    ]


def test_agent_blocks(spark):
    text = "class Left\n  def one; end\n  def two; end\nend\nclass Right\n  def one; end\nend\nclass User\n  def go(x)\n    x.one\n    x.two\n  end\nend\n"
    p = Program(spark.createDataFrame([("u.rb", text)], "path string, text string"))
    (row,) = report.agent_blocks(p).collect()
    assert row.outcome == "inferred" and row.text == "## `x` in u.rb\n\n- calls: `one`, `two`\n- outcome: inferred\n- types: `Left`\n"


def test_core_arity(spark):
    text = "class Sum\n  def go\n    \"abc\".length(1)\n    [1].join(1, 2)\n    \"abc\".upcase.length\n    1.+(2)\n    :a.nowhere\n    [1].push(1, 2, 3)\n  end\nend\n"
    p = Program(spark.createDataFrame([("s.rb", text)], "path string, text string"))
    assert sorted((r.line, r.message) for r in p.diagnostics.collect()) == [(3, "`length` expects 0 arguments, got 1"), (4, "`join` expects 0 to 1 arguments, got 2")]
    again = Program(spark.createDataFrame([("s.rb", text), ("t.rb", "class String\n  def length(x = 1); end\nend\n")], "path string, text string"))
    assert [r.line for r in again.diagnostics.collect()] == [4]


# -- no bounds ----------------------------------------------------------------
def found(spark, *texts, **options):
    p = Program(spark.createDataFrame([(f"f{i}.rb", t) for i, t in enumerate(texts)], "path string, text string"), **options)
    return p, sorted((r.code, r.message, r.suggestion) for r in p.diagnostics.collect())


def test_long_chains_of_classes_and_methods(spark):
    """Neither the depth of an ancestry nor the length of a chain of calls is bounded."""
    classes = "class A0\n  def ping; end\nend\n" + "".join(f"class A{i} < A{i - 1}; end\n" for i in range(1, 70)) + "class User\n  def run\n    A69.new.ping\n    A69.new.pong\n  end\nend\n"
    p, got = found(spark, classes)
    assert got == [("E0101", "undefined method `pong` for `A69`", "ping")]
    assert p.mro.filter("root = 'A69'").count() == 70
    methods = "class Deep\n" + "".join(f"  def m{i}; m{i + 1}; end\n" for i in range(400)) + '  def m400; "x"; end\n  def run\n    m0.nope\n    m390.nope\n  end\nend\n'
    _, got = found(spark, methods, closed_world=True, core_inventory=spark.createDataFrame([("String", "upcase")], "class string, method string"))
    assert got == [("E0101", "undefined method `nope` for `String`", None)] * 2


def test_cycles_end(spark):
    p, got = found(spark, "class A < B\n  def x; y; end\n  def y; x; end\n  def run; x.anything; nothing; end\nend\nclass B < A; end\nK = L\nL = K\n")
    assert got == []


def test_lookup_order(spark):
    """Prepended modules, the class, included modules (the last first, each with its own), the superclass; a shared ancestor once."""
    text = "module P; end\nmodule Q\n  include P\nend\nmodule R\n  include P\nend\nmodule W; end\nclass Top\n  include P\nend\nclass C < Top\n  include Q\n  include R\n  prepend W\nend\n"
    p = Program(spark.createDataFrame([("a.rb", text)], "path string, text string"))
    got = [r.node for r in p.mro.filter("root = 'C'").orderBy("rank").collect()]
    assert got == ["W", "C", "R", "P", "Q", "Top"]


def test_many_ways_between_classes(spark):
    """Diamonds of modules: a pair of classes is one row however many ways join them."""
    text = "module M0; end\n" + "".join(f"module A{i}\n  include M{i}\nend\nmodule B{i}\n  include M{i}\nend\nmodule M{i + 1}\n  include A{i}\n  include B{i}\nend\n" for i in range(18))
    p = Program(spark.createDataFrame([("a.rb", text)], "path string, text string"))
    assert p.mro.filter("root = 'M18'").count() == 55


# -- core classes, declarations -----------------------------------------------
CORE = [("String", m) for m in ("upcase", "size", "reverse")] + [("Integer", m) for m in ("+", "succ")] + [("NilClass", "to_a")]


def test_core_receivers(spark):
    inventory = spark.createDataFrame(CORE, "class string, method string")
    text = 'class U\n  def run(x)\n    "a".upcasee\n    "a".blank?\n    1.succ\n    if x.is_a?(String)\n      x.rev\n    end\n    [].anything\n  end\nend\n'
    assert found(spark, text)[1] == [] and found(spark, text, closed_world=True)[1] == []
    options = {"closed_world": True, "core_inventory": inventory}
    assert [m for _, m, _ in found(spark, text, **options)[1]] == ["undefined method `blank?` for `String`", "undefined method `rev` for `String`", "undefined method `upcasee` for `String`"]
    # What a library adds, and what the project or a declaration may add, is never missing.
    added = spark.createDataFrame([("Object", "blank?")], "class string, method string")
    assert len(found(spark, text, extensions=added, **options)[1]) == 2
    assert found(spark, text, "class String\n  def other; end\nend\n", **options)[1] == []
    assert found(spark, text, "module Kernel\nend\n", **options)[1] == []
    rbi = spark.createDataFrame([("sorbet/rbi/gems/x.rbi", "class String\n  def rev; end\n  def blank?; end\nend\n")], "path string, text string")
    assert [m for _, m, _ in found(spark, text, rbi=rbi, **options)[1]] == ["undefined method `upcasee` for `String`"]
    hazard = spark.createDataFrame([("sorbet/rbi/gems/x.rbi", "class Odd\n  def is_a?(x); end\nend\n")], "path string, text string")
    assert len(found(spark, text, rbi=hazard, **options)[1]) == 2  # only the literals are what they seem


def test_declared_methods(spark):
    text = "class Page < Lib::Base\n  def run\n    title.nope\n    made.nope\n    absent\n    Page.listing\n    Page.find(1)\n  end\nend\nclass Plain\n  def run\n    made\n  end\nend\n"
    rbi = [("sorbet/rbi/gems/lib.rbi", "module Lib\n  class Root\n    sig { returns(String) }\n    def title; end\n  end\n  module List\n    def listing; end\n  end\n  class Base < Root\n    extend List\n  end\nend\n"), ("sorbet/rbi/dsl/page.rbi", "class Plain\n  def made; end\nend\nclass Page\n  sig { returns(Integer) }\n  def made; end\nend\n")]
    p, got = found(spark, text, rbi=spark.createDataFrame(rbi, "path string, text string"), records=spark.createDataFrame([("find", True)], "method string, singleton boolean"))
    assert got == []
    sites = {(r.class_path, r.name): (r.verdict, r.declared_tier) for r in p.sites.collect() if r.name not in ("nope",)}
    assert sites["Page", "title"] == ("inconclusive", 1) and sites["Page", "made"] == ("inconclusive", 0) and sites["Plain", "made"] == ("inconclusive", 0)
    assert sites["Page", "absent"] == ("inconclusive", None) and sites["Page", "listing"] == ("inconclusive", 1)
    assert {r.recv_type for r in p.sites.filter("name = 'nope'").collect()} == {"String", "Integer"}
    record, _ = found(spark, "class Row < ActiveRecord::Base\n  def run; Row.find(1); end\nend\n", records=spark.createDataFrame([("find", True)], "method string, singleton boolean"))
    assert [r.declared_tier for r in record.sites.filter("name = 'find'").collect()] == [2]


def test_reasons_of_open_classes(spark):
    p, _ = found(spark, "class A\n  macro :x\nend\nclass B < A\n  def run; go; end\nend\nclass C < Nowhere\n  def run; go; end\nend\nclass D\n  def run; go; end\nend\nclass String\n  def run; go; end\nend\n")
    got = {r.class_path: (r.reason, r.bucket) for r in report.blocked(p).filter("name = 'go'").collect()}
    assert got == {"B": ("UnknownClassBodyCall", "dsl"), "C": ("Unresolved", "unresolved"), "D": (None, "na"), "String": ("ReopenedExternal", "other")}
    one = report.totals(p).first()
    assert (one.total, one.blind) == (p.sites.count(), p.sites.filter("verdict in ('inconclusive', 'unknown')").count())


# -- more of the language -----------------------------------------------------
def test_multiple_assignment(spark):
    text = 'class Tool\n  def run(list)\n    a, b = 1, "x"\n    a + "y"\n    b + 1\n    c, (d, *e), @f = list\n    c.zzz\n    first, *rest = 1, 2, 3\n    rest.size(1)\n    g = h = nil\n    x, y = y, x\n  end\nend\n'
    assert [m for _, m, _ in found(spark, text)[1]] == ["`size` expects 0 arguments, got 1", "`+` on Integer expects a numeric operand, got String", "`+` on String expects String, got Integer"]


def test_patterns_make_locals_unknown(spark):
    text = "class Tool\n  def run(x)\n    n = 1\n    case x\n    in {name: String => n, age:} if age.zzz\n      n + 'a'\n    in [Integer, *rest] then rest\n    else\n      Nowhere\n    end\n    n + 'a'\n  end\n\n  def other\n    1 + 'a'\n  end\nend\n"
    assert [c for c, _, _ in found(spark, text)[1]] == ["E0104", "E0108"]


def test_accessor_macros(spark):
    text = "class Tool\n  mattr_accessor :level, default: 1\n  class_attribute :kind\n  delegate :name, to: :owner\n  def owner; end\n  def run\n    level\n    kind?\n    name(1, 2)\n    Tool.level = 2\n    levell\n  end\nend\n"
    assert found(spark, text)[1] == [("E0101", "undefined method `levell` for `Tool`", "level")]


# -- what collections hold -----------------------------------------------------
def elements(spark, lines):
    """The type of each expression, as the last one of a method of its own."""
    text = "class Box\n" + "".join(f"  def m{n}\n    {x}\n  end\n" for n, x in enumerate(lines)) + "end\n"
    p = Program(spark.createDataFrame([("a.rb", text)], "path string, text string"))
    got = p.methods.join(p.types, p.methods.ret == p.types.id, "left").select("name", "type").collect()
    return [next(r.type for r in got if r.name == f"m{n}") for n in range(len(lines))]


def test_elements_of_collections(spark):
    cases = {
        "[1].first": "Integer",
        '[[1, "a"], nil].push({"k" => [2.5]})': "Array[Array[Integer|String]|Hash[String, Array[Float]]|nil]",
        '[[[1]]] + [["s", [nil]]]': "Array[Array[Array[Integer]]|Array[Array[nil]|String]]",
        "[Box, 1].last": "Class[Box] | Integer",
        "[{a: Box}].first": "Hash",
        '{a: 1}.merge({"b" => [1]}, **self)': "untyped",
        "[1].concat([2.5], self)": "Array",
        "[[[1]]].flatten": "Array",
        "[[Box.new]].flatten": "untyped",
        "[{a: 1}].flatten": "Array[Hash[Symbol, Integer]]",
        "[[1], 2].flatten": "untyped",
        "[1].flatten(1)": "Array[Integer]",
        "[[1]].flatten(1)": "untyped",
        "[].push(1)": "Array",
        "[1, *self].first": "untyped",
        "{}": "Hash",
        "{a: self.zzz}.values": "Array",
        "{a: self.zzz}.keys": "Array[Symbol]",
        "[1, 2].min(self)": "untyped",
        "[3, 1].sort.reverse.uniq": "Array[Integer]",
        "[3].sort_by { |x| x }": "Array[Integer]",
        '"a".chars { |x| x }': "untyped",
        "7.clamp(1, 2.5)": "untyped",
        "2.0 ** 0.5": "untyped",
        "2.0 ** 2": "Float",
        "2.5.floor(-1)": "Integer",
        "2.5.ceil(self)": "untyped",
    }
    assert dict(zip(cases, elements(spark, list(cases)), strict=True)) == cases


def test_changed_collections_hold_unknown_things(spark):
    body = ['list = [1]; list << "s"; list.first + "a"', 'list = [1]; list.first + "a"', 'list = [1]; m9(list); list.first + "a"', 'a = [1]; b = a; a.first + "a"', 'a = [1]; a.each { |x| x }; a.last + "a"', 'a = [1]; eval("x"); a.last + "a"', '@a ||= [1]; @a.first + "a"', 'a = [[1]]; a.first.first + "a"', 'a = [1]; a[0] = "s"; a.first + "a"', 'a = [1]; if a.empty? then 1 else a.last + "b" end', 'a, b = [1], 2; a.first + "a"']
    text = "class Box\n" + "".join(f"  def m{n}(z = 1)\n    {x}\n  end\n" for n, x in enumerate(body)) + "end\n"
    p = Program(spark.createDataFrame([("a.rb", text)], "path string, text string"))
    assert sorted((r.line - 3) // 3 for r in p.diagnostics.collect()) == [1, 4, 9, 10]


def test_members_of_a_union_are_told_by_class_alone(spark):
    text = "class Box\n  def run(flag)\n    a = flag ? [1] : 2\n    if a.is_a?(Array)\n      1\n    else\n      a + 'x'\n    end\n    x = x\n  end\nend\n"
    assert found(spark, text)[1] == [("E0108", "`+` on Integer expects a numeric operand, got String", None)]


def test_long_chains_of_declared_classes(spark):
    chain = "class Top\n  def deep; end\nend\n" + "".join(f"class C{n} < {'Top' if n == 0 else f'C{n - 1}'}\nend\n" for n in range(120)) + "".join(f"A{n} = {'C119' if n == 0 else f'A{n - 1}'}\n" for n in range(120))
    rbi = spark.createDataFrame([("gems/chain.rbi", chain)], "path string, text string")
    p, got = found(spark, "class Own < C119\n  def run; deep; A119::LIMIT; end\nend\n", rbi=rbi)
    assert p.surfaces.ancestors.filter("node = 'C119'").count() == 121
    assert {r.name: r.declared_tier for r in p.sites.collect()}["deep"] == 1 and [c for c, _, _ in got if c == "E0101"] == []


# -- signature files of libraries -----------------------------------------------
def test_signature_files_as_relations(spark):
    from factloom.sources import library

    text = """
class Outer
  class Inner end
  Alias = Inner
  class Copy = Inner
  def a: (Integer, ?String, *Symbol, k: Integer) -> (Integer | String)
  def b: () -> Array[Integer] | (String) -> Array[String]
  def c: (^(Integer, String) -> void cb, [Integer, { a: Integer }]) { (Integer) -> void } -> bool
  def d: (Integer -> String
  def `e!`: -> nil
  def +: (::Outer::Inner) -> ::Outer
  def f: ...
       | (Integer) -> String
  alias self.g self.h
  attr_writer self.w: Integer
  module ::Top
    def t: () -> self
  end
end
"""
    files = spark.createDataFrame([("a.rbs", text), ("b.rbs", "class Outer\n  def b: (Integer, Integer, Integer) -> Array[Integer]\nend\n"), ("c.rbs", None), ("d.rbs", "")], "path string, text string")
    got = {(r["class"], r.method, r.singleton): (r.least, r.most, r.result) for r in library.methods(files).collect()}
    assert got == {
        ("Outer", "a", False): (1, None, None),
        ("Outer", "b", False): (0, 3, "Array"),
        ("Outer", "c", False): (2, 2, None),
        ("Outer", "d", False): (None, None, None),
        ("Outer", "e!", False): (0, 0, "nil"),
        ("Outer", "+", False): (1, 1, "Outer"),
        ("Outer", "f", False): (1, 1, "String"),
        ("Outer", "g", True): (None, None, None),
        ("Outer", "w=", True): (1, 1, None),
        ("Top", "t", False): (0, 0, "self"),
    }
    assert {tuple(r) for r in library.fragments(files).collect()} == {("Outer", "class", None), ("Outer::Inner", "class", None), ("Top", "module", None)}
    assert library.methods(files.limit(0)).count() == 0


def test_command_line_reads_signature_folders(spark, tmp_path, capsys):
    from factloom import cli

    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "string.rbs").write_text("class String\n  def upcase: () -> String\n  def only: (Integer) -> Integer\nend\n")
    (tmp_path / "gems" / "lib").mkdir(parents=True)
    (tmp_path / "gems" / "lib" / "lib.rbs").write_text("module Lib\n  class Part\n  end\nend\nclass String\n  def added: () -> void\nend\n")
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "a.rb").write_text("class A\n  def run\n    Lib::Part\n    Lib::Gone\n    'x'.added\n    'x'.addedd\n    'x'.only(1, 2)\n  end\nend\n")
    status = cli.main(["check", str(tmp_path / "app"), "--format", "json", "--closed-world", "--core-inventory", str(tmp_path / "core"), "--collection", str(tmp_path / "gems")])
    out = capsys.readouterr().out
    assert status == 1 and [code in out for code in ("undefined method `addedd`", "`only` expects 1 argument, got 2", "Lib::Gone")] == [True] * 3
    assert "`added`" not in out and "Lib::Part" not in out
