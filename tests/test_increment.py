"""Edits: the findings equal those of a whole run, and only dependents are asked again."""

from factloom.plans import shop
from factloom.plans.increment import Incremental
from factloom.plans.program import Program

COLUMNS = ["path", "line", "column", "code", "severity", "message", "suggestion"]
# Files before, by path; one group of files for each way in which an edit can reach another file.
BEFORE = {
    "a1.rb": "class A1\n  def amake\n    1\n  end\n  #: () -> Integer\n  def atold\n    1\n  end\nend\n",
    "a2.rb": "class A2\n  def apass\n    A1.new.amake\n  end\nend\n",
    "a3.rb": "class A3\n  def ause\n    A2.new.apass + 1\n  end\nend\n",
    "a4.rb": "class A4\n  def afirm\n    A1.new.atold + 1\n  end\nend\n",
    "b1.rb": "class Bold\n  def bonly; end\nend\nclass Bnew\nend\n",
    "b2.rb": "class Bthing < Bold\nend\n",
    "b3.rb": "class B3\n  def bmake\n    Bthing.new\n  end\nend\n",
    "b4.rb": "class B4\n  def buse\n    B3.new.bmake.bonly\n  end\nend\n",
    "c1.rb": "module Cmix\n  def clid; end\nend\n",
    "c2.rb": "class Chost\n  include Cmix\n  def cglass; end\nend\n",
    "c3.rb": "class C3\n  def cuse(thing)\n    thing.clid\n    thing.cglass\n  end\nend\n",
    "d1.rb": "class Dbase\n  def drun\n    dmissing\n  end\nend\n",
    "d2.rb": "class Dsub < Dbase\nend\n",
    "e1.rb": "class E1\n  def emake\n    1\n  end\nend\n",
    "e2.rb": "class Ebox\n  def eset\n    @x = E1.new.emake\n  end\nend\n",
    "e3.rb": "class Ebox\n  def eget\n    @x + 1\n  end\nend\n",
    "f1.rb": "module Fspace\n  Ffirst = 1\nend\n",
    "f2.rb": "class F2\n  def fuse\n    Fspace::Ffirst\n    Fother\n  end\nend\n",
    "g1.rb": "class G1\nend\n",
    "g2.rb": "class G2\n  def guse\n    G1.new.gbiuld\n  end\nend\n",
    "h1.rb": "class H1\nend\n",
    "h2.rb": "class H2\n  def huse\n    H1\n  end\nend\n",
    "i1.rb": "class Ilib\n  def icall; end\nend\n",
    "i2.rb": "Ishort = Ilib\n",
    "i3.rb": "class I3\n  def iuse\n    Ishort.new.icall\n  end\nend\n",
    "j1.rb": "class J1\n  def initialize(a)\n  end\nend\n",
    "j2.rb": "class J2\n  def juse\n    J1.new(1)\n  end\nend\n",
    "k1.rb": "class K1\n  def kmake\n    1\n  end\nend\n",
    "k2.rb": "class K2\n  def kuse\n    K1.new.kmake + \"a\"\n  end\nend\n",
}
AFTER = {
    "a1.rb": "# moved\n" + BEFORE["a1.rb"].replace("amake\n    1", 'amake\n    "x"').replace("atold\n    1", "atold\n    2"),
    "b2.rb": "class Bthing < Bnew\nend\n",
    "c2.rb": "class Chost\n  def cglass; end\nend\n",
    "d2.rb": "class Dsub < Dbase\n  has_things :a\nend\n",
    "e1.rb": BEFORE["e1.rb"].replace("1\n  end", '"x"\n  end'),
    "f1.rb": "module Fspace\nend\nclass Fothers\nend\n",
    "g1.rb": "class G1\n  def gbuild; end\nend\n",
    "h1.rb": None,
    "i1.rb": "class Ilib\nend\n",
    "j1.rb": "class J1\n  def initialize(a, b)\n  end\nend\n",
    "m1.rb": "class M1\n  def mrun\n    K1.new.knone\n  end\nend\n",
}
ASKED = {"a1.rb", "a2.rb", "a3.rb", "b2.rb", "b3.rb", "b4.rb", "c2.rb", "c3.rb", "d1.rb", "d2.rb", "e1.rb", "e2.rb", "e3.rb", "f1.rb", "f2.rb", "g1.rb", "g2.rb", "h2.rb", "i1.rb", "i3.rb", "j1.rb", "j2.rb", "m1.rb"}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS).collect())


def test_edits(spark, tmp_path):
    options = {"core_inventory": shop.inventory(spark), "closed_world": True}
    inc = Incremental(spark, f"file:{tmp_path}/tables", **options)
    inc.update(0, frame(spark, BEFORE))
    first = rows(inc.diagnostics(0))
    asked = {r.path for r in inc.update(1, frame(spark, AFTER)).collect()}
    now = {k: v for k, v in {**BEFORE, **AFTER}.items() if v is not None}
    got = rows(inc.diagnostics(1))
    assert got == rows(Program(frame(spark, now), **options).diagnostics)
    assert {r[0] for r in first} != {r[0] for r in got}
    assert {"a3.rb", "b4.rb", "c3.rb", "e3.rb", "f2.rb", "g2.rb", "h2.rb", "i3.rb", "j2.rb", "m1.rb"} <= {r[0] for r in got}
    # A declared result stops a changed body; files of other groups are left alone.
    assert ASKED <= asked and not asked & {"a4.rb", "k1.rb", "k2.rb"}
    delta = inc.counts(1).first()
    assert (delta["read"], delta["files"]) == (10, len(now)) and delta["asked"] == len(asked)


def test_dependents_without_asking(spark, tmp_path, monkeypatch):
    """Which files a batch asks: none but its own for a comment, all for a class of the language, again the same for a repeated batch."""
    inc = Incremental(spark, f"file:{tmp_path}/tables")
    monkeypatch.setattr(Incremental, "program", lambda self, batch, asked: type("P", (), {"diagnostics": spark.createDataFrame([], "path string, code string")}))
    asked = lambda batch, files: {r.path for r in inc.update(batch, frame(spark, files)).collect()}
    some = {k: BEFORE[k] for k in ("a1.rb", "a2.rb", "a3.rb", "k1.rb")}
    assert asked(0, some) == set(some)
    assert asked(1, {"a1.rb": "# a comment\n" + some["a1.rb"]}) == {"a1.rb"}
    assert asked(1, {"a1.rb": "# a comment\n" + some["a1.rb"]}) == {"a1.rb"}
    assert asked(2, {"s.rb": "class String\n  def more; end\nend\n"}) == {*some, "s.rb"}
    assert asked(3, {"s.rb": None}) == set(some)
    assert asked(4, {"a1.rb": AFTER["a1.rb"], "empty.rb": ""}) == {"a1.rb", "a2.rb", "a3.rb", "empty.rb"}
