"""Loading a tree: ignore files, the nearest declarations, names that Spark's readers leave out."""

from factloom.sources import project


def tree(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text or "# empty files are not read\n")


def roles(spark, root, ignore=None):
    return {r.path: r.role for r in project.load(spark, str(root), ignore).collect()}


FILES = {
    ".gitignore": "/gen/\n*.tmp.rb\n!keep.tmp.rb\n", "app/.gitignore": "local.rb\n", "app/a.rb": "A = 1\n", "app/local.rb": "", "gen/x.rb": "", "gen/deep/y.rb": "",
    "b.tmp.rb": "", "keep.tmp.rb": "", "app/_part.rb": "P = 'é'\n", "_lib/in.rb": "", "_lib/_more/q.rb": "", ".hidden/h.rb": "", "notes.txt": "",
    "db/schema.rb": "", "engine/db/schema.rb": "", "engine/Gemfile.lock": "", "Gemfile.lock": "",
}


def test_load(spark, tmp_path):
    tree(tmp_path, FILES | {".git/info/exclude": "_more\n"})
    want = {
        "app/a.rb": "project", "app/local.rb": "unloaded", "gen/x.rb": "unloaded", "gen/deep/y.rb": "unloaded", "b.tmp.rb": "unloaded", "keep.tmp.rb": "project", "app/_part.rb": "project",
        "_lib/in.rb": "project", "_lib/_more/q.rb": "unloaded", "db/schema.rb": "schema_rb", "engine/db/schema.rb": "project", "Gemfile.lock": "lock",
    }
    assert roles(spark, tmp_path) == want
    assert roles(spark, tmp_path, ["/app"]) == want | {"app/a.rb": "ignored", "app/_part.rb": "ignored"}
    texts = {r.path: r.text for r in project.load(spark, str(tmp_path)).collect()}
    assert texts["app/_part.rb"] == "P = 'é'\n" and texts["app/a.rb"] == "A = 1\n"


def test_without_a_repository_git_rules_do_not_count(spark, tmp_path):
    tree(tmp_path, FILES | {"app/.ignore": "a.rb\n"})
    got = roles(spark, tmp_path)
    assert got["gen/x.rb"] == "project" and got["app/local.rb"] == "project" and got["app/a.rb"] == "unloaded"


def test_below_a_repository(spark, tmp_path):
    """Rules and declarations above the root count, up to four directories for declarations; the nearest wins."""
    tree(tmp_path, {".git/x": "", ".gitignore": "/one/app/gone.rb\n", "one/app/gone.rb": "", "one/app/a.rb": "", "db/schema.rb": "far", "one/db/schema.rb": "near", "sorbet/rbi/deep/x.rbi": "", "sorbet/rbi/readme.txt": ""})
    assert roles(spark, tmp_path / "one" / "app") == {"a.rb": "project", "gone.rb": "unloaded", "../db/schema.rb": "schema_rb", "../../sorbet/rbi/deep/x.rbi": "rbi"}
    assert [r.text for r in project.load(spark, str(tmp_path / "one" / "app")).filter("role = 'schema_rb'").collect()] == ["near"]
    tree(tmp_path, {"one/2/3/4/5/a.rb": ""})
    assert roles(spark, tmp_path / "one/2/3/4/5") == {"a.rb": "project"}


def test_gem_sources_of_the_lock(spark, tmp_path, capsys):
    """Core classes that a locked gem touches are silent; those that only gems outside the lock touch are not."""
    from factloom import cli

    lock = "GEM\n  remote: https://example.org/\n  specs:\n    more (1.2)\n    sorbet-runtime (0.5)\n\nPLATFORMS\n  ruby\n"
    tree(tmp_path / "app", {"a.rb": "class A\n  def run\n    'x'.added\n    5.other\n    More::Part\n  end\nend\n", "Gemfile.lock": lock})
    tree(tmp_path / "gems", {"more-1.2-java/lib/more.rb": "module More\n  class Part\n  end\nend\nclass String\n  def added; end\nend\n", "sorbet-runtime-0.5/lib/t.rb": "module T\nend\n", "other-2.0/lib/o.rb": "class Integer\n  def other; end\nend\n", "more-1.20/lib/bad.rb": "class Integer\n  def other; end\nend\n"})
    (tmp_path / "core").write_text("String#upcase\nInteger#abs\n")
    status = cli.main(["check", str(tmp_path / "app"), "--format", "json", "--stats", "--core-inventory", str(tmp_path / "core"), "--gems", str(tmp_path / "gems")])
    out = capsys.readouterr().out
    assert "world: closed (every locked gem is accounted for)" in out
    assert status == 1 and "`other`" in out and "`added`" not in out and "More::Part" not in out
