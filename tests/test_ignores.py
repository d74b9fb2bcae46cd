"""Ordered ignore rules against git itself."""

import random
import shutil
import subprocess

import pytest

from factloom.operators import ignores


def excluded(spark, paths, rule_files):
    given = spark.createDataFrame(list(rule_files.items()) or [("x", None)], "path string, text string")
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in ignores.excluded(rows, ignores.rules(given)).collect()}


def by_git(tmp_path, paths, rule_files):
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, text=True, **k)
    run("init", "-q")
    for p, text in rule_files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    out = run("-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "-z", "--others", "--exclude-standard").stdout
    return set(paths) - set(out.split("\0"))


PATHS = ["a.rb", "b.tmp", "lib/a.rb", "lib/x/a.rb", "lib/x/keep.rb", "lib/x/y/z.rb", "build/a.rb", "lib/build/a.rb", "old1.rb", "old12.rb", "doc/cache/q.rb", "doc/cache", "a b.rb", "end ", "#h.rb", "!n.rb", "w[1].rb", "lib/x/B.rb", "lib/x/5.rb", "lib/x/-.rb", "star*.rb", "é.rb", "lib/x.rb/in.rb"]
PATHS.remove("doc/cache")
RULES = [
    "*.tmp\n", "/build/\n", "build/\n", "lib/x\n!lib/x/keep.rb\n", "lib/x/*\n!lib/x/keep.rb\n", "old?.rb\n", "**/cache/**\n", "doc/**/q.rb\n", "lib/**/z.rb\n", "/**\n!/lib/\n", "**\n",
    "a b.rb  \n", "end\\ \n", "# c\n\\#h.rb\n", "\\!n.rb\n", "w\\[1\\].rb\n", "w[[]1[]].rb\n", "[A-C].rb\n", "[!A-C].rb\n", "[^0-9].rb\n", "[[:digit:]].rb\n", "[[:alpha:]-].rb\n", "[z-a].rb\n", "[]a].rb\n", "[a\n", "[]\n", "[!].rb\n", "[!]].rb\n", "a\\\n",
    "star\\*.rb\n", "é.*\n", "?.rb\r\n", "*\n!*/\n!*.rb\n", "a.rb\n!a.rb\na.rb\n", "!a.rb\n", "*.rb/\n", "lib/\n!lib/\n", "lib/*/a.rb\n", "**/x/a.rb\n", "x/a.rb\n", "/*.rb\n", "/\n\n \n", "lib//a.rb\n", "***.rb\n",
]


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_rules_against_git(spark, tmp_path):
    """Each list of rules in a directory of its own, all judged by one job."""
    paths, files, want = [], {}, set()
    for k, text in enumerate(RULES):
        (tmp_path / str(k)).mkdir()
        want |= {f"{k}/{p}" for p in by_git(tmp_path / str(k), PATHS, {".gitignore": text})}
        paths += [f"{k}/{p}" for p in PATHS]
        files[f"{k}/.gitignore"] = text
    assert excluded(spark, paths, files) == want


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_nested_rules_against_git(spark, tmp_path):
    """Random rules at every level: deeper files decide over those above, excluded directories stay so."""
    pick = random.Random(5)
    names = ["a", "b", "ab", "c.rb", "a.rb"]
    pieces = ["a", "b", "*", "a*", "?", "*.rb", "[ab]", "c.rb", "**", "a/b", "b/*", "/a", "/b/c.rb", "**/a", "a/**", "a/**/b"]
    paths, files, want = [], {}, set()
    for k in range(40):
        mine = sorted({"/".join([*pick.choices(names[:3], k=pick.randint(0, 3)), pick.choice(names[3:])]) for _ in range(25)})
        at = {"", *("/".join(p.split("/")[:j]) for p in mine for j in range(1, p.count("/") + 1))}
        own = {f"{d}/.gitignore".lstrip("/"): "\n".join(pick.choice(["", "", "!"]) + pick.choice(pieces) + pick.choice(["", "", "/"]) for _ in range(pick.randint(1, 4))) for d in pick.sample(sorted(at), min(len(at), 3))}
        (tmp_path / str(k)).mkdir()
        want |= {f"{k}/{p}" for p in by_git(tmp_path / str(k), mine, own)}
        paths += [f"{k}/{p}" for p in mine]
        files |= {f"{k}/{p}": t for p, t in own.items()}
    assert want and excluded(spark, paths, files) == want


def test_ignore_files_decide_over_git_files(spark):
    files = {".ignore": "!a.rb\nb.rb\n", "lib/.gitignore": "a.rb\n!b.rb\n", "other.txt": "*\n"}
    assert excluded(spark, ["lib/a.rb", "lib/b.rb", "c.rb", "", None, "c.rb"], files) == {"lib/b.rb"}


def test_no_rules(spark):
    assert excluded(spark, ["a.rb"], {}) == set() and excluded(spark, [], {".gitignore": "*\n"}) == set()
    assert excluded(spark, ["a.rb"], {".gitignore": "x" * 100_000 + "\n"}) == set()
