"""Command line: ``python -m factloom.cli check ROOT``, ``definition`` and ``hover ROOT PATH:LINE:COLUMN``.

``check`` prints text, JSON lines, Markdown for agents (what the calls on untyped locals prove) or the
census of calls on class objects (``dark``).  ``--core-inventory`` and ``--extensions`` name files of
``Class#method`` lines or folders of ``.rbs`` signature files: what core classes answer, and what libraries add to
them.  ``--collection`` names a folder of the signatures of a project's libraries: their constants are known, and what
they add to core classes is an extension.  The
world is closed only where told, or where every locked gem is accounted for (``--gems``: a folder of
installed gems as ``name-version``, next to the project's signature files); what the sources of locked gems
add or open is then known, and gems that the lock does not name are not read.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import navigate, report
from factloom.sources import declarations, gems, library, project


def location(arg: str) -> tuple[str, int, int] | None:
    m = re.fullmatch(r"(.+):(\d+):(\d+)", arg)
    return (m[1], int(m[2]), int(m[3])) if m and int(m[2]) and int(m[3]) else None


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the ``.rbs`` files in a folder, at any depth."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rbs")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(class, method) of a file of ``Class#method`` lines (comments and other lines are left out), with arity and result from a folder of ``.rbs`` files."""
    files = signatures(spark, path)
    if files.limit(1).count():
        return library.inventory(files)
    line = r"^([A-Z][A-Za-z0-9_:]*)#(\S+)$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("class"), F.regexp_extract("value", line, 2).alias("method"))


GEM = r"^([^/]+)-(\d[^-/]*)[^/]*/"


def locked_folders(spark: SparkSession, locks: DataFrame, folder: str) -> list[tuple[str, str]]:
    """(folder, gem) of the installed gems that the lock names, with any platform after the version; no other is read."""
    out = []
    for r in locks.select("gem", "version").distinct().orderBy("gem", "version").collect():  # the lines of one lock file
        out += [(d, r.gem) for d in project.folders(spark, folder, f"{r.gem}-{r.version}")]
    return out


def gem_sources(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Sources of the locked gems as files that are read and never checked; the signature runtime is not among them."""
    locks = declarations.lock_entries(files.filter("role = 'lock'").select("path", "text"))
    paths = [d for d, gem in locked_folders(spark, locks, folder) if not gem.startswith("sorbet")]
    if not paths:
        return files.limit(0)
    rows = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rb")
    rest = F.substring(project.plain(F.col("_metadata.file_path")), len(project.plain_text(spark, folder)) + 2, 1 << 30)
    return rows.select(F.concat(F.lit("gem:"), rest).alias("path"), F.col("value").alias("text"), F.lit("ignored").alias("role"))


def evidence(spark: SparkSession, files: DataFrame, gem_folder: str | None) -> tuple[bool, str]:
    """Is every locked gem accounted for, and what says so?  Without a lock nothing is known, so the world stays open."""
    locks = declarations.lock_entries(files.filter("role = 'lock'").select("path", "text"))
    if not locks.limit(1).count():
        return False, "no lock"
    shape = r"(?:^|/)sorbet/rbi/gems/(.+)@([^@/]+)\.rbi$"
    rbi = files.filter(F.col("path").rlike(shape)).select(F.regexp_extract("path", shape, 1).alias("gem"), F.regexp_extract("path", shape, 2).alias("version"))
    installed = spark.createDataFrame([], "gem string, version string, native boolean")
    if gem_folder:
        paths = [d for d, _ in locked_folders(spark, locks, gem_folder)]
        if paths:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(project.plain(F.col("path")).alias("path"))
            of = found.withColumn("path", F.expr(f"substring(path, {len(project.plain_text(spark, gem_folder)) + 2})"))
            native = F.col("path").rlike(r"(/ext/.*extconf\.rb|\.(so|bundle|c))$")
            installed = of.select(F.regexp_extract("path", GEM, 1).alias("gem"), F.regexp_extract("path", GEM, 2).alias("version"), native.alias("native"))
    if not declarations.runtime_locked(locks).first()[0]:
        return False, "the signature runtime is not locked"
    row = gems.evidence(gems.accounting(locks, rbi, spark.createDataFrame([], "gem string"), installed)).first()
    return bool(row.closed), row.reason or "every locked gem is accounted for"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    parser.add_argument("command", choices=["check", "definition", "hover"])
    parser.add_argument("root")
    parser.add_argument("at", nargs="?")
    parser.add_argument("--format", choices=["text", "json", "agent", "dark"], default="text")
    parser.add_argument("--ignore", action="append", default=[])
    parser.add_argument("--stats", action="store_true")
    parser.add_argument("--closed-world", action="store_true")
    parser.add_argument("--core-inventory")
    parser.add_argument("--extensions")
    parser.add_argument("--collection")
    parser.add_argument("--gems")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        files = project.load(spark, args.root, args.ignore)
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 2
    closed, why = (True, "as told") if args.closed_world else evidence(spark, files, args.gems)
    if args.gems:
        files = files.unionByName(gem_sources(spark, files, args.gems))
    hazards = gems.hazards(files.filter("role in ('ignored', 'rbi', 'unloaded')").select("path", "text"))
    if closed and not args.closed_world and hazards.limit(1).count():
        closed, why = False, "a file that is not checked redefines type tests"
    options = {"closed_world": closed}
    if args.core_inventory:
        options["core_inventory"] = inventory(spark, args.core_inventory)
    if args.extensions:
        options["extensions"] = inventory(spark, args.extensions).select("class", "method")
    if args.collection:
        files_ = signatures(spark, args.collection)
        more = library.inventory(files_).select("class", "method")
        options["extensions"] = options["extensions"].unionAll(more) if args.extensions else more
        options["rbi_names"] = library.fragments(files_).select(F.col("class_path").alias("name")).distinct()
    program = project.program(files, **options)
    if args.command != "check":
        where = location(args.at or "")
        if not where:
            print("expected PATH:LINE:COLUMN", file=sys.stderr)
            return 2
        at = spark.createDataFrame([where], "path string, line long, column long")
        rows = (navigate.definition if args.command == "definition" else navigate.hover)(program, at).collect()
        print(rows[0].asDict() if rows else "nothing known")
        return 0
    found = program.diagnostics
    if args.format == "json":
        rows = report.json_lines(found)
    elif args.format == "agent":
        rows = report.agent_blocks(program).orderBy("path", "start").select("text")
    elif args.format == "dark":
        rows = report.dark_lines(program)
    else:
        rows = report.text_lines(found, program.project).orderBy("path", "start", "code").select("text")
    for r in rows.toLocalIterator():
        print(r[0])
    if args.stats:
        print(f"world: {'closed' if closed else 'open'} ({why})")
        report.census(program).orderBy("bucket", "reason").show(200, truncate=False)
        report.blocked(program).filter("verdict = 'inconclusive'").groupBy("bucket").count().orderBy("bucket").show(20, truncate=False)
        report.totals(program).show(truncate=False)
    return report.exit_status(found)


if __name__ == "__main__":
    sys.exit(main())
