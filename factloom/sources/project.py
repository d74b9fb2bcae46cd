"""Load a source tree through Spark's readers and give each file its role."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import ignores
from factloom.plans.tables import cut
from factloom.sources import declarations

# Folders that hold no project code.
SKIPPED = ("vendor", "node_modules", "tmp", ".git", ".bundle")
ROLES = {"schema_rb": r"(^|/)db/schema\.rb$", "structure_sql": r"(^|/)db/structure\.sql$", "rbi": r"(^|/)sorbet/rbi/.*\.rbi$", "lock": r"(^|/)Gemfile\.lock$", "config": r"(^|/)sorbet/config$"}
DECLARATIONS = {"schema_rb": "db/schema.rb", "structure_sql": "db/structure.sql", "rbi": "sorbet/rbi", "lock": "Gemfile.lock"}
UPWARD = 4


def _hadoop(spark: SparkSession, name: str):
    """The file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    fs, path = _hadoop(spark, name)
    return fs.exists(path)


def _text(spark: SparkSession, name: str) -> str:
    """A small configuration file."""
    fs, path = _hadoop(spark, name)
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def plain(path):
    """A column of file names without scheme and host, as Spark's readers give them."""
    return F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?(?=/)", "")


def plain_text(spark: SparkSession, name: str) -> str:
    """A directory's full name without scheme and host."""
    fs, path = _hadoop(spark, name)
    return fs.makeQualified(path).toUri().getPath().rstrip("/")


def folders(spark: SparkSession, above_: str, name: str) -> list[str]:
    """Directories of that name, or of that name and a platform after a dash."""
    fs, path = _hadoop(spark, above_)
    found = [fs.makeQualified(_hadoop(spark, f"{above_}/{name}")[1])]
    out = [p.toString() for p in found if fs.exists(p)]
    return out + [s.getPath().toString() for s in fs.globStatus(_hadoop(spark, f"{above_}/{name}-*")[1]) or [] if s.isDirectory()]


def verify_root(spark: SparkSession, root: str) -> None:
    """A missing root is an error before anything is planned."""
    if not _exists(spark, root):
        raise FileNotFoundError(root)


def above(spark: SparkSession, root: str) -> list[str]:
    """The root and the directories above it, nearest first."""
    fs, path = _hadoop(spark, root)
    path, out = fs.makeQualified(path), []
    while path is not None:
        out.append(path.toString().rstrip("/"))
        path = path.getParent()
    return out


def nearest(spark: SparkSession, root: str, name: str) -> int | None:
    """How many directories above the root the nearest ``name`` is; none within ``UPWARD`` directories is null."""
    return next((k for k, d in enumerate(above(spark, root)[:UPWARD]) if _exists(spark, f"{d}/{name}")), None)


def _levels(spark: SparkSession, root: str, last: str):
    """What matches ``last`` in the root and in the directories of each level below it, hidden ones too: (name, is a directory)."""
    fs, start = _hadoop(spark, root)
    base, at = fs.makeQualified(start).toString().rstrip("/"), ""
    while True:
        for s in fs.globStatus(_hadoop(spark, f"{base}{at}/{last}")[1]) or []:
            yield s.getPath().toString(), s.isDirectory()
        at += "/*"
        if not len(fs.globStatus(_hadoop(spark, base + at)[1]) or []):
            return


def rule_files(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """(path, text) of the ignore files at, above and below the root, and the root as those paths see it.

    Paths start at the repository, or at the top of all where there is none; then only ``.ignore`` files count.
    These few small files are read on the driver, as Spark's readers leave out names that start with a dot.
    """
    up = above(spark, root)
    depth = next((k for k, d in enumerate(up) if _exists(spark, f"{d}/.git")), None)
    names = (".gitignore", ".ignore") if depth is not None else (".ignore",)
    top = up[len(up) - 1 if depth is None else depth]
    found = [f"{d}/{n}" for d in up[1 : up.index(top) + 1] for n in names if _exists(spark, f"{d}/{n}")]
    found += [f for f, folder in _levels(spark, root, "{" + ",".join(names) + "}") if not folder]
    rows = [(f[len(top) + 1 :], _text(spark, f)) for f in found]
    if depth is not None and _exists(spark, f"{top}/.git/info/exclude"):
        rows.append(("exclude", _text(spark, f"{top}/.git/info/exclude")))
    return spark.createDataFrame(rows, "path string, text string"), up[0][len(top) + 1 :]


def _unseen(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Directories and Ruby files whose names start with ``_``: Spark's readers take them for hidden."""
    found = list(_levels(spark, root, "_*"))
    return [f for f, folder in found if folder], [f for f, folder in found if not folder and f.endswith(".rb")]


def _read_batches(batches):
    """Texts of files by name, read where the names are."""
    from pyarrow import fs

    for batch in batches:
        contents = []
        for name in batch["path"]:
            system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
            with system.open_input_stream(path) as stream:
                contents.append(stream.read())
        yield batch.assign(content=contents)


def _read(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a directory; names that start with a dot stay hidden."""
    folders, files = _unseen(spark, root)
    read = lambda d: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select("path", "content")
    out = read([root, *folders])
    if files:
        names_ = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files) // 64, 1024)))
        out = out.unionAll(names_.mapInPandas(_read_batches, "path string, content binary"))
    return out


def load(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, text, role): Ruby sources are ``project`` or ``ignored``; declarations have their own roles.

    Files that the ignore files exclude are ``unloaded``: not checked, and no evidence but for what they redefine.
    Of declarations only the nearest count, at the root or in the directories above it; those further
    below belong to other projects.
    """
    verify_root(spark, root)
    up = above(spark, root)
    rel = lambda d: F.expr(f"substring(path, {len(plain_text(spark, d)) + 2})")
    texts = lambda df, d, prefix: df.withColumn("path", plain(F.col("path"))).select(F.concat(F.lit(prefix), rel(d)).alias("path"), F.decode("content", "UTF-8").alias("text"))
    raw = texts(_read(spark, up[0]), up[0], "").withColumn("outer", F.lit(None).cast("string"))
    steps = {role: nearest(spark, root, name) for role, name in DECLARATIONS.items()}
    for role, k in steps.items():
        if k:
            more = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{up[k]}/{DECLARATIONS[role]}")
            raw = raw.unionByName(texts(more.select("path", "content"), up[k], "../" * k).withColumn("outer", F.lit(role)))
    # Texts are read once; every later step reads the columns and roles it needs from this table.
    raw = cut(raw.filter(F.col("path").rlike("|".join([r"\.rb$", *ROLES.values()]))), "tree")
    files = classify(raw, ignore)
    for role, k in steps.items():
        own = F.col("path").startswith(DECLARATIONS[role]) if k == 0 else F.coalesce(F.col("outer") == role, F.lit(False))
        other = F.when(F.col("path").rlike(r"\.rb$"), "project")
        files = files.withColumn("role", F.when((F.col("role") == role) & ~own, other).otherwise(F.col("role")))
    rows, prefix = rule_files(spark, root)
    shown = F.concat(F.lit(prefix + "/" if prefix else ""), F.col("path"))
    asked = files.filter("role in ('project', 'ignored')").select(shown.alias("path"))
    gone = cut(ignores.excluded(asked, ignores.rules(rows)), "excluded").select(F.substring("path", len(prefix) + 2 if prefix else 1, 1 << 30).alias("path"), F.lit(True).alias("gone"))
    role = F.when(F.col("gone") & F.col("role").isin("project", "ignored"), "unloaded").otherwise(F.col("role"))
    return files.filter("role is not null").join(gone, "path", "left").select("path", "text", role.alias("role"))


def classify(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Roles of (path, text) rows; the configuration's own ignore entries count as well."""
    entries = list(ignore or [])
    for r in files.filter(F.col("path").rlike(ROLES["config"])).select("text").collect():  # one file of a project
        entries += declarations.ignore_entries(r.text or "")
    out = F.lit(False)
    for e in [*entries, *SKIPPED]:
        out = out | names.ignored(F.col("path"), e)
    role = F.when(F.col("path").rlike(r"\.rb$") & ~F.col("path").rlike(ROLES["schema_rb"]), F.when(out, "ignored").otherwise("project"))
    for name, shape in ROLES.items():
        role = F.when(F.col("path").rlike(shape), name).otherwise(role)
    return files.withColumn("role", role).filter("role is not null")


def program(files: DataFrame, **options):
    """A :class:`factloom.plans.program.Program` over classified files: the nearest schema wins over a dump."""
    from factloom.plans.program import Program

    of = lambda role: files.filter(F.col("role") == role)
    schema = declarations.schema_rb(of("schema_rb"))
    dump = declarations.structure_sql(of("structure_sql"))
    columns = schema.unionByName(dump.join(schema.select("table").distinct(), "table", "left_anti")).select("table", "column", "type")
    headers = declarations.rbi_headers(of("rbi")).filter("name <> ''").select("name").distinct()
    if of("rbi").limit(1).count():
        options.setdefault("rbi", of("rbi").select("path", "text"))
    more = options.pop("rbi_names", None)
    headers = headers if more is None else headers.unionAll(more).distinct()
    return Program(files.filter("role in ('project', 'ignored')"), rbi_names=headers, schema=columns, **options)
