"""Re-analysis by edits: a batch of changed files asks only the files that depend on what changed.

Every batch writes, for the files it changes, their texts, facts and three narrow tables:

* ``defs`` (path, name, class_path, kind, digest): what a file defines.  The digest covers all
  that another file can see: not positions, and not what stands around the definition.
* ``mentions`` (path, name): every name whose meaning may decide a finding of the file.
* ``edges`` (path, src, dst): a change of ``src`` may change what ``dst`` means to others.  A method
  follows what its body mentions; one with a declared result only the classes it names.

Names are ``c:`` (last part of a class or constant), ``m:`` (method), ``v:`` (variable of a class) and
``f:`` (file: what variables a file writes follows all that it mentions).  The changed definitions,
and what the edges reach from them, are the dirty names; files that mention one are asked again.  The
same edges, walked the other way from the files asked, say whose expressions their types need; of all
other files only the definitions take part.  The tables of classes and ancestry are derived anew, by
joins over those definitions; reading, types, calls and findings are by dependents.

A change that could reach any file (of a class of the language or a library, of calls that define
names anywhere, of a class while a schema gives its columns) asks every file.  A batch that is run
again writes the same tables, and a later batch of a path supersedes the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.plans.program import Program
from factloom.plans.tables import cut, drop, reader
from factloom.sources import facts as source_facts

#: What only findings of the file itself read, and what types read.
FINDINGS = ("calls", "const_refs", "errors")
VALUES = ("exprs", "ivars")
#: Codes whose hint may name anything that is defined, so a new or lost name asks their files again.
HINTED = ("E0101", "E0104")


def _last(path) -> F.Column:
    return F.concat(F.lit("c:"), F.regexp_extract(path, r"([^:]*)$", 1))


def _parts(names) -> F.Column:
    """``c:`` names of every part of every member of a type or constant."""
    found = F.regexp_extract_all(names, F.lit(r"([A-Z]\w*)"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.concat(F.lit("c:"), x))


def _digest(*columns) -> F.Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def definitions(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, kind, name, class_path, digest) of classes, constants, methods, variables and what counts anywhere."""
    of = lambda name: source_facts.table(facts, name)
    mixed = of("mixins").groupBy("path", "class_path").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "target", "nesting"))).alias("mixed"))
    mixed = mixed.select("path", "class_path", F.transform("mixed", lambda x: F.struct(x.kind, x.target, x.nesting)).alias("mixed"))
    classes = of("fragments").groupBy("path", "class_path").agg(F.array_sort(F.collect_list(F.struct("kind", "superclass", "nesting", "open_reason"))).alias("own")).join(mixed, ["path", "class_path"], "full")
    classes = classes.select("path", F.lit("class").alias("kind"), _last(F.col("class_path")).alias("name"), "class_path", _digest("own", "mixed").alias("digest"))
    consts = of("consts").select("path", F.lit("const").alias("kind"), _last(F.col("name")).alias("name"), F.col("name").alias("class_path"), _digest("alias_of", "nesting").alias("digest"))
    body = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    m = of("methods").join(sources.select("path", "text"), "path")
    seen = ["singleton", "required", "optional", "rest", "arity_unknown", "abstract", "params", "param_types", "declared", "nesting", "sig_types", "sig_returns"]
    methods = m.select("path", F.lit("method").alias("kind"), F.concat(F.lit("m:"), "name").alias("name"), "class_path", _digest(*seen, F.when(F.col("declared").isNull(), body).alias("body")).alias("digest"))
    # What a variable holds follows the whole file.
    ivars = of("ivars").join(sources.select("path", F.sha2("text", 256).alias("digest")), "path").select("path", F.lit("variable").alias("kind"), F.concat(F.lit("v:"), "class_path", "name").alias("name"), "class_path", "digest").distinct()
    anywhere = of("anywhere").select("path", F.lit("anywhere").alias("kind"), "name", F.lit(None).cast("string").alias("class_path"), _digest("kind", "name", "nesting").alias("digest"))
    return classes.unionByName(consts).unionByName(methods).unionByName(ivars).unionByName(anywhere)


def spots(facts: DataFrame) -> DataFrame:
    """(path, name, start): what each file mentions and where; 0 where the place is the file."""
    of = lambda name: source_facts.table(facts, name)
    called = F.concat(F.lit("m:"), "name").alias("name")
    e, m, none = of("exprs"), of("methods"), F.lit(0).cast("long")
    parts = [
        of("calls").select("path", called, "start"),
        e.filter("op = 'call'").select("path", called, "start"),
        e.filter("op = 'ivar'").select("path", F.concat(F.lit("v:"), "name").alias("name"), "start"),
        e.filter("op in ('const', 'declared', 'atom', 'self')").select("path", F.explode(_parts(F.col("name"))).alias("name"), "start"),
        of("const_refs").select("path", F.explode(_parts(F.col("name"))).alias("name"), "start"),
        m.select("path", F.explode(_parts(F.concat_ws(" ", "declared", "sig_returns", F.concat_ws(" ", "param_types"), F.concat_ws(" ", "sig_types"), F.concat_ws(" ", "nesting")))).alias("name"), "start"),
        of("fragments").select("path", F.explode(_parts(F.concat_ws(" ", "class_path", "superclass"))).alias("name"), none.alias("start")),
        of("mixins").select("path", F.explode(_parts(F.concat_ws(" ", "class_path", "target"))).alias("name"), none.alias("start")),
        of("consts").select("path", F.explode(_parts(F.concat_ws(" ", "name", "alias_of"))).alias("name"), none.alias("start")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.filter("name is not null").distinct()


def dependencies(facts: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(path, src, dst): a change of ``src`` may change what ``dst`` means."""
    of = lambda name: source_facts.table(facts, name)
    m = of("methods").select("path", F.concat(F.lit("m:"), "name").alias("dst"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("declared").isNotNull().alias("told"))
    inside = (F.col("start") == 0) | F.col("start").between(F.col("from"), F.col("to"))
    follows = mentioned.join(m, "path").filter(inside & (~F.col("told") | F.col("name").startswith("c:"))).select("path", F.col("name").alias("src"), "dst")
    file = F.concat(F.lit("f:"), "path")
    written = of("ivars").select("path", F.concat(F.lit("v:"), "class_path", "name").alias("dst")).distinct()
    reads = mentioned.join(written.select("path"), "path", "left_semi").select("path", F.col("name").alias("src"), file.alias("dst"))
    kin = of("fragments").filter("superclass is not null").select("path", _last(F.col("superclass")).alias("src"), _last(F.col("class_path")).alias("dst"))
    kin = kin.unionByName(of("mixins").filter("target is not null").select("path", _last(F.col("target")).alias("src"), _last(F.col("class_path")).alias("dst")))
    kin = kin.unionByName(of("consts").filter("alias_of is not null").select("path", _last(F.col("alias_of")).alias("src"), _last(F.col("name")).alias("dst")))
    return follows.unionByName(reads).unionByName(written.select("path", file.alias("src"), "dst")).unionByName(kin).filter("src <> dst").distinct()


def reach(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): the seed and all that the edges (src, dst) lead to from it; each round follows only what is new."""
    known = cut(seed.select("name").distinct(), "reached")
    new = known
    while True:
        step = new.join(edges, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct()
        new = cut(step.join(known, "name", "left_anti"), "reached-new")
        if not new.limit(1).count():
            drop(new)
            return known
        known = known.unionByName(new)


class Incremental:
    """A project whose files change by batches; ``options`` are those of :class:`Program`.

    Batches are numbered; the first one is the whole project.  ``folder`` is in the shared file system.  A path is in a batch
    at most once; a null text means the file is gone.  All files are the project's own: there are no ignored ones.
    """

    def __init__(self, spark: SparkSession, folder: str, **options):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options

    # -- tables by batch --------------------------------------------------
    def _write(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return reader(self.spark, path).schema(rows.schema).parquet(path)

    def _upto(self, name: str, batch: int) -> DataFrame:
        """Rows of all batches up to this one, with the batch; a batch is named, so one run before a failure is not read."""
        parts = [path for b in range(batch + 1) if self._there(path := f"{self.folder}/{name}/batch={b}")]
        return reader(self.spark, self.folder).option("basePath", f"{self.folder}/{name}").parquet(*parts)

    def _there(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _current(self, name: str, batch: int, by: str = "sources") -> DataFrame:
        """Rows of each path as its last batch left them."""
        last = self._upto(by, batch).groupBy("path").agg(F.max("batch").alias("batch"))
        return self._upto(name, batch).join(last, ["path", "batch"]).drop("batch")

    def sources(self, batch: int) -> DataFrame:
        return self._current("sources", batch).filter("text is not null")

    def diagnostics(self, batch: int) -> DataFrame:
        """Every finding of the project as it is after the batch."""
        return self._current("found", batch, "asked").join(self.sources(batch).select("path"), "path", "left_semi")

    # -- one batch --------------------------------------------------------
    def update(self, batch: int, changes: DataFrame) -> DataFrame:
        """Take in (path, text) and ask the dependents again: their paths."""
        texts = self._write("sources", batch, changes.select("path", "text"))
        facts = self._write("facts", batch, source_facts.facts(texts.filter("text is not null")))
        new = self._write("defs", batch, definitions(facts, texts))
        placed = cut(spots(facts), "spots")
        mentions = self._write("mentions", batch, placed.select("path", "name").distinct())
        edges = self._write("edges", batch, dependencies(facts, placed))
        drop(placed)
        if not any(self._there(f"{self.folder}/asked/batch={b}") for b in range(batch)):
            asked = texts.filter("text is not null").select("path")
        else:
            gone = texts.select("path")
            old = self._current("defs", batch - 1).join(gone, "path", "left_semi")
            old_edges = self._current("edges", batch - 1).join(gone, "path", "left_semi")
            asked = self._dependents(batch, texts, old, new, old_edges.unionByName(edges), mentions)
        asked = self._write("asked", batch, asked.select("path").distinct())
        program = self.program(batch, asked)
        self._write("found", batch, program.diagnostics.join(asked, "path", "left_semi"))
        return asked

    def _dependents(self, batch: int, texts: DataFrame, old: DataFrame, new: DataFrame, own_edges: DataFrame, own_mentions: DataFrame) -> DataFrame:
        keys = ["path", "kind", "name", "class_path", "digest"]
        safe = lambda df: df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in keys))
        delta = cut(safe(old).exceptAll(safe(new)).unionByName(safe(new).exceptAll(safe(old))), "delta")
        live = self.sources(batch).select("path")
        roots = (*core.CORE_CONSTANTS, *core.LIBRARY_CONSTANTS, *core.ROOTS, *core.CORE_TYPES, "Object", "Kernel", "BasicObject", "Comparable", "Enumerable", "Numeric")
        outside = F.substring_index("class_path", "::", 1).isin(*roots) | (F.col("class_path") == "")
        wide = (F.col("kind") == "anywhere") | (F.col("kind").isin("class", "method", "const") & outside)
        if self.options.get("schema") is not None:
            wide = wide | (F.col("kind") == "class")
        if delta.filter(wide).limit(1).count():
            return live
        edges = self._current("edges", batch).unionByName(own_edges).select("src", "dst").distinct()
        # Who makes a new object names its class somewhere, so a constructor counts as its class; ``new`` alone would reach every file.
        made = delta.filter("name = 'm:initialize'").select(_last(F.col("class_path")).alias("name"))
        dirty = reach(delta.filter("kind <> 'anywhere'").select("name").unionByName(made), edges)
        named = dirty
        defs = self._current("defs", batch).unionByName(old)
        touched = texts.select("path")
        if delta.filter("kind in ('class', 'const')").limit(1).count():
            # What is above a changed class answers calls on itself by what is below; what any kin defines may now have other providers.
            up = edges.filter("src like 'c:%' and dst like 'c:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            kin = reach(dirty.filter("name like 'c:%'"), up)
            touched = touched.unionByName(defs.filter("kind = 'class'").join(kin, "name", "left_semi").select("path"))
            members = defs.filter("kind = 'method'").withColumn("of", _last(F.col("class_path"))).join(kin.withColumnRenamed("name", "of"), "of", "left_semi").select("name")
            named = named.unionByName(members).distinct()
        mentions = self._current("mentions", batch)
        touched = touched.unionByName(mentions.join(named, "name", "left_semi").select("path"))
        sides = lambda df: df.filter("kind in ('class', 'const', 'method')").select("kind", "name", "class_path").distinct()
        if sides(old).exceptAll(sides(new)).unionByName(sides(new).exceptAll(sides(old))).limit(1).count():
            hinted = self._current("found", batch - 1, "asked").filter(F.col("code").isin(*HINTED))
            touched = touched.unionByName(hinted.select("path"))
        return touched.distinct().join(live, "path", "left_semi")

    def needed(self, batch: int, asked: DataFrame) -> DataFrame:
        """(path): files whose expressions the types of the files asked need."""
        back = self._current("edges", batch).filter("not (dst like 'c:%')").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        seed = self._current("mentions", batch).join(asked, "path", "left_semi")
        names = reach(seed, back)
        defs = self._current("defs", batch).filter("kind in ('method', 'variable')")
        return defs.join(names, "name", "left_semi").select("path").distinct()

    def program(self, batch: int, asked: DataFrame) -> Program:
        """A program that tells all about the files asked; of others it has what those need."""
        sources, asked = self.sources(batch), asked.select("path").distinct()
        values = asked.unionByName(self.needed(batch, asked)).distinct()
        facts = self._current("facts", batch)
        facts = facts.join(asked.withColumn("__asked", F.lit(True)), "path", "left").join(values.withColumn("__values", F.lit(True)), "path", "left")
        kinds = dict(facts.dtypes)
        kept = [F.when(F.col(flag), F.col(c)).otherwise(F.array().cast(kinds[c])).alias(c) for flag, cs in (("__asked", FINDINGS), ("__values", VALUES)) for c in cs]
        rest = [c for c in source_facts.SCHEMA.names if c not in (*FINDINGS, *VALUES)]
        out = Program(sources, **self.options)
        out.facts = cut(facts.select(*rest, *kept).select(*source_facts.SCHEMA.names), "facts")
        return out

    def counts(self, batch: int) -> DataFrame:
        """One row: files read, asked, needed for types, and there, in a batch."""
        asked = reader(self.spark, self.folder).parquet(f"{self.folder}/asked/batch={batch}")
        n = lambda df, name: df.agg(F.count("*").alias(name))
        read = reader(self.spark, self.folder).parquet(f"{self.folder}/sources/batch={batch}")
        parts = [n(read.filter("text is not null"), "read"), n(asked, "asked"), n(self.needed(batch, asked).join(asked, "path", "left_anti"), "needed"), n(self.sources(batch), "files")]
        out = parts[0].withColumn("one", F.lit(1))
        for p in parts[1:]:
            out = out.join(p.withColumn("one", F.lit(1)), "one")
        return out.drop("one")
