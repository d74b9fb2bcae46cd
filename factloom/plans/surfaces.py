"""What declarations outside the project say: constants, methods and ancestors of library signature files (RBI).

The files are read by the extractor that reads the project.  All of this only softens: a
declared constant or method is never reported as missing, and a declared result gives a
type where the project's own look-up is inconclusive.  Declarations of a project's own
generated methods (``dsl``) are asked before those of its libraries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.functions import names as text
from factloom.operators import resolve
from factloom.plans.tables import cut
from factloom.sources import facts as source_facts

#: Which namespaces a core class runs through, by a rule: numbers are numeric and comparable, collections enumerable.
ALWAYS = ("Object", "Kernel", "BasicObject")


def core_chain(core_class: str) -> tuple[str, ...]:
    """The class itself and the namespaces whose methods its values answer."""
    own = ("TrueClass", "FalseClass") if core_class == "bool" else ("NilClass",) if core_class == "nil" else (core_class,)
    more = ("Numeric", "Comparable") if core_class in ("Integer", "Float") else ("Comparable",) if core_class in ("String", "Symbol") else ("Enumerable",) if core_class in ("Array", "Hash") else ()
    return (*own, *more, *ALWAYS)


@dataclass
class Surfaces:
    """``files``: path and text of signature files; paths with a ``dsl`` folder are the project's own."""

    files: DataFrame

    @cached_property
    def facts(self) -> DataFrame:
        return cut(source_facts.facts(self.files), "rbi-facts")

    def table(self, name: str) -> DataFrame:
        return source_facts.table(self.facts, name)

    @cached_property
    def classes(self) -> DataFrame:
        return cut(self.table("fragments").select(F.col("class_path").alias("name")).distinct(), "rbi-classes")

    @cached_property
    def constants(self) -> DataFrame:
        """(name): classes, modules and constants, by their whole path; every declaring file counts."""
        return cut(self.classes.unionAll(self.table("consts").select("name")).distinct(), "rbi-constants")

    @cached_property
    def methods(self) -> DataFrame:
        """(host, name, singleton, result, tier): tier 0 for the project's own generated methods, 1 for libraries."""
        m = self.table("methods")
        tier = F.when(m["path"].rlike("(^|/)dsl/"), 0).otherwise(1)
        rows = m.select(F.col("class_path").alias("host"), "name", "singleton", F.coalesce("declared", "sig_returns").alias("result"), tier.alias("tier"))
        # Files that disagree about a result say nothing about it.
        got = rows.groupBy("host", "name", "singleton", "tier").agg(F.min("result").alias("result"), F.count_distinct(F.coalesce("result", F.lit(""))).alias("n"))
        return cut(got.select("host", "name", "singleton", "tier", F.when(F.col("n") == 1, F.col("result")).alias("result")), "rbi-methods")

    @cached_property
    def open(self) -> DataFrame:
        """(host): classes that a file leaves open; they may answer anything."""
        return self.table("fragments").filter("open_reason is not null").select(F.col("class_path").alias("host")).distinct()

    def _named(self, rows: DataFrame) -> DataFrame:
        """(node, target): the innermost class a name in a signature file may mean."""
        bare = F.regexp_replace("name", "^::", "")
        scopes = F.when(F.col("name").startswith("::"), F.array(F.lit(""))).otherwise(F.concat(F.reverse("nesting"), F.array(F.lit(""))))
        levels = rows.filter("name is not null").select("node", "name", F.posexplode(scopes).alias("rank", "scope"), bare.alias("bare")).withColumn("target", text.join_path(F.col("scope"), F.col("bare")))
        hits = levels.join(self.classes.select(F.col("name").alias("target")), "target").select("node", "name", "rank", "target")
        return resolve.first_by_rank(hits, ["node", "name"], ["rank"]).select("node", "target")

    @cached_property
    def ancestors(self) -> DataFrame:
        """(node, ancestor): over superclasses and mixed-in modules, each class its own as well."""
        parents = self.table("fragments").select(F.col("class_path").alias("node"), F.col("superclass").alias("name"), "nesting")
        mixed = self.table("mixins").filter("kind <> 'extend'").select(F.col("class_path").alias("node"), F.col("target").alias("name"), "nesting")
        edges = self._named(parents.unionAll(mixed).distinct())
        up = resolve.closure(edges.filter("node <> target"), "node", "target").select("node", "ancestor")
        return cut(up.unionAll(self.classes.select("name", F.col("name").alias("ancestor"))).distinct(), "rbi-ancestors")

    @cached_property
    def extended(self) -> DataFrame:
        """(node, target): modules a class extends itself with."""
        return self._named(self.table("mixins").filter("kind = 'extend'").select(F.col("class_path").alias("node"), F.col("target").alias("name"), "nesting").distinct())

    # -- a project's classes ------------------------------------------------
    def hosts(self, program) -> DataFrame:
        """(class_path, host): the declared classes that speak for a class of the project.

        Those of its own ancestry by name, of what its unresolved superclasses and mixins may mean
        in their nesting, and of all that these declare as their ancestors.
        """
        named = program.mro.select(F.col("root").alias("class_path"), F.col("node").alias("name"))
        frag = program.table("fragments").filter("superclass is not null").select(F.col("class_path").alias("node"), F.col("superclass").alias("name"), "nesting")
        mixed = program.table("mixins").filter("kind <> 'extend'").select(F.col("class_path").alias("node"), F.col("target").alias("name"), "nesting")
        outside = self._named(frag.unionAll(mixed).distinct())
        through = program.mro.select(F.col("root").alias("class_path"), "node").join(outside, "node").select("class_path", F.col("target").alias("name"))
        return cut(named.unionAll(through).distinct().join(self.ancestors.withColumnRenamed("node", "name"), "name").select("class_path", F.col("ancestor").alias("host")).distinct(), "rbi-hosts")

    def answers(self, want: DataFrame, hosts: DataFrame) -> DataFrame:
        """(class_path, name, singleton, tier, result) of the wanted calls that a declaration answers: generated methods first."""
        m = self.methods
        of_instances = want.filter("not singleton").join(hosts, "class_path").join(m.filter("not singleton").drop("singleton"), ["host", "name"])
        on_class = want.filter("singleton").join(hosts, "class_path")
        own = on_class.join(m.filter("singleton").drop("singleton"), ["host", "name"])
        modules = self.extended.withColumnRenamed("node", "host").join(self.ancestors.select(F.col("node").alias("target"), F.col("ancestor").alias("module")), "target").select("host", "module").distinct()
        through = on_class.join(modules, "host").drop("host").join(m.filter("not singleton").drop("singleton").withColumnRenamed("host", "module"), ["module", "name"])
        cols = ["class_path", "name", "singleton", "tier", "result"]
        every = of_instances.select(*cols).unionAll(own.select(*cols)).unionAll(through.select(*cols))
        got = every.groupBy("class_path", "name", "singleton", "tier").agg(F.min("result").alias("result"), F.count_distinct(F.coalesce("result", F.lit(""))).alias("n"))
        got = got.withColumn("result", F.when(F.col("n") == 1, F.col("result"))).drop("n")
        return resolve.first_by_rank(got, ["class_path", "name", "singleton"], ["tier"])

    def core_methods(self) -> DataFrame:
        """(class, name): what declarations add to the chain of a core class; a null name where one is open."""
        chain = self.files.sparkSession.createDataFrame([(c, h) for c in core.CORE_TYPES for h in core_chain(c)], "class string, host string")
        reach = chain.join(self.ancestors.select(F.col("node").alias("host"), F.col("ancestor").alias("at")), "host").select("class", F.col("at").alias("host")).distinct()
        said = reach.join(self.methods.filter("not singleton").select("host", "name"), "host").select("class", "name")
        return said.unionAll(reach.join(self.open, "host", "left_semi").select("class", F.lit(None).cast("string"))).distinct()

    def type_tests(self) -> bool:
        """Does any declaration redefine a type test or answer for missing methods?  Then a narrowed value may be anything."""
        return bool(self.table("methods").filter(F.col("name").isin("is_a?", "kind_of?", "instance_of?", "nil?", "===", "method_missing")).limit(1).count())

    def declared_constants(self, refs: DataFrame, aliases: DataFrame, hosts: DataFrame) -> DataFrame:
        """(name, nesting) of the references that a declaration knows, any of these ways:

        as written; in each scope around it; below an alias of the project (``aliases``: name, target) whose
        target is declared; through an alias written in a declaration; inherited by the innermost
        scope from declared ancestors (``hosts``).
        """
        bare = F.regexp_replace("name", "^::", "")
        want = refs.select("name", "nesting").distinct().withColumn("bare", bare)
        scopes = F.when(F.col("name").startswith("::"), F.array(F.lit(""))).otherwise(F.concat("nesting", F.array(F.lit(""))))
        tried = want.select("name", "nesting", F.explode(scopes).alias("scope"), "bare").select("name", "nesting", text.join_path(F.col("scope"), F.col("bare")).alias("path"))
        inner = F.element_at(F.when(F.size("nesting") > 0, F.col("nesting")).otherwise(F.array(F.lit(""))), -1)
        inherited = want.withColumn("class_path", inner).join(hosts, "class_path").select("name", "nesting", F.concat_ws("::", "host", "bare").alias("path"))
        tried = tried.unionAll(inherited).distinct()
        edges = self.table("consts").filter("alias_of is not null").select("name", F.regexp_replace("alias_of", "^::", "").alias("target")).unionAll(aliases.select("name", F.regexp_replace("target", "^::", "").alias("target"))).distinct()
        # Every prefix of a path may be an alias; what it stands for is followed to the end.
        chain = resolve.closure(edges, "name", "target").select(F.col("node").alias("head"), F.col("ancestor").alias("target"))
        parts = F.split("path", "::")
        heads = tried.select("name", "nesting", "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("name", "nesting", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "::").alias("head"), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), "::").alias("tail"))
        through = heads.join(chain, "head").select("name", "nesting", F.when(F.col("tail") == "", F.col("target")).otherwise(F.concat_ws("::", "target", "tail")).alias("path"))
        every = tried.unionAll(through).distinct()
        # A declared class inherits the constants of its declared ancestors.
        space = F.regexp_replace("path", "(^|::)[^:]+$", "")
        below = every.withColumn("space", space).filter("space <> ''").join(self.ancestors.withColumnRenamed("node", "space"), "space").select("name", "nesting", F.concat_ws("::", "ancestor", F.substring_index("path", "::", -1)).alias("path"))
        return every.unionAll(below).join(self.constants.select(F.col("name").alias("path")), "path", "left_semi").select("name", "nesting").distinct()
