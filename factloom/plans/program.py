"""Whole-program analysis as queries over fact tables.

sources -> facts (one pass per file) -> classes, constants, ancestry, method look-up
(joins) -> types (a bounded fixpoint over symbolic expressions) -> diagnostics.

What cannot be proven stays unknown, and the unknown is never reported: look-ups
answer found, not found or inconclusive, and only "not found" in a complete and
closed ancestry is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import core
from factloom.functions import names as text
from factloom.operators import resolve, terms
from factloom.plans.tables import FEW, Log, cut, drop, small, together
from factloom.sources import facts as source_facts

UNTYPED = terms.UNTYPED


@dataclass
class Program:
    """One project: ``sources`` has path, text and, optionally, role (``project`` or ``ignored``).

    ``rbi_names`` (name) are constants other declarations prove; ``schema`` (table,
    column, type) adds columns to models; ``core_inventory`` (class, method) lists what
    core classes answer and is needed to accuse a call on one, which only a closed
    world allows, and may have their arity and result too (least, most, result); ``extensions`` (class, method) are what libraries add to them.  ``rbi``
    (path, text) are signature files; ``records`` (method, singleton) is what every class
    declared below ``ActiveRecord::Base`` answers.
    """

    sources: DataFrame
    rbi_names: DataFrame | None = None
    schema: DataFrame | None = None
    core_inventory: DataFrame | None = None
    closed_world: bool = False
    extensions: DataFrame | None = None
    rbi: DataFrame | None = None
    records: DataFrame | None = None
    _cache: dict = field(default_factory=dict)

    @cached_property
    def spark(self) -> SparkSession:
        return self.sources.sparkSession

    @cached_property
    def facts(self) -> DataFrame:
        return cut(source_facts.facts(self.project), "facts")

    @cached_property
    def project(self) -> DataFrame:
        return self.sources.filter("role = 'project'") if "role" in self.sources.columns else self.sources

    @cached_property
    def evidence(self) -> DataFrame | None:
        """Facts of ignored files: they only ever silence."""
        return cut(source_facts.facts(self.sources.filter("role = 'ignored'")), "evidence") if "role" in self.sources.columns else None

    def table(self, name: str) -> DataFrame:
        return source_facts.table(self.facts, name)

    # -- classes and constants --------------------------------------------
    @cached_property
    def classes(self) -> DataFrame:
        """(class_path, is_module, open): a class reopened in an ignored file is open."""
        frag = self.table("fragments")
        rows = frag.select("class_path", (F.col("kind") == "module").alias("m"), F.col("open_reason").isNotNull().alias("o"))
        if self.evidence is not None:
            own = frag.select("class_path").distinct()
            rows = rows.unionAll(source_facts.table(self.evidence, "fragments").join(own, "class_path", "left_semi").select("class_path", (F.col("kind") == "module").alias("m"), F.lit(True).alias("o")))
        got = rows.groupBy("class_path").agg(F.bool_and("m").alias("is_module"), F.bool_or("o").alias("open"), F.count_distinct("m").alias("kinds"))
        # Reopening what the language or its library defines says nothing about all that it has.
        outside = F.substring_index("class_path", "::", 1).isin(*core.CORE_CONSTANTS, *core.LIBRARY_CONSTANTS)
        return cut(got.withColumn("open", F.col("open") | (F.col("kinds") > 1) | outside).drop("kinds"), "classes")

    @cached_property
    def anywhere(self) -> DataFrame:
        return cut(self.table("anywhere").distinct(), "anywhere")

    @cached_property
    def known(self) -> DataFrame:
        """(name, source): every constant the project defines."""
        return self.classes.select(F.col("class_path").alias("name")).unionAll(self.table("consts").select("name")).distinct()

    @cached_property
    def resolved(self) -> DataFrame:
        """(name, nesting, target) of every name the program refers to: innermost scope first, then the top level; ``::X`` from the root only."""
        members = lambda c: F.explode(F.split(c, " \\| "))
        m, e, refs = self.table("methods"), self.table("exprs"), self.table("const_refs")
        spots = [
            self.table("fragments").select(F.col("superclass").alias("name"), "nesting"),
            self.table("mixins").select("target", "nesting"),
            self.table("consts").select("alias_of", "nesting"),
            refs.select("name", "nesting"),
            refs.select(F.regexp_replace("name", "::[^:]+$", ""), "nesting"),
            e.filter("op = 'const'").select("name", "nesting"),
            e.filter("op = 'declared'").select(members("name"), "nesting"),
            m.select(members("declared"), "nesting"),
            m.select(members("sig_returns"), "nesting"),
            m.select(F.explode(F.concat("param_types", F.coalesce("sig_types", F.array().cast("array<string>")))).alias("t"), "nesting").select(members("t"), "nesting"),
            m.select(F.explode("sig_types").alias("t"), "nesting").select(members("t"), "nesting"),
            self.anywhere.select("name", "nesting"),
        ]
        want = spots[0]
        for x in spots[1:]:
            want = want.unionAll(x)
        want = want.filter("name is not null and nesting is not null").distinct()
        rooted = F.col("name").startswith("::")
        bare = F.regexp_replace("name", "^::", "")
        scopes = F.when(rooted, F.array(F.lit(""))).otherwise(F.concat(F.reverse("nesting"), F.array(F.lit(""))))
        levels = want.select("name", "nesting", F.posexplode(scopes).alias("rank", "scope"), bare.alias("bare")).withColumn("target", text.join_path(F.col("scope"), F.col("bare")))
        hits = levels.join(self.known.select(F.col("name").alias("target")), "target").select("name", "nesting", "rank", "target")
        return cut(resolve.first_by_rank(hits, ["name", "nesting"], ["rank"]).select("name", "nesting", "target"), "resolved")

    def lexical(self, refs: DataFrame) -> DataFrame:
        """(name, nesting, target) of the references that name a constant."""
        return self.resolved.join(refs.select("name", "nesting").distinct(), ["name", "nesting"], "left_semi")

    @cached_property
    def aliases(self) -> DataFrame:
        """(name, class_path): constants that name a class, directly or through others."""
        own = self.classes.select(F.col("class_path").alias("name"), "class_path")
        links = self.table("consts").filter("alias_of is not null").select(F.col("name").alias("alias"), F.col("alias_of").alias("name"), "nesting")
        edges = links.join(self.resolved, ["name", "nesting"]).select("alias", "target").distinct()
        if not edges.limit(1).count():
            return own
        # A constant assigned twice names nothing for sure.
        edges = edges.join(self.table("consts").groupBy(F.col("name").alias("alias")).agg(F.count("*").alias("n")).filter("n = 1"), "alias").select("alias", "target")
        chain = resolve.closure(edges, "alias", "target")
        reached = chain.join(self.classes.select(F.col("class_path").alias("ancestor")), "ancestor").select(F.col("node").alias("name"), F.col("ancestor").alias("class_path"))
        return cut(own.unionAll(reached.join(self.classes.select(F.col("class_path").alias("name")), "name", "left_anti")).distinct(), "aliases")

    @cached_property
    def _to_class(self) -> DataFrame:
        return cut(self.resolved.join(self.aliases.select(F.col("name").alias("target"), "class_path"), "target").select("name", "nesting", "class_path"), "named-classes")

    def to_class(self, refs: DataFrame | None = None) -> DataFrame:
        """(name, nesting, class_path) of the references that name a class: of the whole program, or of some."""
        return self._to_class if refs is None else self._to_class.join(refs.select("name", "nesting").distinct(), ["name", "nesting"], "left_semi")

    # -- ancestry ---------------------------------------------------------
    @cached_property
    def _direct(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Edges (node, slot, target), extend edges (node, ord, target), and nodes with an edge that is not known."""
        frag = self.table("fragments").filter("superclass is not null").select(F.col("class_path").alias("node"), F.col("superclass").alias("name"), "nesting")
        parents = frag.filter(~F.regexp_replace("name", "^::", "").isin(*core.ROOTS)).join(self.to_class(), ["name", "nesting"], "left")
        # All that is asked of the superclasses a class names, in one pass.
        named, other = F.col("class_path"), F.when(F.col("class_path") != F.col("node"), F.col("class_path"))
        parents = cut(parents.groupBy("node").agg(F.min(other).alias("c"), (F.count_if(other.isNull()) > 0).alias("vague"), (F.min(named) != F.max(named)).alias("conflict")), "parents")
        mix = self.table("mixins").select(F.col("class_path").alias("node"), "kind", F.col("target").alias("name"), "nesting", "path", "ord")
        mix = mix.filter(~F.regexp_replace("name", "^::", "").isin(*core.SIGNATURE_MODULES))
        spelt = self.to_class().join(small(cut(mix.select("name", "nesting").distinct(), "mixed-names")), ["name", "nesting"], "left_semi")
        mixed = cut(mix.join(spelt, ["name", "nesting"], "left"), "mixed")
        # `class Scope < Scope` names an inherited class, before the new one is there.
        unknown = parents.filter("vague or conflict").select("node").unionAll(mixed.filter("class_path is null").select("node")).distinct()
        later = F.row_number().over(Window.partitionBy("node", "kind").orderBy(F.desc("path"), F.desc("ord")))
        ranked = mixed.filter("class_path is not null").withColumn("r", later)
        edges = ranked.filter("kind = 'include'").select("node", F.col("r").cast("long").alias("slot"), F.col("class_path").alias("target"))
        edges = edges.unionAll(ranked.filter("kind = 'prepend'").select("node", (F.col("r") - 1_000_000).cast("long"), "class_path"))
        # These are one row for each class already.
        above = parents.filter("c is not null").select("node", F.lit(1_000_000).cast("long").alias("slot"), F.col("c").alias("target"))
        extends = ranked.filter("kind = 'extend'").select("node", F.col("r").cast("long").alias("ord"), F.col("class_path").alias("target"))
        return tuple(together(lambda: cut(edges.distinct().unionAll(above), "edges"), lambda: cut(extends.distinct(), "extends"), lambda: cut(unknown, "unknown")))

    def _order(self, edges: DataFrame) -> DataFrame:
        """(root, nodes, steps, own): all that is reached over the edges, in the order in which methods are looked up, and where in it the class itself is.

        What a class prepends comes before it, then itself, what it includes and its superclass, each with
        its own order in it.  Steps double in each round, so chains of any length take few rounds: the
        best way to a node further than 2^k steps has its 2^k-th node in the last round's order, and the place
        of a node reached through it is that one's place, then the place relative to it.  A class is one row
        in every round, whatever the number of ways between two classes: its order is an array, which takes
        a fraction of what a row for each of its members does in a shuffle.
        """
        way = "array<struct<node: string, a: bigint, b: bigint, steps: int>>"

        def ordered(rows: DataFrame) -> DataFrame:
            """The best way to each node of ``ways``, in order."""
            rows = rows.select("root", F.array_sort("ways").alias("ways"))
            before = F.concat(F.array(F.lit(None).cast("string")), F.slice("ways.node", F.lit(1), F.size("ways") - 1))
            rows = rows.select("root", F.arrays_zip("ways", before.alias("before")).alias("ways"))
            best = F.filter("ways", lambda x: x["before"].isNull() | (x["before"] != x["ways"]["node"]))
            rows = rows.select("root", F.array_sort(F.transform(best, lambda x: F.struct(x["ways"]["a"].alias("a"), x["ways"]["b"].alias("b"), x["ways"]["node"].alias("node"), x["ways"]["steps"].alias("steps")))).alias("ways"))
            rows = rows.select("root", F.col("ways.node").alias("nodes"), F.col("ways.steps").alias("steps"))
            return rows.select("root", "nodes", "steps", F.nullif(F.array_position("nodes", F.col("root")), F.lit(0)).cast("int").alias("own"))

        no = F.lit(0).cast("long")
        own = self.classes.select(F.col("class_path").alias("root"), F.struct(F.col("class_path").alias("node"), no.alias("a"), no.alias("b"), F.lit(0).alias("steps")).alias("way"))
        first = edges.filter("node <> target").select(F.col("node").alias("root"), F.struct(F.col("target").alias("node"), F.col("slot").alias("a"), no.alias("b"), F.lit(1).alias("steps")).alias("way"))
        known = cut(ordered(own.unionAll(first).filter("root is not null").groupBy("root").agg(F.collect_list("way").alias("ways"))), "order")
        limit, reach = max(self.classes.count(), 1), 1
        # A cycle of classes would let ways grow for ever; no way has more steps than there are classes.
        while reach < limit and known.filter(F.array_contains("steps", reach)).limit(1).count():
            # Both joins read the same rows by the same key: one exchange.
            have = known.filter("root is not null").repartition("root")
            far = known.select("root", F.posexplode(F.arrays_zip("nodes", "steps")).alias("a", "x")).filter(F.col("x.steps") == reach).select("root", F.col("a").cast("long").alias("a"), F.col("x.nodes").alias("via"))
            inner = have.select(F.col("root").alias("via"), "nodes", "steps", "own")
            through = far.join(inner, "via").filter("own is not null").select("root", F.struct("a", "nodes", "steps", "own").alias("x"))
            through = through.groupBy("root").agg(F.collect_list("x").alias("through"))
            old = F.transform(F.arrays_zip("nodes", "steps"), lambda x, k: F.struct(x["nodes"].alias("node"), k.cast("long").alias("a"), no.alias("b"), x["steps"].alias("steps")))
            beyond = lambda t: F.transform(F.arrays_zip(t["nodes"].alias("nodes"), t["steps"].alias("steps")), lambda x, k: F.struct(x["nodes"].alias("node"), t["a"].alias("a"), (k + 1 - t["own"]).cast("long").alias("b"), (x["steps"] + reach).alias("steps")))
            more = F.flatten(F.transform(F.coalesce("through", F.array().cast(through.schema["through"].dataType)), beyond))
            more = F.filter(more, lambda x: (x["b"] != 0) & (x["node"] != F.col("root")))
            every = have.join(through, "root", "left").select("root", F.concat(old.cast(way), more.cast(way)).alias("ways"))
            new = cut(ordered(every), "order")
            drop(known)
            known, reach = new, reach * 2
        return known

    @cached_property
    def orders(self) -> DataFrame:
        return self._order(self._direct[0])

    @cached_property
    def mro(self) -> DataFrame:
        """(root, node, rank): the orders as rows."""
        return _ranks(self.orders)

    @cached_property
    def chains(self) -> DataFrame:
        """Superclasses only: where class-level methods are looked up; without a mixin that is the whole order."""
        if not self._direct[0].filter("slot <> 1000000").limit(1).count():
            return self.orders
        return self._order(self._direct[0].filter("slot = 1000000"))

    @cached_property
    def chain(self) -> DataFrame:
        return _ranks(self.chains)

    def along(self, rows: DataFrame, orders: DataFrame) -> DataFrame:
        """The rows, with ``class_path``, for each (node, rank) of its order: only what is asked for becomes rows."""
        asked = rows.join(orders.select(F.col("root").alias("class_path"), "nodes"), "class_path")
        return asked.select(*rows.columns, F.posexplode("nodes").alias("rank", "node")).withColumn("rank", F.col("rank").cast("long") + 1)

    @cached_property
    def incomplete(self) -> DataFrame:
        """(class_path): classes whose ancestry has an open class or an unknown edge."""
        hooks = self.anywhere.filter("kind = 'hook'").select(F.col("name").alias("target"))
        edges, extends, _ = self._direct
        hosts = edges.select("node", "target").unionAll(extends.select("node", "target")).join(hooks, "target", "left_semi").select("node")
        opened = self.anywhere.filter("kind = 'open'")
        opened = self.to_class(opened).select("class_path")
        # Of two classes that reach each other neither has an order: one of them is what the other has an edge to, or reached from there.
        ways = edges.filter("node <> target").select("node", F.col("target").alias("root")).distinct()
        cyclic = ways.join(self.orders.select("root", "nodes"), "root").filter(F.array_contains("nodes", F.col("node"))).select("node")
        bad = cut(cyclic.unionAll(self._direct[2]).unionAll(self.classes.filter("open").select("class_path")).unionAll(hosts).unionAll(opened).distinct(), "bad")
        return cut(self.mro.join(small(bad), "node", "left_semi").select(F.col("root").alias("class_path")).distinct(), "incomplete")

    @cached_property
    def blockers(self) -> DataFrame:
        """(class_path, reason): the first thing in look-up order that keeps the ancestry open; an abstract method is the weakest reason."""
        frag = self.table("fragments")
        why = frag.filter("open_reason is not null").select(F.col("class_path").alias("node"), F.col("open_reason").alias("reason"))
        why = why.unionAll(self._direct[2].select("node", F.lit("Unresolved")))
        if self.surfaces is not None:
            # An unresolved name that a declaration knows is declared, not unresolved.
            known = self.surfaces.constants.select(F.col("name").alias("host"))
            spelt = self.hosts.join(known, "host", "left_semi").select(F.col("class_path").alias("node")).distinct()
            why = why.join(spelt.withColumn("__told", F.lit(True)), "node", "left").select("node", F.when((F.col("reason") == "Unresolved") & F.col("__told"), "Declared").otherwise(F.col("reason")).alias("reason"))
        if self.evidence is not None:
            why = why.unionAll(source_facts.table(self.evidence, "fragments").select(F.col("class_path").alias("node"), F.lit("IgnoredReopening")))
        outside = F.substring_index("node", "::", 1).isin(*core.CORE_CONSTANTS, *core.LIBRARY_CONSTANTS)
        why = why.unionAll(self.classes.select(F.col("class_path").alias("node")).filter(outside).select("node", F.lit("ReopenedExternal")))
        why = why.unionAll(self.to_class(self.anywhere.filter("kind = 'open'")).select(F.col("class_path").alias("node"), F.lit("EvalOrSend")))
        rows = self.mro.join(why.distinct(), "node").select(F.col("root").alias("class_path"), (F.col("reason") == "AbstractRaise").alias("weak"), "rank", "reason")
        first = resolve.first_by_rank(rows, ["class_path"], ["weak", "rank", "reason"]).select("class_path", "reason")
        return cut(first.join(self.incomplete, "class_path", "left_semi"), "blockers")

    # -- methods ----------------------------------------------------------
    @cached_property
    def methods(self) -> DataFrame:
        m = self.table("methods").withColumn("method", F.concat_ws("#", "path", F.col("name_start").cast("string"), "name", F.col("singleton").cast("string")))
        if self.schema is None:
            return cut(m, "methods")
        return cut(m.unionByName(self._columns(m)), "methods")

    def _columns(self, m: DataFrame) -> DataFrame:
        """Readers and writers that a table's columns give to its model; own methods win."""
        models = self.classes.select("class_path", text.table_name(F.col("class_path")).alias("table")).join(self.schema, "table")
        kind = F.when(F.col("type").isin("string", "text"), "String").when(F.col("type").isin("integer", "bigint"), "Integer").when(F.col("type") == "boolean", "bool").otherwise(UNTYPED)
        both = models.select("class_path", "column", kind.alias("declared"), F.explode(F.array(F.lit(False), F.lit(True))).alias("writer"))
        made = both.select("class_path", F.when(F.col("writer"), F.concat("column", F.lit("="))).otherwise(F.col("column")).alias("name"), F.when(F.col("writer"), 1).otherwise(0).cast("long").alias("required"), F.when(~F.col("writer"), F.col("declared")).alias("declared"))
        made = made.join(m.filter("not singleton").select("class_path", "name"), ["class_path", "name"], "left_anti")
        fixed = {"path": F.lit("(schema)"), "singleton": F.lit(False), "optional": F.lit(0).cast("long"), "rest": F.lit(False), "arity_unknown": F.lit(False), "abstract": F.lit(False)}
        out = made.withColumns(fixed)
        for c, t in m.dtypes:
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast(t))
        return out.withColumn("method", F.concat_ws("#", F.lit("(schema)"), "class_path", "name")).select(*m.columns)

    @cached_property
    def _called(self) -> DataFrame:
        """(name, singleton): what some method answers; what a class extends itself with answers to the class."""
        own = self.methods.select("name", "singleton").distinct()
        if self._direct[1].limit(1).count():
            own = own.unionAll(own.filter("not singleton").select("name", F.lit(True))).distinct()
        return small(cut(own, "called"))

    @cached_property
    def _latest(self) -> DataFrame:
        """(owner, name, own, method, first): of several definitions in one class the last counts (across files the order is by path); is it asked before all others?"""
        last = self.methods.groupBy(F.col("class_path").alias("owner"), "name", F.col("singleton").alias("own")).agg(F.max(F.struct("path", "start", "method")).alias("b"))
        before = self._direct[0].filter("slot < 0 and node <> target").select(F.col("node").alias("owner")).distinct()
        known = self.classes.select(F.col("class_path").alias("owner")).join(small(cut(before, "prepended")).withColumn("__late", F.lit(True)), "owner", "left")
        got = last.join(known.withColumn("__known", F.lit(True)), "owner", "left")
        first = F.coalesce("__known", F.lit(False)) & (F.col("own") | F.col("__late").isNull())
        return cut(got.select("owner", "name", "own", F.col("b.method").alias("method"), first.alias("first")), "latest")

    def find(self, want: DataFrame) -> DataFrame:
        """(class_path, name, singleton, method, owner) for the wanted (class_path, name, singleton): first along the order.

        A class that has the method itself and prepends nothing needs no order; the others' orders become rows.
        """
        want = want.select("class_path", "name", "singleton").join(self._called, ["name", "singleton"], "left_semi").distinct()
        m = self._latest
        own = m.filter("first").select(F.col("owner").alias("class_path"), "name", F.col("own").alias("singleton"), "method")
        near = cut(want.join(own, ["class_path", "name", "singleton"], "left").select("class_path", "name", "singleton", "method", F.when(F.col("method").isNotNull(), F.col("class_path")).alias("owner")), "near")
        got, want = near.filter("method is not null"), near.filter("method is null").select("class_path", "name", "singleton")
        asked = want.count()
        if not asked:
            return got
        if asked <= FEW:
            want = F.broadcast(want)
        names_ = small(cut(want.select("name").distinct(), "asked-names"))
        m = m.join(names_, "name", "left_semi")
        no = F.lit(0).cast("long")
        owner = F.col("node").alias("owner")
        on_instances = self.along(want.filter("not singleton"), self.orders).select("class_path", "name", "singleton", owner, F.struct(F.col("rank").alias("r"), no.alias("o"), no.alias("i")).alias("key")).join(m.filter("not own"), ["owner", "name"])
        on_class = self.along(want.filter("singleton"), self.chains).select("class_path", "name", "singleton", owner, "rank")
        direct = on_class.withColumn("key", F.struct(F.col("rank").alias("r"), no.alias("o"), no.alias("i"))).join(m.filter("own"), ["owner", "name"])
        # What a class extends itself with comes after its own methods and before those of its superclass.
        ext = self._direct[1].select(F.col("node").alias("owner"), "ord", F.col("target").alias("module"))
        through = self.orders.select(F.col("root").alias("module"), F.posexplode("nodes").alias("inner", "at")).withColumn("inner", F.col("inner").cast("long") + 1)
        if self._direct[1].limit(1).count():
            through = through.join(small(cut(ext.select("module").distinct(), "extending")), "module", "left_semi")
        extended = on_class.join(ext, "owner").join(through, "module").withColumn("key", F.struct(F.col("rank").alias("r"), F.col("ord").alias("o"), F.col("inner").alias("i"))).drop("owner").withColumnRenamed("at", "owner").join(m.filter("not own"), ["owner", "name"])
        cols = ["class_path", "name", "singleton", "key", "owner", "method"]
        every = on_instances.select(*cols).unionAll(direct.select(*cols))
        if self._direct[1].limit(1).count():
            every = every.unionAll(extended.select(*cols))
        best = every.groupBy("class_path", "name", "singleton").agg(F.min(F.struct("key", F.struct("method", "owner").alias("b"))).alias("x"))
        return got.unionAll(best.select("class_path", "name", "singleton", F.col("x.b.method").alias("method"), F.col("x.b.owner").alias("owner")))

    # -- declarations -----------------------------------------------------
    @cached_property
    def surfaces(self):
        from factloom.plans.surfaces import Surfaces

        return None if self.rbi is None else Surfaces(self.rbi)

    @cached_property
    def hosts(self) -> DataFrame:
        return self.surfaces.hosts(self)

    @cached_property
    def record_classes(self) -> DataFrame:
        """(class_path): classes whose ancestry is declared to go through ``ActiveRecord::Base``."""
        base = "ActiveRecord::Base"
        spelt = self.table("fragments").filter(F.regexp_replace("superclass", "^::", "") == base).select(F.col("class_path").alias("node"))
        own = self.mro.join(spelt.distinct(), "node", "left_semi").select(F.col("root").alias("class_path"))
        if self.surfaces is not None:
            own = own.unionAll(self.hosts.filter(F.col("host") == base).select("class_path"))
        return cut(own.distinct(), "records")

    def declared(self, want: DataFrame) -> DataFrame | None:
        """(class_path, name, singleton, tier, result): what declarations answer, in order: generated (0), libraries (1), records (2)."""
        parts = []
        want = want.select("class_path", "name", "singleton").distinct()
        if self.surfaces is not None:
            parts.append(self.surfaces.answers(want, self.hosts).select("class_path", "name", "singleton", "tier", "result"))
        if self.records is not None:
            api = self.records.select(F.col("method").alias("name"), "singleton").distinct()
            parts.append(want.join(self.record_classes, "class_path", "left_semi").join(api, ["name", "singleton"], "left_semi").select("class_path", "name", "singleton", F.lit(2).alias("tier"), F.lit(None).cast("string").alias("result")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
        return resolve.first_by_rank(rows, ["class_path", "name", "singleton"], ["tier"])

    # -- types ------------------------------------------------------------
    @cached_property
    def types(self) -> DataFrame:
        """(id, type, base): terms, with and without what collections hold; what stays unresolved is unknown."""
        self._prepare()
        e = self._exprs
        core_names = F.broadcast(self.spark.createDataFrame([(x,) for x in core.CORE_TYPES], "name string").withColumn("__core", F.lit(True)))
        # Declared types: each member is a core name, or a class of the project, or unknown.
        declared = e.filter("op = 'declared'").select("id", "nesting", F.explode(F.split("name", " \\| ")).alias("name"))
        declared = declared.join(self.to_class(), ["name", "nesting"], "left").join(core_names, "name", "left")
        member = F.coalesce("class_path", F.when(F.col("__core"), F.col("name")), F.lit(UNTYPED))
        declared = declared.groupBy("id").agg(_union(F.collect_set(member)).alias("type"))
        consts = e.filter("op = 'const'").select("id", "name", "nesting")
        consts = consts.join(self.to_class(), ["name", "nesting"], "left").join(core_names, "name", "left").join(self.resolved, ["name", "nesting"], "left")
        const_type = F.when(F.col("class_path").isNotNull(), F.concat(F.lit("Class["), "class_path", F.lit("]"))).when(F.col("__core") & F.col("target").isNull(), F.concat(F.lit("Class["), "name", F.lit("]"))).otherwise(UNTYPED)
        values = e.filter("op in ('atom', 'self')").select("id", F.col("name").alias("type")).unionAll(declared).unionAll(consts.select("id", const_type.alias("type")))
        writes = self.table("ivars").select(F.concat("class_path", "name").alias("name"), "expr").groupBy("name").agg(F.collect_set(F.coalesce("expr", F.lit(""))).alias("operands"))
        closed = self.classes.join(self.incomplete, "class_path", "left_anti").select("class_path")
        ivars = e.filter("op = 'ivar'").select("id", "op", "name").withColumn("class_path", F.substring_index("name", "@", 1)).join(closed, "class_path", "left_semi").join(writes, "name").select("id", "op", "name", "operands", F.lit(None).cast("string").alias("shape"))
        # Never written here, or of a class that may be written to elsewhere: unknown, and known to be.
        values = values.unionAll(e.filter("op = 'ivar'").select("id").join(ivars.select("id"), "id", "left_anti").select("id", F.lit(UNTYPED)))
        waiting = e.filter("op in ('union', 'strip', 'narrow', 'minus', 'call', 'array', 'hash', 'erase')").select("id", "op", "name", "operands", "shape").unionAll(ivars)
        log = Log(self.spark, "values")
        first = values.select("id", "type", terms.erase(F.col("type")).alias("base"), F.lit(None).cast("string").alias("of"))
        pending, _ = together(lambda: cut(waiting, "pending"), lambda: log.append(first))
        told = lambda: log.frame().filter("type is not null").select("id", "type", "base")
        result, alias, left, spare = self._results, None, 0, 0
        while True:
            # New values are only added; a call that is known to be another expression follows it by doubling.
            new = log.append(self._round(pending, told(), result, alias))
            got, met = new.agg(F.count("type"), F.count("of")).first()
            if got or met:
                pending = cut(pending.join(new.select("id"), "id", "left_anti"), "pending")
                same = new.filter("type is null").select("id", "of")
                if alias is not None:
                    same = alias.join(new.filter("type is not null").select("id"), "id", "left_anti").unionAll(same)
                if alias is not None or met:
                    alias = cut(same, "alias")
                    left = alias.count()
                    spare = left.bit_length() + 1
            elif left and spare:
                spare -= 1
            else:
                break
            if left:
                alias = cut(alias.join(alias.select(F.col("id").alias("of"), F.col("of").alias("next")), "of", "left").select("id", F.coalesce("next", "of").alias("of")), "alias")
        # What is left depends on itself.
        rest = pending.select("id") if alias is None else pending.select("id").unionAll(alias.select("id"))
        return cut(told().unionAll(rest.select("id", F.lit(UNTYPED), F.lit(UNTYPED))), "types")

    @cached_property
    def _exprs(self) -> DataFrame:
        return cut(self.table("exprs").drop("path"), "exprs")

    def _prepare(self) -> None:
        """What types and look-ups need, side by side where neither needs the other."""
        together(lambda: self.facts, lambda: self.evidence)
        together(lambda: self.classes, lambda: self.anywhere, lambda: self._exprs)
        together(lambda: self.methods, lambda: self._direct)
        together(lambda: self.mro, lambda: self._results)
        together(lambda: self.chain, lambda: self.incomplete)

    @cached_property
    def _results(self) -> DataFrame:
        """(method, declared, ret): what a method's result is known by."""
        m = self.methods.select("method", "declared", "ret", "nesting", "class_path")
        names_ = m.filter("declared is not null").select("method", "nesting", F.explode(F.split("declared", " \\| ")).alias("name"))
        core_names = F.broadcast(self.spark.createDataFrame([(x,) for x in core.CORE_TYPES], "name string").withColumn("__core", F.lit(True)))
        got = names_.join(self.to_class(), ["name", "nesting"], "left").join(core_names, "name", "left")
        declared = got.groupBy("method").agg(_union(F.collect_set(F.coalesce("class_path", F.when(F.col("__core"), F.col("name")), F.lit(UNTYPED)))).alias("declared"))
        # A library signature only speaks where inference is silent.
        sigs = self.methods.filter("sig_returns is not null").select("method", "nesting", F.explode(F.split("sig_returns", " \\| ")).alias("name"))
        said = sigs.join(self.to_class(), ["name", "nesting"], "left").join(core_names, "name", "left")
        said = said.groupBy("method").agg(_union(F.collect_set(F.coalesce("class_path", F.when(F.col("__core"), F.col("name")), F.lit(UNTYPED)))).alias("sig"))
        return cut(m.select("method", "ret").join(declared, "method", "left").join(said, "method", "left"), "results")

    def _round(self, pending: DataFrame, values: DataFrame, result: DataFrame, alias: DataFrame | None) -> DataFrame:
        """(id, type, of): what can be told now, and calls whose type is that of another, pending expression."""
        values = values.select("id", "type")
        parts = pending.filter("op <> 'call'").select("id", "op", F.posexplode("operands").alias("k", "of"))
        typed = parts.join(values.select(F.col("id").alias("of"), "type"), "of", "left").withColumn("type", F.when(F.col("of") == "", UNTYPED).otherwise(F.col("type")))
        ready = typed.groupBy("id", "op").agg(F.count_if(F.col("type").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("k", "type"))).alias("x")).filter("missing = 0").select("id", "op", F.col("x.type").alias("x"))
        split = terms.members
        every = lambda xs: F.flatten(F.transform(xs, split))
        place = lambda k: F.filter("x", lambda _, i: i % 2 == k)
        pairs = F.col("op") == "hash"
        ready = ready.select("id", "op", "x", terms.union(every(F.when(pairs, place(0)).otherwise(F.col("x")))).alias("all"), F.when(pairs, terms.union(every(place(1)))).alias("second"))
        first, last = F.element_at("x", 1), F.element_at("x", -1)
        target = F.regexp_extract(last, r"^Class\[(.*)\]$", 1)
        # Whatever they hold, arrays are arrays and hashes are hashes.
        without = F.filter(split(first), lambda m: terms.bare(m) != target)
        local = (
            F.when(F.col("op") == "union", F.col("all"))
            .when(F.col("op") == "array", F.when(F.col("all") == UNTYPED, "Array").otherwise(F.concat(F.lit("Array["), terms.inner(F.col("all")), F.lit("]"))))
            .when(pairs, F.when((F.col("all") == UNTYPED) & (F.col("second") == UNTYPED), "Hash").otherwise(F.concat(F.lit("Hash["), terms.inner(F.col("all")), F.lit(", "), terms.inner(F.col("second")), F.lit("]"))))
            .when(F.col("op") == "erase", terms.erase(first))
            # Any method may change what a variable of the object holds.
            .when(F.col("op") == "ivar", F.when(F.size(F.array_distinct("x")) == 1, terms.erase(first)).otherwise(UNTYPED))
            .when(F.col("op") == "narrow", F.when(target != "", target).otherwise(UNTYPED))
            .when(F.col("op") == "strip", F.when(first == "nil", UNTYPED).otherwise(F.array_join(F.array_remove(split(first), "nil"), " | ")))
            .otherwise(F.when((F.size(split(first)) > 1) & (F.size(without) < F.size(split(first))) & (first != UNTYPED) & (F.size(without) > 0), F.array_join(without, " | ")).otherwise(first))
        )
        simple = ready.select("id", local.alias("type"))
        calls = pending.filter("op = 'call'").select("id", "name", F.element_at("operands", 1).alias("of"), F.try_element_at("operands", F.lit(2)).alias("arg"), F.slice("operands", 2, F.greatest(F.size("operands") - 1, F.lit(0))).alias("given"), "shape")
        # Receivers are met once: look-up, contents and bounds read what is written here.  All who ask for values read the same two columns, so they share an exchange.
        calls = cut(calls.join(values.select(F.col("id").alias("of"), F.col("type").alias("recv")), "of").drop("of").withColumn("base", terms.erase(F.col("recv"))), "calls")
        calls = calls.withColumn("singleton", F.col("recv").startswith("Class[")).withColumn("class_path", F.regexp_replace("base", r"^Class\[(.*)\]$", "$1"))
        hit = self.find(calls)
        # A look-up is told with its result, so that calls, which are more and wider, meet it once.
        known = hit.join(result, "method", "left").join(values.select(F.col("id").alias("ret"), F.col("type").alias("body")), "ret", "left")
        plain = calls.filter("singleton and name = 'new'").select("class_path").distinct().join(self.classes.filter("not is_module").select("class_path"), "class_path")
        known = known.join(plain.select("class_path", F.lit("new").alias("name"), F.lit(True).alias("singleton"), F.lit(True).alias("plain")), ["class_path", "name", "singleton"], "full")
        got = calls.join(known, ["class_path", "name", "singleton"], "left")
        made = F.col("singleton") & (F.col("name") == "new") & F.col("method").isNull()
        said = self.declared(calls.join(hit, ["class_path", "name", "singleton"], "left_anti"))
        if said is None:
            got = got.withColumn("said", F.lit(None).cast("string"))
        else:
            # Only a single core type, or a closed class of the project, tells anything.
            simply = F.when(F.col("result").isin(*core.CORE_TYPES), F.col("result"))
            own = self.classes.select(F.col("class_path").alias("result"), F.col("class_path").alias("as_class"))
            said = said.withColumn("result", F.regexp_replace("result", "^::", "")).join(own, "result", "left").select("class_path", "name", "singleton", F.coalesce(simply, "as_class").alias("said"))
            got = got.join(said, ["class_path", "name", "singleton"], "left")
        # Arguments, bounds and contents are read for core values only.
        table = self.core_table.select(F.col("class").alias("base"), "name", F.col("result").alias("core"), F.col("block").alias("holds"))
        cored = cut(calls.join(table, ["base", "name"]), "core-calls")
        any_core = bool(cored.limit(1).count())
        if any_core:
            told = cored.select("id", "arg", "core", "holds").join(values.select(F.col("id").alias("arg"), F.col("type").alias("arg_type")), "arg", "left").join(self._bounds(cored, values), "id", "left")
            got = got.join(told.select("id", "core", "holds", "arg_type", "bounds"), "id", "left")
        else:
            got = got.withColumns({"core": F.lit(None).cast("string"), "holds": F.lit(None).cast("boolean"), "arg_type": F.lit(None).cast("string"), "bounds": F.lit(None).cast("boolean")})
        # What a project's method makes of a block is not followed.
        blind = F.col("shape").startswith("b") & ~F.col("name").isin("new", "tap", "times", "each")
        out = (
            F.when(F.col("recv") == UNTYPED, UNTYPED)
            .when(F.col("recv").contains(" | "), UNTYPED)
            .when(blind & (F.col("method").isNotNull() | F.col("core").isNull()), UNTYPED)
            .when(made, F.when(F.col("plain"), F.col("class_path")).otherwise(UNTYPED))
            .when(F.col("declared").isNotNull(), F.col("declared"))
            .when(F.col("method").isNotNull(), F.when(F.col("ret").isNull() | (F.col("body") == UNTYPED), F.coalesce("sig", F.lit(UNTYPED))).otherwise(F.col("body")))
            .when(F.col("said").isNotNull(), F.col("said"))
            .otherwise(_core_result())
        )
        same = F.when(out.isNull() & F.col("sig").isNull() & F.col("method").isNotNull(), F.col("ret"))
        if any_core:
            simple = simple.unionAll(terms.held(self._held(cored, values)))
        found = simple.select("id", "type", F.lit(None).cast("string").alias("of")).unionAll(got.select("id", out.alias("type"), same.alias("of")))
        if alias is not None:
            found = found.unionAll(alias.join(values.select(F.col("id").alias("of"), "type"), "of").select("id", "type", F.lit(None).cast("string")))
        return found.filter("type is not null or of is not null").select("id", "type", terms.erase(F.col("type")).alias("base"), "of")

    def _bounds(self, calls: DataFrame, values: DataFrame) -> DataFrame:
        """(id, bounds): whether both bounds of a ``clamp`` are integers, once they are known."""
        wanted = calls.filter("base = 'Integer' and name = 'clamp' and size(given) = 2")
        each = wanted.select("id", F.explode("given").alias("of")).join(values.select(F.col("id").alias("of"), "type"), "of")
        return each.groupBy("id").agg(F.count("*").alias("n"), F.bool_and(F.col("type") == "Integer").alias("bounds")).filter("n = 2").select("id", "bounds")

    def _held(self, calls: DataFrame, values: DataFrame) -> DataFrame:
        """(id, rule, base, own, type): receivers and arguments of the calls whose result is what collections hold."""
        rules = self.core_table.filter(F.col("result").isin(*core.BY_CONTENT)).select(F.col("class").alias("base"), "name", F.col("result").alias("rule"), "block")
        wanted = calls.drop("core", "holds").filter(F.col("base").isin("Array", "Hash")).join(rules, ["base", "name"]).filter(_reads_content(F.col("rule"), F.col("block")))
        own = wanted.select("id", "rule", "base", F.lit(True).alias("own"), F.col("recv").alias("type"))
        given = wanted.filter(F.col("rule").isin("plus", "push", "merge")).select("id", "rule", "base", F.explode("given").alias("of")).join(values.select(F.col("id").alias("of"), "type"), "of", "left")
        return own.unionAll(given.select("id", "rule", "base", F.lit(False), F.when(F.col("of") == "", UNTYPED).otherwise(F.col("type"))))

    @cached_property
    def inventory(self) -> DataFrame | None:
        """``core_inventory`` as a table: it may come from signature files, and is read many times."""
        return None if self.core_inventory is None else cut(self.core_inventory, "inventory")

    @cached_property
    def core_table(self) -> DataFrame:
        """Results of core methods, less those of classes the project reopens."""
        rows = self.spark.createDataFrame(core.core_results(), "class string, name string, least int, most int, result string, block boolean")
        if self.inventory is not None and "least" in self.inventory.columns:
            # What the table does not have, by its signatures; without a block, as those with one tell no result.
            known = F.when(F.col("result").isin(*core.CORE_TYPES, "self"), F.col("result"))
            kind = F.when(F.col("class") == "NilClass", "nil").when(F.col("class").isin("TrueClass", "FalseClass"), "bool").otherwise(F.col("class"))
            more = self.inventory.filter("least is not null").select(kind.alias("class"), F.col("method").alias("name"), "least", "most", known.alias("result"), F.when(known.isNotNull(), False).alias("block"))
            more = more.groupBy("class", "name").agg(F.min("least").alias("least"), F.when(F.count("most") == F.count("*"), F.max("most")).alias("most"), F.when((F.count("result") == F.count("*")) & (F.count_distinct("result") == 1), F.min("result")).alias("result"), F.min("block").alias("block"))
            rows = cut(rows.unionByName(more.join(rows.select("class", "name"), ["class", "name"], "left_anti")), "core-table")
        # Only classes of those names are asked for among the project's.
        reopened = self.classes.select(F.col("class_path").alias("class")).join(F.broadcast(rows.select("class").distinct()), "class", "left_semi")
        return small(cut(rows.join(F.broadcast(reopened), "class", "left_anti"), "core-methods"))

    # -- call sites -------------------------------------------------------
    @cached_property
    def sites(self) -> DataFrame:
        """Every call with its receiver's type, the method found, and the verdict."""
        c = self.table("calls").join(self.types.select(F.col("id").alias("recv"), F.col("base").alias("recv_type")), "recv", "left")
        c = c.withColumn("recv_type", F.coalesce("recv_type", F.lit(UNTYPED)))
        is_class = F.col("recv_type").startswith("Class[")
        c = c.withColumnRenamed("class_path", "in_class").withColumnRenamed("singleton", "in_singleton").withColumn("class_path", F.regexp_replace("recv_type", r"^Class\[(.*)\]$", "$1"))
        fresh = is_class & (F.col("name") == "new")
        direct = c.withColumn("singleton", is_class).withColumn("asked", F.col("name"))
        hit = self.find(direct.select("class_path", "name", "singleton").unionAll(c.filter(fresh).select("class_path", F.lit("initialize"), F.lit(False))))
        hit = cut(hit, "hits")
        own = hit.select("class_path", F.col("name").alias("asked"), "singleton", "method", "owner")
        made = hit.filter("name = 'initialize' and not singleton").select("class_path", F.col("method").alias("init"))
        # What is known of a class is put together first, so that calls meet it once.
        about = self.classes.select("class_path", "is_module").join(small(made), "class_path", "full").join(small(self.incomplete).withColumn("__open", F.lit(True)), "class_path", "full")
        rows = direct.join(own, ["class_path", "asked", "singleton"], "left").join(about, "class_path", "left")
        rows = rows.withColumn("target", F.coalesce("method", F.when(fresh, F.col("init")))).drop("init", "asked")
        rows = rows.join(self._answered(), ["name", "singleton"], "left")
        asked = None
        if c.filter(F.col("recv_kind").isin("implicit", "self")).limit(1).count():
            asked = cut(rows.filter(F.col("target").isNull() & F.col("recv_kind").isin("implicit", "self")).select("class_path", "name").distinct(), "asked")
        if asked is not None and asked.limit(1).count():
            rows = rows.join(self._below(asked), ["class_path", "name"], "left").join(self._loose_below(), "class_path", "left")
        else:
            rows = rows.withColumns({"__below": F.lit(None).cast("boolean"), "__loose": F.lit(None).cast("boolean")})
        on_self = F.col("recv_kind").isin("implicit", "self")
        verdict = (
            F.when(F.col("target").isNotNull(), resolve.FOUND)
            .when(F.col("recv_type") == UNTYPED, "unknown")
            .when(F.col("recv_type").contains(" | "), "unknown")
            .when(F.col("is_module").isNull(), "core")
            .when(F.coalesce("__open", F.lit(False)) | F.coalesce("__every", F.lit(False)), resolve.INCONCLUSIVE)
            .when(on_self & (F.col("is_module") | F.coalesce("__below", "__loose", F.lit(False))), resolve.INCONCLUSIVE)
            .when(on_self & F.col("name").isin(*core.KERNEL_FUNCTIONS), resolve.INCONCLUSIVE)
            .when(~is_class & F.col("is_module"), resolve.INCONCLUSIVE)
            .otherwise(resolve.NOT_FOUND)
        )
        rows = rows.withColumn("verdict", verdict).drop("__open", "__every", "__below", "__loose")
        said = self.declared(rows.filter(F.col("verdict").isin(resolve.NOT_FOUND, resolve.INCONCLUSIVE)))
        if said is None:
            return cut(rows.withColumn("declared_tier", F.lit(None).cast("int")), "sites")
        rows = rows.join(said.select("class_path", "name", "singleton", F.col("tier").alias("declared_tier")), ["class_path", "name", "singleton"], "left")
        # What is declared is never missing.
        told = F.col("declared_tier").isNotNull() & (F.col("verdict") == resolve.NOT_FOUND)
        return cut(rows.withColumn("verdict", F.when(told, resolve.INCONCLUSIVE).otherwise(F.col("verdict"))), "sites")

    @cached_property
    def _every(self) -> DataFrame:
        """(name, singleton): answered by every object, or every class object."""
        names_ = [(x, False) for x in [*core.OBJECT_METHODS, *core.MOCK_METHODS]] + [(x, True) for x in {*core.OBJECT_METHODS, *core.MOCK_METHODS, *core.CLASS_METHODS}]
        top = self.methods.filter("class_path in ('Object', 'Kernel', 'BasicObject') and not singleton").select("name", F.explode(F.array(F.lit(False), F.lit(True))).alias("singleton"))
        loose = self.anywhere.filter("kind = 'module'")
        modules = self.to_class(loose).select("class_path").distinct()
        both = F.explode(F.array(F.lit(False), F.lit(True))).alias("singleton")
        added = self.methods.join(modules, "class_path", "left_semi").select("name", both).unionAll(self.anywhere.filter("kind = 'name'").select("name", both))
        return cut(self.spark.createDataFrame(names_, "name string, singleton boolean").unionAll(top).unionAll(added).distinct(), "answered")

    def _answered(self) -> DataFrame:
        return small(self._every).withColumn("__every", F.lit(True))

    def _below(self, asked: DataFrame) -> DataFrame:
        """The ``asked`` (class_path, name) that some descendant answers, by itself or through what it mixes in."""
        m = self.methods.filter("not singleton").select(F.col("class_path").alias("at"), "name").distinct().join(small(cut(asked.select("name").distinct(), "asked-names")), "name", "left_semi")
        has = self.mro.select("root", F.col("node").alias("at")).join(m, "at").select("root", "name").distinct()
        under = self.mro.filter("root <> node").select("root", F.col("node").alias("class_path")).join(small(cut(asked.select("class_path").distinct(), "asked-classes")), "class_path", "left_semi")
        return under.join(has, "root").join(asked, ["class_path", "name"], "left_semi").select("class_path", "name").distinct().withColumn("__below", F.lit(True))

    def _loose_below(self) -> DataFrame:
        """(class_path): classes with a descendant that is not closed."""
        return _ranks(self.orders.join(small(self.incomplete).select(F.col("class_path").alias("root")), "root", "left_semi")).filter("root <> node").select(F.col("node").alias("class_path")).distinct().withColumn("__loose", F.lit(True))

    # -- diagnostics ------------------------------------------------------
    @cached_property
    def diagnostics(self) -> DataFrame:
        """(path, line, column, start, end, code, severity, message, suggestion); a relation, so without an order: the reports sort by (path, start, code)."""
        from factloom.plans import diagnose

        return diagnose.all_of(self)


_union = terms.union


def _ranks(orders: DataFrame) -> DataFrame:
    return orders.select("root", F.posexplode("nodes").alias("rank", "node")).select("root", "node", (F.col("rank").cast("long") + 1).alias("rank"))


def _reads_content(rule, block) -> F.Column:
    """Is the call in the shape in which its rule tells the result by what collections hold?"""
    shown = ~F.col("shape").contains("x") | rule.isin("keys", "values")
    fits = block.isNull() | (block == F.col("shape").startswith("b"))
    return rule.isin(*core.BY_CONTENT) & shown & fits & ((rule != "elem") | (F.size("given") == 0))


def _core_result() -> F.Column:
    """The result of a call on a core value by the rule of its method; null while an argument it reads is not known yet, or where another query tells it."""
    recv, rule, arg, n = F.col("recv"), F.col("core"), F.col("arg_type"), F.size("given")
    block, hidden = F.col("shape").startswith("b"), F.col("shape").contains("x")
    literal = F.expr("try_cast(substring_index(shape, ':', -1) as bigint)")
    no = F.lit(None).cast("string")
    # A missing argument is unknown for good; one without a type yet is waited for.
    waits = (n > 0) & arg.isNull() & (F.coalesce("arg", F.lit("")) != "")
    both = F.col("base").isin("Integer", "Float") & arg.isin("Integer", "Float")
    number = F.when(both, F.when((F.col("base") == "Float") | (arg == "Float"), "Float").otherwise("Integer")).otherwise(UNTYPED)
    power = F.when((F.col("base") == "Integer") & (arg == "Integer") & (literal >= 0), "Integer").when((F.col("base") == "Float") & (arg == "Integer"), "Float").otherwise(UNTYPED)
    digits = F.when(n == 0, "Integer").when((n == 1) & (arg == "Integer") & literal.isNotNull(), F.when(literal > 0, "Float").otherwise("Integer")).otherwise(UNTYPED)
    clamped = F.when((n != 2) | F.array_contains("given", ""), UNTYPED).when(F.col("bounds"), "Integer").when(~F.col("bounds"), UNTYPED)
    return (
        F.when(_reads_content(rule, F.col("holds")), no)
        .when(F.col("holds").isNotNull() & (F.col("holds") != block), UNTYPED)
        .when(rule == "self", recv)
        .when(hidden & rule.isin(*core.BY_ARGUMENTS), UNTYPED)
        .when(rule == "flatten", terms.flattened(recv, n == 0))
        .when(rule == "gsub", F.when((n == 1) & ~block, UNTYPED).otherwise("String"))
        .when(rule == "clamp", clamped)
        .when(rule.isin("number", "power", "digits", "elem") & waits, no)
        .when(rule == "number", number)
        .when(rule == "power", power)
        .when(rule == "digits", digits)
        .when(rule == "elem", F.when((n == 1) & (arg == "Integer"), recv).otherwise(UNTYPED))
        .otherwise(F.coalesce(rule, F.lit(UNTYPED)))
    )
