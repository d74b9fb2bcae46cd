"""An editor session as a stream: messages in, diagnostics of each revision and answers to requests out.

Messages are rows (seq, kind, path, version, text, request_id, line, character): ``open`` and
``change`` carry the whole text, ``close`` ends a file, ``cancel`` withdraws a request;
``diagnostics``, ``definition`` and ``hover`` ask about a path and, the last two, a position
(from 0, in UTF-16 units).  The state is the latest text of each open file: one table
for each micro-batch in the shared folder, named by the batch.  A batch reads the table of the one
before it, so a session that starts again from the stream's checkpoint goes on where it was, and
a batch that is run twice writes the same table.  Each batch folds its messages in (the
highest version wins) and asks again only the files that depend on what changed
(:mod:`factloom.plans.increment`); a file's earlier findings stand until then.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import sequence
from factloom.plans import navigate, report
from factloom.plans.increment import Incremental
from factloom.plans.program import Program
from factloom.plans.tables import drop_path, reader, shared_dir

MESSAGES = "seq long, kind string, path string, version long, text string, request_id string, line long, character long"


def fold(state: DataFrame | None, messages: DataFrame) -> DataFrame:
    """(path, version, seq, text, open): the last message of each file by (version, seq); a close always wins over what came before it."""
    new = messages.filter("kind in ('open', 'change', 'close')").select("path", F.coalesce("version", F.lit(0).cast("long")).alias("version"), "seq", F.when(F.col("kind") != "close", F.col("text")).alias("text"), (F.col("kind") != "close").alias("open"))
    rows = new if state is None else state.select("path", "version", "seq", "text", "open").unionByName(new)
    shut = rows.filter("not open").groupBy("path").agg(F.max("seq").alias("shut"))
    live = rows.join(shut, "path", "left").filter("shut is null or seq >= shut").drop("shut")
    return sequence.latest(live, ["path"], ["version", "seq"]) if state is None else sequence.latest(live.withColumn("rank", F.when(F.col("open"), F.col("version")).otherwise(-1)), ["path"], ["rank", "seq"]).drop("rank")


def pending(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests nobody has cancelled."""
    cancelled = messages.filter("kind = 'cancel'").select("request_id").distinct()
    return requests.join(cancelled, "request_id", "left_anti")


def normal_path(path) -> F.Column:
    """A path without ``.``, ``..`` and doubled slashes, by its text alone; ``..`` at the root stays at the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def contained(path, root: str) -> F.Column:
    """Is the path the root or below it, once both are normal?"""
    top = normal_path(F.lit(root))
    return (top == F.lit("/")) | (normal_path(path) == top) | normal_path(path).startswith(F.concat(top, F.lit("/")))


def answers(program: Program, requests: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """(request_id, kind, path, line, character, answer): a definition's place and name, or a type; null where nothing is known.

    ``diagnostics`` are the program's unless given: a program of some files alone has not all of them.
    """
    at = requests.filter("kind in ('definition', 'hover')").select("request_id", "kind", "path", (F.col("line") + 1).alias("line"), (F.col("character") + 1).alias("column"))
    places = at.select("path", "line", "column").distinct()
    where = navigate.definition(program, places).select("path", "line", "column", F.lit("definition").alias("kind"), F.concat_ws(" ", "def_path", F.col("def_start").cast("string"), "name").alias("answer"))
    what = navigate.hover(program, places).select("path", "line", "column", F.lit("hover").alias("kind"), F.col("type").alias("answer"))
    got = at.join(where.unionByName(what).filter("answer is not null and answer <> ''"), ["path", "line", "column", "kind"], "left")
    pulled = requests.filter("kind = 'diagnostics'").select("request_id", "kind", "path")
    found = report.editor(program.diagnostics if diagnostics is None else diagnostics).groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "character", "severity", "code", "message")))).alias("answer"))
    pulled = pulled.join(found, "path", "left").select("request_id", "kind", "path", F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("character"), F.coalesce("answer", F.lit("[]")).alias("answer"))
    return got.select("request_id", "kind", "path", (F.col("line") - 1).alias("line"), (F.col("column") - 1).alias("character"), "answer").unionByName(pulled)


class Session:
    """Handles micro-batches; ``publish(batch, diagnostics)`` gets (path, version, diagnostics...) rows, ``answer(batch, rows)`` what requests asked for.

    ``name`` is the folder of the session's states below the shared one; only paths below ``root`` count, where it is given.
    """

    def __init__(self, spark: SparkSession, project: DataFrame | None, publish: Callable[[int, DataFrame], None], answer: Callable[[int, DataFrame], None] | None = None, name: str | None = None, root: str | None = None):
        self.spark, self.project, self.publish, self.answer, self.root = spark, project, publish, answer, root
        self.folder = f"{shared_dir(spark)}/factloom/{name or 'session-' + uuid.uuid4().hex}"
        self.tables = Incremental(spark, self.folder + "-tables")

    def _at(self, batch: int) -> str:
        return f"{self.folder}/batch={batch}"

    def before(self, batch: int) -> DataFrame | None:
        """The state that the batch before this one left, if any."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(batch - 1) + "/_SUCCESS")
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return reader(self.spark, self.folder).parquet(self._at(batch - 1)) if there else None

    def __call__(self, messages: DataFrame, batch: int) -> None:
        if self.root is not None:
            messages = messages.filter(F.col("path").isNull() | contained(F.col("path"), self.root))
        before = self.before(batch)
        fold(before, messages).write.mode("overwrite").parquet(self._at(batch))
        state = reader(self.spark, self.folder).parquet(self._at(batch))
        live = state.filter("open").select("path", "text")
        if self.project is not None:
            live = live.unionByName(self.project.join(live, "path", "left_anti").select("path", "text"))
        touched = messages.filter("kind in ('open', 'change', 'close')").select("path").distinct()
        # A closed file is again as the project has it, or gone.
        self.tables.update(batch, live if before is None else touched.join(live, "path", "left"))
        # The state before the last one is needed by no batch that could be run again.
        drop_path(self.spark, self._at(batch - 2))
        found = self.tables.diagnostics(batch)
        # Every open file is published anew; a closed or clean one with no rows says so by a null code.
        out = touched.unionByName(state.filter("open").select("path")).distinct().join(state.select("path", "version"), "path", "left")
        shown = found.join(state.filter("open").select("path"), "path", "left_semi")
        self.publish(batch, out.join(shown, "path", "left"))
        if self.answer is not None:
            # Edits count first, and a cancelled request is not answered.
            asked = pending(messages.filter("kind in ('diagnostics', 'definition', 'hover')"), messages)
            program = self.tables.program(batch, asked.filter("path is not null"))
            self.answer(batch, answers(program, asked, found))


def run(spark: SparkSession, folder: str, checkpoint: str, publish: Callable[[int, DataFrame], None], project: DataFrame | None = None, answer: Callable[[int, DataFrame], None] | None = None, root: str | None = None):
    """A streaming query over JSON message files in ``folder``; stops by itself when they are all read.

    The states belong to the checkpoint, so a query that starts from it again finds them.
    """
    stream = spark.readStream.schema(MESSAGES).json(folder)
    session = Session(spark, project, publish, answer, "session-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16], root)
    return stream.writeStream.foreachBatch(session).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
