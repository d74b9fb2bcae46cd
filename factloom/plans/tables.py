"""Tables in the shared folder: how long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, as in tests, gets a folder of its own where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-shared-"))
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


#: How many times its bytes a Parquet file of names and keys is taken to be as rows (a cautious guess), and what a join may send to the driver as rows.
ESTIMATES = {"spark.sql.sources.fileCompressionFactor": "100.0", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}


def estimate(spark: SparkSession) -> None:
    """Spark takes the bytes of a file for those of its rows and would broadcast, through the driver, tables several times its limit; what the user has set stays."""
    have = spark.conf.getAll
    for key, value in ESTIMATES.items():
        if key not in have:
            spark.conf.set(key, value)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write and read again as Parquet: later readers prune columns, and lost executors lose nothing."""
    log = Log(df.sparkSession, label)
    log.append(df)
    return log.frame()


def drop_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made here; only for tables nothing reads any more."""
    for path in getattr(df, "_factloom_paths", ()):
        drop_path(df.sparkSession, path)


#: Rows of names that a join may broadcast.
FEW = 10_000


def small(df: DataFrame) -> DataFrame:
    """A table made here, for the side of a join that is read whole: broadcast where it has few rows, so that the other side need not be shuffled."""
    return F.broadcast(df) if df.count() <= FEW else df


def together(*jobs):
    """The results of independent jobs, run at the same time: each is small for a cluster, and most of its time is latency."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(job)) for job in jobs]]


class Log:
    """A table that grows by whole files: what is there is never written again."""

    def __init__(self, spark: SparkSession, label: str):
        estimate(spark)
        self.spark, self.base, self.paths, self.schema = spark, f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}", [], None

    def append(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns them as a table."""
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        return self._read([path])

    def frame(self) -> DataFrame:
        return self._read(self.paths)

    def _read(self, paths: list[str]) -> DataFrame:
        out = reader(self.spark, self.base).schema(self.schema).parquet(*paths)
        out._factloom_paths = list(paths)  # noqa: SLF001 - for drop()
        return out


def reader(spark: SparkSession, path: str):
    """A reader for Parquet files; from a local file system without vectored reads, which keep a direct buffer in every thread that serves one."""
    sc = spark.sparkContext
    scheme = sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration()).getScheme()
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false") if scheme == "file" else spark.read


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return reader(spark, path).parquet(path)
