"""Plumbing shared by the operators: tables, checkpoints, code shipping."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
_SHIPPED: set[str] = set()
#: Rows here hold whole documents, so batches for Python are kept small: rows and bytes at most.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's own readers touch the path."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return reader(spark, path).parquet(path)


def reader(spark: SparkSession, path: str):
    """A reader for Parquet files.

    From a local file system vectored reads are turned off: each thread that serves one keeps a direct buffer as
    large as the range it read, which for long texts is hundreds of MB beside the heap.
    """
    sc = spark.sparkContext
    scheme = sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration()).getScheme()
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false") if scheme == "file" else spark.read


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers import ``factloom`` by name (so that their module-level
    caches live as long as the worker), which needs the package on their path
    even where the driver's path is not inherited.
    """
    for key, most in _BATCH.items():
        have = spark.conf.get(key).rstrip("bB")
        if have.isdigit() and not 0 < int(have) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app in _SHIPPED:
            return
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(top)
        target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}_{app}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share (``spark.checkpoint.dir``).

    Only a local session may do without: it gets a folder of its own, as in tests.  On a
    cluster every executor would write to its own disk, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage at a table that survives lost executors, and lets the
    later readers prune columns (a row checkpoint would not).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = reader(spark, path).schema(df.schema).parquet(path)
    out._factloom_path = path  # noqa: SLF001 - for drop()
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut`; only for tables nothing reads any more."""
    path = getattr(df, "_factloom_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def column(name: str):
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


class Held:
    """A table under names of our own, so that no column of it can clash with those used inside.

    ``rows`` has the kept columns as ``k0``, ``k1`` ... and the ``inputs`` (name inside = column) by
    their names; a column that is both is there once.  A kept column that has the name of a
    result (``prefix`` and one of ``results``, in any case) gives way to it.
    """

    def __init__(self, docs: DataFrame, keep, results, prefix: str = "", **inputs: str):
        taken = {(prefix + r).lower() for r in results}
        kept = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
        as_input = {c: n for n, c in reversed(inputs.items())}
        self.kept = [(c, as_input.get(c, f"k{i}")) for i, c in enumerate(kept)]
        self.results, self.prefix = results, prefix
        self.rows = docs.select(*(column(c).alias(k) for c, k in self.kept if c not in as_input), *(column(c).alias(n) for n, c in inputs.items()))
        private = {k for _, k in self.kept}
        #: Places of the kept columns in ``rows``, and of all columns.
        self.through = [i for i, c in enumerate(self.rows.columns) if c in private]
        self.at = {c: i for i, c in enumerate(self.rows.columns)}

    def schema(self, *more):
        from pyspark.sql.types import StructField, StructType

        return StructType([StructField(f.name, f.dataType) for f in (self.rows.schema.fields[i] for i in self.through)] + list(more))

    def named(self, out: DataFrame) -> DataFrame:
        """The kept columns by their own names, and the results."""
        return out.select(*(F.col(k).alias(c) for c, k in self.kept), *(F.col(r).alias(self.prefix + r) for r in self.results))


def free(columns) -> str:
    """A prefix that no column begins with."""
    out = "r_"
    while any(c.lower().startswith(out) for c in columns):
        out = "_" + out
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the decimal id mod ``folds`` equals ``fold`` (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def share(spark: SparkSession, value):
    """Broadcast a model to the Python workers (its size is bounded by its parameters)."""
    return spark.sparkContext.broadcast(value)


class Bloom:
    """A set of strings in a few bits each: never misses a member, lets some others through.

    Its size follows the number of members up to ``MOST`` bits (32 MB) and no further, so it can
    be broadcast; one that is too full lets more through.  Whoever uses it joins exactly afterwards.
    """

    LEAST, MOST, EACH = 1 << 20, 1 << 28, 64

    def __init__(self, words, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, member: str) -> bool:
        import xxhash

        h, packed, top = xxhash.xxh64_intdigest(member, seed=42), self.words, self.bits - 1
        return all(packed[p >> 3] >> (p & 7) & 1 for p in (h & top, h >> 18 & top, h >> 36 & top))

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom:
        """Built by the engine's own functions: equal places are merged in the tasks before anything is exchanged."""
        import numpy as np

        members = df.select(F.col(column).cast("string").alias("m")).filter("m is not null")
        n = members.count()
        bits = min(cls.MOST, max(cls.LEAST, 1 << (cls.EACH * max(n, 1) - 1).bit_length()))
        h = F.xxhash64("m")
        places = F.array(*(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 18, 36)))
        at = members.select(F.explode(places).alias("p"))
        got = at.groupBy(F.shiftright("p", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[got.column("k").to_numpy()] = got.column("v").to_numpy()  # at most the filter's own size
        return cls(words.tobytes(), bits)


def sift(rows: DataFrame, key: str, bloom: Bloom, members: bool) -> DataFrame:
    """The rows whose ``key`` the filter lets through, or the rest; a null key is let through by none.

    Splits a wide table before a join on a few of its rows: the rest is not shuffled.
    """
    import pyarrow as pa

    ship(rows.sparkSession)
    shared, at = share(rows.sparkSession, bloom), rows.columns.index(key)

    def run(batches):
        claim("sift")
        known = shared.value
        for b in batches:
            keep = [(k is not None and str(k) in known) is members for k in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


_CLEAR: dict[str, object] = {}


def claim(name: str, clear=lambda: None) -> None:
    """A worker process serves one operator after another: on a change, the caches of the others are emptied.

    Memory that was freed goes back to the system, as executors share their limit with the JVM.
    """
    for other in [k for k in _CLEAR if k != name]:
        _CLEAR.pop(other)()
    _CLEAR[name] = clear
    release()


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer file; ``folder`` overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["Bloom", "Held", "claim", "column", "cut", "drop", "free", "held_out", "parts", "read_table", "reader", "share", "shared_dir", "sift", "ship", "tokenizer_path"]
