"""Exact centroid clustering of integer vectors, screened in float32.

Components are floor(``SCALE`` * x), so that distances and means are whole numbers and the result does not
depend on the order of rows, the number of tasks or the library that multiplies matrices.

Assignment: one float32 matrix product gives all inner products of a batch with all centroids.  Whatever the order of its
additions, the error of an inner product of d terms is at most gamma(d + 2) |x| |c| (d additions and products,
and the rounding of both factors), which bounds every squared distance by an interval.  A centroid whose interval
lies above the least upper end cannot be nearest.  Where one is left it is the nearest; where intervals overlap,
the distances of those left are computed in whole numbers, ties going to the lowest number.  Vectors too large
for that (``LARGE``) are compared in whole numbers of any size.

Updates: a task adds up its vectors by centroid and gives the sums in digits of 32 bits, so that the engine can add
them exactly, whatever their size, before anything is shuffled; the driver receives centroids only.

Vectors that are null, of another number of components, or with a null or non-finite component are left out.
Equal vectors, repeated rows and repeated ids count each for itself; as first centroids, rows of equal ids come in
order of their components (a null id hashes as no digits).  Fewer vectors than centroids make fewer centroids, an
empty table no rows.  A distance or a sum beyond a long is null.  Kept columns may have any names; one of a result's
name gives way to the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: From this size of a component on, whole numbers of 64 bits do not hold a distance.
LARGE = 1 << 27
#: Rows of one matrix product.
ROWS = 4096
_MOST = (1 << 63) - 1


def gamma(terms: int) -> float:
    """Bound of the relative error of ``terms`` roundings in float32."""
    u = terms * 2.0**-24
    return u / (1 - u)


class Nearest:
    """Nearest of a few centroids (rows of Python integers), and exact distances."""

    def __init__(self, centroids: list[list[int]]):
        import numpy as np

        self.whole = [tuple(c) for c in centroids]
        self.large = any(abs(x) >= LARGE for c in centroids for x in c)
        if not self.large:
            self.ints = np.array(centroids, np.int64).reshape(len(centroids), -1)
            self.floats = np.ascontiguousarray(self.ints.T, np.float32)
            squares = (self.ints * self.ints).sum(axis=1)
            self.squares = squares.astype(np.float64)
            self.norms = np.sqrt(self.squares) * (1 + 1e-12)

    def whole_distance(self, x: list[int], k: int) -> int:
        return sum((a - b) * (a - b) for a, b in zip(x, self.whole[k], strict=True))

    def __call__(self, x):
        """Numbers of the nearest centroids of int64 rows below ``LARGE``."""
        import numpy as np

        if self.large:
            rows = x.tolist()
            return np.array([min(range(len(self.whole)), key=lambda k: (self.whole_distance(r, k), k)) for r in rows], np.int64)
        d = x.shape[1]
        products = (x.astype(np.float32) @ self.floats).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        # Distances less |x|^2, which all centroids share; the last term covers the float64 steps.
        middle = self.squares - 2 * products
        radius = 2 * gamma(d + 2) * norms[:, None] * self.norms + 1e-14 * (self.squares + norms[:, None] ** 2) + 1e-30
        low = middle - radius * (1 + 1e-9)
        best = (middle + radius * (1 + 1e-9)).min(axis=1)
        left = low <= best[:, None]
        out = left.argmax(axis=1)
        close = np.flatnonzero(left.sum(axis=1) > 1)
        if len(close):
            row, k = np.nonzero(left[close])
            gap = x[close[row]] - self.ints[k]
            exact = (gap * gap).sum(axis=1)
            order = np.lexsort((k, exact, row))
            first = order[np.r_[True, np.diff(row[order]) > 0]]
            out[close] = k[first]
        return out

    def distances(self, x, k):
        """Exact squared distances of int64 rows below ``LARGE`` to their centroids."""
        if self.large:
            return [self.whole_distance(r, c) for r, c in zip(x.tolist(), k.tolist(), strict=True)]
        gap = x - self.ints[k]
        return (gap * gap).sum(axis=1).tolist()


def _blocks(column, dimensions: int, scale: int):
    """Whole-number rows of a list column, a block at a time: place, int64 rows, which of them are too large, and those as Python integers."""
    import numpy as np

    for lo in range(0, len(column), ROWS):
        part = column.slice(lo, ROWS)
        with np.errstate(over="ignore"):
            x = np.floor(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions) * scale)
        large = (np.abs(x) >= LARGE).any(axis=1)
        yield lo, np.where(large[:, None], 0, x).astype(np.int64), large, {int(i): _whole(part[int(i)].as_py(), scale) for i in np.flatnonzero(large)}


def _whole(row: list[float], scale: int) -> list[int]:
    """floor(scale * x) of any finite size."""
    out = []
    for x in row:
        n, d = float(x).as_integer_ratio()
        out.append(n * scale // d)
    return out


def kept(vectors: DataFrame, column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows whose vector has the right number of components, all of them finite."""
    v = base.column(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(v.isNotNull() & (F.size(v) == dimensions) & fine)


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors of the least hashes of their ids; the engine keeps k rows of each task."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("i").cast("string"), F.lit(""))), 256)
    return [_whole(r.v, scale) for r in rows.select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()]


def update(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: the floors of the means of the vectors nearest to each centroid; an empty one stays."""
    import pyarrow as pa

    dimensions = len(centroids[0])
    shared = base.share(rows.sparkSession, centroids)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "d", "place", "part")])

    def run(batches):
        import numpy as np

        base.claim("centroids")
        nearest = Nearest(shared.value)
        sums, counts, extra = np.zeros((len(shared.value), dimensions), np.int64), np.zeros(len(shared.value), np.int64), {}
        for b in batches:
            for _, x, large, whole in _blocks(b.column(0), dimensions, scale):
                if not large.all():
                    k = nearest(x[~large])
                    np.add.at(sums, k, x[~large])
                    np.add.at(counts, k, 1)
                for row in whole.values():
                    k = min(range(len(nearest.whole)), key=lambda c: (nearest.whole_distance(row, c), c))
                    counts[k] += 1
                    for d, v in enumerate(row):
                        extra[k, d] = extra.get((k, d), 0) + v
        out = []
        for k in np.flatnonzero(counts).tolist():
            out.append((k, -1, 0, int(counts[k])))
            for d in range(dimensions):
                v, place = int(sums[k, d]) + extra.get((k, d), 0), 0
                sign, v = (-1, -v) if v < 0 else (1, v)
                while v:
                    out.append((k, d, place, sign * (v & 0xFFFFFFFF)))
                    v >>= 32
                    place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=schema.names)

    # At most centroids x components x digits rows reach the driver.
    got = rows.select("v").mapInArrow(run, schema).groupBy("k", "d", "place").agg(F.sum("part").alias("part")).collect()
    shared.unpersist()
    total: dict[tuple[int, int], int] = {}
    for r in got:
        total[r.k, r.d] = total.get((r.k, r.d), 0) + (r.part << 32 * r.place)
    return [[total.get((k, d), 0) // total[k, -1] for d in range(dimensions)] if (k, -1) in total else list(c) for k, c in enumerate(centroids)]


def cluster(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", keep: tuple[str, ...] = ("vec_id",), k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, prefix: str = "") -> DataFrame:
    """``keep`` columns, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector that is kept."""
    import pyarrow as pa

    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two, so that no product is rounded")
    spark = vectors.sparkSession
    base.ship(spark)
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    h = base.Held(vectors, keep, results, prefix, v=vector, i=vec_id)
    rows = kept(h.rows, "v", dimensions)
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = update(rows, centroids, scale)
    shared = base.share(spark, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    through, at = h.through, h.at["v"]
    schema = h.schema(T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()))

    def run(batches):
        base.claim("centroids")
        nearest = Nearest(shared.value)
        for b in batches:
            for lo, x, large, whole in _blocks(b.column(at), dimensions, scale):
                number = nearest(x)
                away = nearest.distances(x, number)
                for i, row in whole.items():
                    away[i], number[i] = min((nearest.whole_distance(row, c), c) for c in range(len(nearest.whole)))
                made = [pa.array(number, pa.int32()), pa.array([d if d <= _MOST else None for d in away], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, len(x)) for i in through] + made, names=schema.names)

    placed = base.cut(rows.mapInArrow(run, schema), "centroids")
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.total for r in placed.groupBy("cluster").agg(total.alias("total")).collect()}  # a row per centroid

    def whole(n):
        return F.lit(None if n is None or n > _MOST else int(n)).cast("long")

    def of(value):  # by number: one expression, no join
        return F.element_at(F.array(*(value(c) for c in range(len(centroids)))), F.col("cluster") + 1) if centroids else F.lit(None)

    every = None if None in inertia.values() else sum(inertia.values())
    out = placed.withColumn("cluster_inertia", of(lambda c: whole(inertia.get(c, 0))).cast("long")).withColumn("inertia", whole(every))
    return h.named(out.withColumn("centroid_sha256", of(lambda c: F.lit(names[c])).cast("string")))
