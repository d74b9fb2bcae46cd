"""Near-duplicate join of word shingles by chosen paths.

Texts that are equal form a class; each class is represented once.  Its shingles
(``SHINGLE`` words; a shorter text is one shingle) are embedded in ``COORDS``
min-wise hashes.  A run of the join grows paths: a node picks one or two sampled
coordinates (1 / ``THRESHOLD`` on average), and classes that share the value of a
picked coordinate go on to the same child.  A node of at most ``LIMIT`` classes is a
bucket and is compared by brute force; a larger one is split further.  Runs are
repeated until a pair at the threshold is found with probability ``RECALL``: the
first runs cover all classes, the others those that were in a node that had to be
split (only their paths are longer, and may part).  All paths have at least
``SHALLOWEST`` steps.

A large node that keeps most of the classes of the node above it is
not split on: its classes are alike, and all become candidates of the least one.

The buckets' comparisons of hashes give candidates, as a forest in each bucket, never
as pairs.  Candidates that hang together are compared by their exact shingle sets,
in square blocks of bounded size, so every link within such a cluster is counted
once and exactly, however many classes are alike.  Copies are not expanded.

Null and empty texts are one class without links; repeated rows share a class.
Words are runs of digits, ASCII letters and non-ASCII characters, lower-cased.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDS, LIMIT, SHALLOWEST, DEEPEST, FIRST_RUNS = 48, 512, 2, 8, 6
#: A large node that keeps this share of the node above it is dense.
DENSE = 0.7
#: Equal coordinates that make a candidate: four deviations below the threshold's mean.
LEAST_EQUAL = math.floor(COORDS * THRESHOLD - 4 * math.sqrt(COORDS * THRESHOLD * (1 - THRESHOLD)))
#: Classes, and shingles, of a block of the exact comparison.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000
_FOLD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_MIX = np.random.default_rng(20).integers(1, 1 << 63, (2, max(COORDS, 16)), dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MIX[1, 0] + w[i : len(w) - k + 1 + i] * _MIX[1, i + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minima(sh: np.ndarray) -> list[int]:
    return [int((sh * m >> np.uint64(33)).min()) for m in _MIX[0, :COORDS]]


def digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _survival(depth: int, alike: float = THRESHOLD) -> float:
    """Probability that a pair of that similarity shares a node at the depth, in one run."""
    q, second = 1.0, 1 / THRESHOLD - 1
    for _ in range(depth):
        q = 1 - (1 - alike * q) * (1 - second * alike * q)
    return q


def runs_needed(depth: int, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - _survival(depth)))


def _coordinates(run: int) -> list[int]:
    return np.random.default_rng(1000 + run).permutation(COORDS).tolist()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, digest, n, sig, packed) of every row; packed: 16 bits of each coordinate, for comparing within buckets."""
    import pyarrow as pa

    src = docs.select(base.column(doc_id).alias("id"), base.column(text).alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType())])

    def run(batches):
        base.claim("jaccard", _WORDS.clear)
        for b in batches:
            d, n, sig, packed = [], [], [], []
            for t in b.column(1):
                t = t.as_py()
                s = shingles(t)
                d.append(digest(t))
                n.append(len(s))
                sig.append(minima(s) if len(s) else None)
                packed.append((np.array(sig[-1]) & 0xFFFF).astype(np.uint16).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32())), pa.array(packed, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def _children(nodes: DataFrame, depth: int, runs: list[int]) -> DataFrame:
    """From (digest, run, node, sig): the nodes of the next depth, with sig.  A node's second pick is drawn by its own name."""
    first, second = ({r: _coordinates(r)[2 * depth + k] for r in runs} for k in (0, 1))

    def value(pick: dict[int, int]):
        index = F.element_at(F.create_map(*[x for r, c in pick.items() for x in (F.lit(r), F.lit(c))]), F.col("run"))
        return F.xxhash64("node", index, F.element_at("sig", index + 1))

    twice = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1000)) < round(1000 * (1 / THRESHOLD - 1))
    kids = F.when(twice, F.array(value(first), value(second))).otherwise(F.array(value(first)))
    return nodes.select("digest", "run", "sig", "above", F.explode(kids).alias("node"))


def _tree(classes: DataFrame, runs: list[int], label: str) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Buckets (digest, node) of all depths, digests of split nodes, and the depth reached."""
    roots = classes.filter("sig is not null").select("digest", "sig", F.lit(None).cast("long").alias("above"), F.explode(F.array(*map(F.lit, runs))).alias("run"))
    level = roots.withColumn("node", F.xxhash64(F.lit("root"), F.col("run")))
    # The first picks need no look at the sizes: few texts share two coordinates that are not alike.
    for depth in range(SHALLOWEST):
        level = _children(level, depth, runs)
    buckets, split, depth = [], None, SHALLOWEST
    while True:
        level = base.cut(level.select("digest", "run", "node", "above"), f"{label}-level{depth}")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        met = base.cut(level.join(sizes, "node"), f"{label}-met{depth}")
        base.drop(level)
        # Most of such a node came down together: its classes are alike, and more picks would not part them.
        dense = F.col("size") >= DENSE * F.col("above") if depth < DEEPEST else F.lit(True)
        dense = (F.col("size") > LIMIT) & F.coalesce(dense, F.lit(False))
        least = met.filter(dense).groupBy("node").agg(F.min("digest").alias("least"))
        buckets.append(met.filter(F.col("size") <= LIMIT).select("digest", "node", F.lit(None).cast("binary").alias("least")))
        buckets.append(met.filter(dense).join(least, "node").select("digest", "node", "least"))
        large = met.filter((F.col("size") > LIMIT) & ~dense)
        if not large.limit(1).count():
            return buckets, split, depth
        own = large.select("digest").distinct()
        split = own if split is None else split.unionAll(own).distinct()
        level = _children(large.select("digest", "run", "node", F.col("size").alias("above")).join(classes.select("digest", "sig"), "digest"), depth, runs)
        depth += 1


def _grouped(rows: DataFrame, keys: list[str], out: str, handle) -> DataFrame:
    """``handle(list of row tuples)`` for each group of ``keys``; groups are streamed, so only one is in memory."""
    import pyarrow as pa

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    k = len(keys)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        base.claim("groups")
        arrow = to_arrow_schema(_schema(out))
        group, key, got = [], None, []

        def flush():
            b = pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in got], schema=arrow)
            got.clear()
            return b

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if row[:k] != key:
                    if group:
                        got += handle(group)
                    group, key = [], row[:k]
                    if len(got) > 5000:
                        yield flush()
                group.append(row[k:])
        if group:
            got += handle(group)
        if got:
            yield flush()

    return dealt.mapInArrow(run, _schema(out))


def _schema(text: str) -> T.StructType:
    kinds = {"binary": T.BinaryType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _compare_bucket(rows: list[tuple]) -> list[tuple]:
    """Candidates of a bucket, as (class, least class of its tree)."""
    rows = sorted({r[0]: r for r in rows}.values())
    x = np.array([np.frombuffer(r[1], np.uint16) for r in rows])
    equal = np.zeros((len(x), len(x)), np.int16)
    for c in range(x.shape[1]):
        equal += x[:, c][:, None] == x[:, c]
    forest = _Forest(len(x))
    for a, b in zip(*np.nonzero(np.triu(equal >= LEAST_EQUAL, 1)), strict=True):
        forest.join(int(a), int(b))
    return [(r[0], rows[forest.root(i)][0]) for i, r in enumerate(rows) if forest.root(i) != i]


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root): the least node of each connected component, by alternating large and small stars.

    ``edges``: columns a, b.  Every round cuts the lineage at shared tables; nothing is collected.
    Least neighbours are aggregated to a table of their own: the join with them then has plain
    exchanges on both sides, which the engine splits where a node has very many neighbours.
    """
    e = base.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    one, no = F.lit(1), F.lit(0)
    while True:
        # A forest of stars is the end: no node has two roots, and none is both a child and a root.
        ends = e.select("a", one.alias("up"), no.alias("down")).unionAll(e.select("b", no, one))
        if not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = base.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        # An edge goes from its greater end to its lesser one, so the greater ends of e are the neighbours above b.
        large = e.select(F.col("b").alias("a"), F.col("a").alias("c")).join(least, "a").select(F.col("c").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = base.cut(star, label)
        base.drop(e)
        base.drop(least)
        e = new


def _compare_block(rows: list[tuple]) -> list[tuple]:
    """Exact links of one block of a cluster: (class, links, least linked class of its tree)."""
    first = rows[0]
    same = first[0] == first[1]
    rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: (r[2], r[3]))
    n, left = len(rows), sum(r[2] == first[0] for r in rows)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2 or (not same and not 0 < left < n):
        return []
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(at, minlength=len(token)) > 1
    slot = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], slot[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        x = np.zeros((n, min(4096, int(shared.sum()) - lo)), np.float32)
        x[owner[i:j], at[i:j] - lo] = 1
        both += x @ x.T
    # J >= t without rounding: the union is whole, and 5 * both >= 4 * union for t = 4 / 5
    up, down = (THRESHOLD).as_integer_ratio() if THRESHOLD != 0.8 else (4, 5)
    common = both.astype(np.int64)
    link = down * common >= up * (sizes[:, None] + sizes - common)
    if same:
        np.fill_diagonal(link, False)
    else:
        link[:left, :left] = link[left:, left:] = False
    forest = _Forest(n)
    by_class = sorted(range(n), key=lambda i: rows[i][3])
    rank = {i: k for k, i in enumerate(by_class)}
    for a, b in zip(*np.nonzero(np.triu(link)), strict=True):
        forest.join(rank[int(a)], rank[int(b)])
    links = link.sum(1)
    return [(r[3], int(links[i]), rows[by_class[forest.root(rank[i])]][3]) for i, r in enumerate(rows) if links[i]]


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(digest, shingles) of the texts of ``wanted`` classes; texts are screened before anything is shuffled."""
    import pyarrow as pa

    shared = base.share(docs.sparkSession, base.Bloom.of(wanted.select(F.hex("digest").alias("d")), "d"))

    def run(batches):
        known = shared.value
        base.claim("jaccard", _WORDS.clear)
        for b in batches:
            d, s = [], []
            for t in b.column(0):
                t = t.as_py()
                key = digest(t)
                if key.hex().upper() in known:
                    d.append(key)
                    s.append(shingles(t).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(s, pa.binary())], names=["digest", "set"])

    return docs.select(base.column(text)).mapInArrow(run, "digest binary, set binary")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``class_id`` (least id of the equal texts), ``copies``, ``n_links`` (other classes at the
    threshold) and ``group_id`` (least id of all that links connect) of every row."""
    base.ship(docs.sparkSession)
    rows = base.cut(_signatures(docs, doc_id, text), "jaccard-rows")
    classes = base.cut(rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("packed").alias("packed")), "jaccard-classes")
    buckets, split, depth = _tree(classes, list(range(FIRST_RUNS)), "jaccard-a")
    done = FIRST_RUNS
    while split is not None and (more := runs_needed(depth)) > done:
        deep = base.cut(classes.join(split, "digest", "left_semi"), "jaccard-deep")
        again, _, deeper = _tree(deep, list(range(done, more)), "jaccard-b")
        buckets, done, depth = buckets + again, more, max(depth, deeper)
    leaves = buckets[0]
    for b in buckets[1:]:
        leaves = leaves.unionAll(b)
    leaves = base.cut(leaves, "jaccard-leaves")
    far = leaves.filter("least is not null and least <> digest").select(F.col("digest").alias("a"), F.col("least").alias("b"))
    near = leaves.filter("least is null").join(classes.select("digest", "packed"), "digest").select("node", "digest", "packed")
    found = _grouped(near, ["node"], "a binary, b binary", _compare_bucket)
    clusters = components(found.unionAll(far), "jaccard-candidates")
    member = clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct()).join(classes.select(F.col("digest").alias("node"), "n"), "node")
    size = member.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    member = base.cut(member.join(size, "root").select("node", "root", blocks.alias("blocks")), "jaccard-members")
    sets = _sets(docs, member.select(F.col("node").alias("digest")), text).withColumnRenamed("digest", "node").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    dealt = member.join(sets, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.least("own", "other").alias("p1"), F.greatest("own", "other").alias("q1"), "own", "node", "set")
    links = base.cut(_grouped(pairs, ["root", "p", "q"], "node binary, links long, least binary", _compare_block), "jaccard-links")
    groups = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")), "jaccard-groups")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select(F.col("digest").alias("node"), "class_id", "copies").join(total, "node", "left").join(groups, "node", "left")
    named = base.cut(named.select("node", "class_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "node").alias("root")), "jaccard-named")
    least = named.filter("n_links > 0").groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = named.join(least, "root", "left").select(F.col("node").alias("digest"), "class_id", "copies", "n_links", F.coalesce("group_id", "class_id").alias("group_id"))
    return rows.select("id", "digest").join(named, "digest").select("id", "class_id", "copies", "n_links", "group_id")


def _repeated(found: DataFrame) -> bool:
    """Does an id stand in more than one row?"""
    return bool(found.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group; rows without an id stay.

    Of rows that repeat an id, those of one class count as one and those of other classes on their own.
    The columns of ``docs`` may have any names.
    """
    h = base.Held(docs, docs.columns, (), key=doc_id, t=text)
    found = base.cut(join(h.rows, "key", "t"), "jaccard-found")
    kept = found.filter("id = group_id").select("id").distinct()
    # Fewer go than stay, so the join is on those that go, and only rows that may be among them are shuffled.
    gone = base.cut(found.filter("id is not null").select("id").distinct().join(kept, "id", "left_anti").select(F.col("id").alias("key")), "jaccard-gone")
    bloom = base.Bloom.of(gone, "key")
    out = base.sift(h.rows, "key", bloom, False).unionByName(base.sift(h.rows, "key", bloom, True).join(gone, "key", "left_anti"))
    if _repeated(found):
        once = out.withColumn("mark", F.xxhash64(F.coalesce("t", F.lit(""))))
        out = once.filter("key is not null").dropDuplicates(["key", "mark"]).unionByName(once.filter("key is null")).drop("mark")
    return h.named(out)
