"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of order ``ORDER``: counts of the
bytes seen after each context.  With frozen counts, a byte costs its probability
in the longest known context; an unseen one pays the escape (method C: as many
escapes as distinct bytes) and is tried in the next shorter context, down to the
uniform order -1.  The code length of a text is exact: the sum over all of its
bytes, each with its full context (shorter at the start).  The language with the
shortest code wins; ties go to the first name.

The trees of all languages are arrays over the union of their contexts, so a
batch of texts is scored by table look-ups.

Texts are lower-cased, digits become ``0`` and white space one space, before
bytes are taken.  Null texts and texts with no letter are ``und`` (score 0).
Fitting uses a bounded sample of rows per language, chosen by a hash of the id; whole
texts are counted, in the executors.  All languages are learned: trees are made for
``GROUP`` of them at a time, and code lengths do not depend on the grouping.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

ORDER = 3
#: Rows expected per language in the training sample; languages whose trees share arrays.
SAMPLE_ROWS, GROUP = 400, 64
_SPACE, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")


def symbols(text: str) -> bytes:
    return _DIGIT.sub("0", " ".join(text.lower().split())).encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counted(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (of k + 1 bytes) of the contexts of order k with the byte after them, and how often each is there."""
    c, key = np.frombuffer(text, np.uint8).astype(np.int64), np.zeros(max(len(text) - k, 0), np.int64)
    for j in range(k + 1 if len(key) else 0):
        key = key * 256 + c[j : len(c) - k + j]
    return np.unique(key, return_counts=True)


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, at, np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)]))
    return keys, times


class Trees:
    """Context trees of several languages with frozen counts."""

    def __init__(self, samples: dict[str, list[str]], counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] | None = None):
        """Of sampled texts, or of their ``counted`` sums by order."""
        if counts is None:
            counts = {x: [added([counted(symbols(t), k) for t in texts]) for k in range(ORDER + 1)] for x, texts in samples.items()}
        self.langs = sorted(counts)
        self.n = n = len(self.langs)
        raw = [counts[x] for x in self.langs]
        used = sorted({int(b) for c in raw for b in c[0][0]})
        self.code = np.zeros(256, np.int64)  # 0: a byte no sample has
        self.code[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        counts = [[(self._coded(c[k][0], k), c[k][1]) for c in raw] for k in range(ORDER + 1)]
        #: For each order: sorted keys of (context, byte) over all languages, and a row of costs for each.
        self.keys, self.cost, self.ctx_keys, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[0] for c in counts[k]] or [np.zeros(0, np.int64)]))
            ctx = np.unique(keys // self.size)
            own = np.zeros((len(keys), n))
            for i, (seen, times) in enumerate(counts[k]):
                own[np.searchsorted(keys, seen), i] = times
            at = np.searchsorted(ctx, keys // self.size)
            total, kinds = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, at, own)
            np.add.at(kinds, at, own > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)  # an unknown context passes on for nothing
                cost = -np.log2(own / (total[at] + kinds[at]))
            lower = self._lookup(k - 1, keys % self.size ** max(k, 1)) if k else np.full((len(keys), n), 8.0)
            self.keys.append(keys)
            self.cost.append(np.where(own > 0, cost, escape[at] + lower).astype(np.float32))
            self.ctx_keys.append(ctx)
            self.escape.append(escape.astype(np.float32))

    def _coded(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Numbers of bytes as numbers of their codes, in the same order."""
        out = np.zeros(len(keys), np.int64)
        for j in range(k, -1, -1):
            out = out * self.size + self.code[keys >> 8 * j & 255]
        return out

    def _lookup(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Costs, by language, of (context, byte) keys of order k; order -1 is uniform."""
        if k < 0:
            return np.full((len(keys), self.n), 8.0, np.float32)
        out, have = np.empty((len(keys), self.n), np.float32), self.keys[k]
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        ok = have[at] == keys if len(have) else np.zeros(len(keys), bool)
        out[ok] = self.cost[k][at[ok]]
        if not ok.all():
            miss = keys[~ok]
            ctx, known = miss // self.size, self.ctx_keys[k]
            at = np.minimum(np.searchsorted(known, ctx), max(len(known) - 1, 0))
            paid = self.escape[k][at] * (known[at] == ctx)[:, None] if len(known) else 0
            out[~ok] = paid + self._lookup(k - 1, miss % self.size ** max(k, 1))
        return out

    def table(self) -> None:
        """Dense index from the codes of ORDER bytes to rows of the top order's contexts, made once per worker."""
        top = self.size**ORDER
        self.ctx_row = np.zeros(top, np.int32)
        ctx = self.ctx_keys[ORDER]
        self.ctx_row[ctx] = np.arange(1, len(ctx) + 1)
        self.row = np.zeros((len(ctx) + 1) * self.size, np.int32)
        keys = self.keys[ORDER]
        self.row[self.ctx_row[keys // self.size].astype(np.int64) * self.size + keys % self.size] = np.arange(1, len(keys) + 1)
        self.padded = np.vstack([np.zeros((1, self.n), np.float32), self.cost[ORDER]])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        if not hasattr(self, "row"):
            self.table()
        out = np.zeros((len(texts), self.n))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return out
        c = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        start = np.cumsum(sizes) - sizes
        offset = np.arange(len(c)) - np.repeat(start, sizes)
        full = np.flatnonzero(offset >= ORDER)
        ctx = np.zeros(len(full), np.int64)
        for j in range(ORDER, 0, -1):
            ctx = ctx * self.size + c[full - j]
        row = self.row[self.ctx_row[ctx].astype(np.int64) * self.size + c[full]]
        cost = np.zeros((len(c), self.n), np.float32)
        cost[full] = self.padded[row]
        miss = row == 0
        cost[full[miss]] = self._lookup(ORDER, ctx[miss] * self.size + c[full[miss]])
        for k in range(ORDER):  # the first bytes have shorter contexts
            at = np.flatnonzero(offset == k)
            key = np.zeros(len(at), np.int64)
            for j in range(k, -1, -1):
                key = key * self.size + c[at - j]
            cost[at] = self._lookup(k, key)
        some = np.flatnonzero(sizes > 0)
        out[some] = np.add.reduceat(cost, start[some], axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its share of the evidence: the posterior of equal priors at the mean cost of 40 bytes."""
        data = [symbols(t) if t else b"" for t in texts]
        bits = self.lengths(data)
        ok = [has_letter(t) for t in texts]
        sizes = np.maximum([len(d) for d in data], 1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(sizes, 40) / sizes)[:, None] if self.n else bits
        score = 1 / np.exp2(-gap).sum(axis=1) if self.n else np.zeros(len(texts))
        best = bits.argmin(axis=1) if self.n else []
        return [self.langs[b] if o and self.n else "und" for b, o in zip(best if self.n else [0] * len(ok), ok, strict=True)], [float(s) if o and self.n else 0.0 for s, o in zip(score, ok, strict=True)]


class Forest(Trees):
    """Trees of any number of languages, ``GROUP`` at a time."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(counts)
        self.n = len(self.langs)
        self.groups = [Trees({}, {x: counts[x] for x in self.langs[i : i + GROUP]}) for i in range(0, self.n, GROUP)]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.hstack([np.zeros((len(texts), 0)), *(g.lengths(texts) for g in self.groups)])


def fit(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_ROWS) -> Forest:
    """Trees of all languages, from about ``per_language`` rows of each."""
    import pyarrow as pa

    base.ship(rows.sparkSession)
    seen = rows.select(base.column(doc_id).alias("id"), base.column(lang).alias("lang"), base.column(text).alias("text")).filter("lang is not null and text is not null")
    # A row is in the sample when the hash of its id falls below its language's rate; no order or limit is needed.
    rate = seen.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("rate"))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for b in batches:
            found: dict[tuple[str, int], list] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = symbols(t)
                for k in range(ORDER + 1):
                    found.setdefault((x, k), []).append(counted(data, k))
            for (x, k), own in found.items():
                # A row of count 0 keeps a language whose texts are empty.
                keys, times = added([*own, (np.zeros(1, np.int64), np.zeros(1, np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array([k] * len(keys), pa.int32()), pa.array(keys), pa.array(times)], names=["lang", "k", "key", "n"])

    some = seen.join(F.broadcast(rate), "lang").filter(draw < F.col("rate")).select("lang", "text")
    # Bounded for each language by its sample and the number of contexts of ORDER bytes.
    got = some.mapInArrow(run, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    own, order, keys, times = names.indices.to_numpy(zero_copy_only=False), *(got.column(c).to_numpy() for c in ("k", "key", "n"))
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, x in enumerate(names.dictionary.to_pylist()):
        at = [np.flatnonzero((own == i) & (order == k) & (times > 0)) for k in range(ORDER + 1)]
        counts[x] = [added([(keys[a], times[a])]) for a in at]
    return Forest(counts)


def identify(docs: DataFrame, trees: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of each whole text."""
    import pyarrow as pa

    base.ship(docs.sparkSession)
    h = base.Held(docs, keep, ("lang_pred", "score"), prefix, t=text)
    shared, through, at = base.share(docs.sparkSession, trees), h.through, h.at["t"]
    schema = h.schema(T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))

    def run(batches):
        base.claim("language")
        model = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores, lo = [], [], 0
            while lo < len(texts):  # about 0.4 MB at a time; a longer text is alone
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < 400_000):
                    size += len(texts[hi] or "")
                    hi += 1
                got = model.predict(texts[lo:hi])
                langs += got[0]
                scores += got[1]
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in through), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))
