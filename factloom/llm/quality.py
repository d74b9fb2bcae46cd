"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are turned into style features; the
share of positives in the unlabelled text (the class prior) is estimated from the
best-scoring bins of a first positive-against-unlabelled model; then a small
network minimises the non-negative unbiased risk

    pi E_P[loss(+)] + max(0, E_U[loss(-)] - pi E_P[loss(-)])

with the ascent step of its authors where the second part is negative.  The risk alone decides:
its boundary (logit 0) gets the score ``CUT``, all else follows by the same shift.

Features come from whole texts: shares of character classes and of neighbouring
class pairs, word and line statistics.  Null and empty texts have the zero vector
and are scored like any other.  Fitting uses bounded samples (``POSITIVES`` and
``UNLABELLED`` rows expected) drawn by a hash of the id.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

POSITIVES, UNLABELLED = 4000, 6000
#: Score at which a text is kept.
CUT = 0.3
_CLASSES = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " ", "\n", ",.", "!?", ";:", "'\"-`", "()[]{}", "|", "%$&#*@~^", "=+<>\\/_", "".join(map(chr, range(32))).replace("\n", "") + "\x7f"]
_N = len(_CLASSES) + 1  # the last: bytes of non-ASCII characters
_MAP = bytes(next((k for k, c in enumerate(_CLASSES) if chr(b) in c), _N - 1) if b < 128 else _N - 1 for b in range(256))
WIDTH = _N + _N * _N + 10


def features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(raw.translate(_MAP), np.uint8)
    n = len(c)
    out[:_N] = np.sqrt(np.bincount(c, minlength=_N) / n)
    if n > 1:
        out[_N : _N + _N * _N] = np.sqrt(np.bincount(c[:-1].astype(np.int16) * _N + c[1:], minlength=_N * _N) / (n - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    size = n / w
    same = sum(map(bytes.__eq__, words, words[1:])) / w
    out[-10:] = (same**0.5, same, 1.0, np.log1p(w) / 10, min(size, 20) / 10, len(set(words)) / w / np.sqrt(1 + 0.01 * w) * 2, len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, min(w / max(len(lines), 1), 100) / 50, max(map(len, words), default=0) ** 0.5 / 10)
    return out


class Network:
    """Score of features: one hidden layer, logistic output."""

    def __init__(self, mean, scale, w1, b1, w2, b2, prior):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.prior = mean, scale, w1, b1, w2, b2, prior

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, steps: int = 1500, hidden: int = 24) -> Network:
    """nnPU when a prior is given, else plain positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (p - mean) / scale, (u - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def grad(x, slope):
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        d = slope(z) / len(x)
        back = np.outer(d, w[2]) * (h > 0)
        return z, [x.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True)]

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 384)]
        zp, gp = grad(a, lambda z: sig(z) - 1)  # loss of positives as positive
        zu, gu = grad(b, sig)  # of unlabelled as negative
        if prior is None:
            g = [x + y for x, y in zip(gp, gu, strict=True)]
        else:
            _, gn = grad(a, sig)
            negative = soft(zu).mean() - prior * soft(zp).mean()
            if negative >= 0:
                g = [prior * x + y - prior * z for x, y, z in zip(gp, gu, gn, strict=True)]
            else:
                g = [prior * z - y for y, z in zip(gu, gn, strict=True)]
        rate = 0.003 * (1 - 0.9 * t / steps)
        for i in range(4):
            g[i] = g[i] + 1e-3 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] = (w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(mean, scale, *w, prior)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in ``u`` given their scores: the least ratio of the upper tails, with a confidence margin."""
    p, u = np.sort(p), np.sort(u)
    at = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    tail_p, tail_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(4 / 0.1) / 2 / len(u)) + np.sqrt(np.log(4 / 0.1) / 2 / len(p))
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 0.98))


def train(p: np.ndarray, u: np.ndarray) -> Network:
    """``p``: features of positives, ``u``: of unlabelled texts.  The prior is estimated out of fold."""
    if not len(p) or not len(u):
        zero = np.zeros(WIDTH, np.float32)
        return Network(zero, zero + 1, np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), 0.5)
    half = [_train(p[k::2], u[k::2], None, k, 1000) for k in (0, 1)] if min(len(p), len(u)) > 3 else [_train(p, u, None, 0, 200)] * 2
    sp = np.concatenate([half[1 - k].logit(p[k::2]) for k in (0, 1)])
    su = np.concatenate([half[1 - k].logit(u[k::2]) for k in (0, 1)])
    model = _train(p, u, estimate_prior(sp, su), 7)
    # Where the minimised risk is indifferent (logit 0), the score is to be CUT.
    model.b2 = model.b2 + np.float32(np.log(CUT / (1 - CUT)))
    return model


def _vectors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of (flag, text) rows, collected; the caller bounds the rows."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("flag", T.BooleanType()), T.StructField("id", T.StringType()), T.StructField("x", T.BinaryType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=schema.names)

    got = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r.flag, r.id or "", bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float32).reshape(-1, WIDTH)
    flag = np.array([r.flag for r in got], bool)
    return x[flag], x[~flag]


def fit(docs: DataFrame, positives: DataFrame, doc_id: str = "doc_id", text: str = "text", n_positive: int = POSITIVES, n_unlabelled: int = UNLABELLED) -> Network:
    """``docs``: unlabelled text; ``positives``: ids of trusted rows in it."""
    base.ship(docs.sparkSession)
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    pos = positives.select(base.column(doc_id).alias("id")).filter("id is not null").distinct()
    src = docs.select(base.column(doc_id).alias("id"), base.column(text).alias("t"))
    have, total = pos.count(), src.count()
    pos = pos.filter(draw("positive") < min(1.0, n_positive / max(have, 1)))
    # Bounded by n_positive (expected), hence the broadcast.
    p = src.join(F.broadcast(pos), "id", "left_semi").select(F.lit(True), F.col("id").cast("string"), "t")
    u = src.filter(draw("unlabelled") < min(1.0, n_unlabelled / max(total, 1))).select(F.lit(False), F.col("id").cast("string"), "t")
    return train(*_vectors(p.unionAll(u)))


def score(docs: DataFrame, model: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of each whole text."""
    import pyarrow as pa

    base.ship(docs.sparkSession)
    h = base.Held(docs, keep, ("score",), prefix, t=text)
    shared, through, at = base.share(docs.sparkSession, model), h.through, h.at["t"]
    schema = h.schema(T.StructField("score", T.DoubleType()))

    def run(batches):
        base.claim("quality")
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in through), pa.array(shared.value.score(x).astype(float), pa.float64())], names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))
