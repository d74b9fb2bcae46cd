"""Toxicity by weak supervision.

Voters (lexicon groups and patterns) vote on every document, or abstain.  The
vote patterns of the whole corpus are counted, and a generative model of two
hidden classes is fitted to the counts by expectation maximisation: each voter has
a rate of voting in either class (its accuracy); voters that stay correlated given
the class are joined, and a joined group has a table of rates for its joint votes.
The model's posteriors label a bounded sample, on which a linear classifier (votes
and hashed words) is trained; that classifier scores every whole text.

Null and empty texts get no votes and no words: the bias alone scores them.
Labelled rows, where given, show which lexicon words mislead in this corpus (they
stand mostly in documents labelled clean; such words vote no more), which beginnings
of words go with toxic documents that no lexicon knows (two more voters), and the share
of toxic documents; in the label model their class is known.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

# The lexicon of each voter.
LEXICON = {
    "person": "idiot idiots moron morons imbecile imbeciles loser losers clown clowns dumbass jackass asshole assholes bastard bastards bitch bitches retard retards dimwit halfwit nitwit simpleton twat wanker",
    "contempt": "stupid pathetic worthless disgusting idiotic moronic despicable contemptible repulsive loathsome brainless spineless vile",
    "dehumanising": "trash scum vermin maggot maggots subhuman subhumans lowlife lowlifes",
    "profanity": "fuck fucking fucked fucker fuckers motherfucker motherfuckers shit shitty bullshit cunt cunts dickhead dickheads slut sluts whore whores",
    "french": "connard connards connasse salaud salauds salope salopes imbécile crétin crétins abruti abrutis ordure ordures pourriture",
    "german": "arschloch arschlöcher idioten trottel dummkopf vollidiot schwachkopf abschaum drecksau schlampe hurensohn",
    "spanish": "estúpido estúpida estúpidos idiotas imbécil cabrón cabrones pendejo pendejos gilipollas escoria asqueroso asquerosa mierda puta",
}
# Insults only when aimed at somebody.
AIMED = "fool jerk creep coward garbage filth pig dirt nothing useless dumb ugly joke disgrace failure parasite savage animal débile stupide minable versager dreck widerlich wertlos basura patético inútil".split()
_AIMED = re.compile(r"\b(?:you(?:\s+are|'re|r)?|u\s+r|they\s+are|tu\s+es|vous\s+êtes|du\s+bist|ihr\s+seid|eres|sois)\s+(?:\S+\s+){0,2}(\S+)|\b(?:kill|hang|shoot)\s+(yourself)\b", re.I)
NAMES = [*LEXICON, "aimed", "shouting", "stems", "some stems"]
_OF = {w: 1 << k for k, words in enumerate(LEXICON.values()) for w in words.split()}
_FOLD = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Slots of hashed words; rows (expected) that train the linear classifier; voters joined at most.
BITS, SAMPLE, LARGEST_GROUP = 14, 8_000, 3
#: Learned stems: letters, documents and excess among toxic ones, number; margin over the clean rate, and how rare a count must be to vote.
STEM_LETTERS, STEM_DOCS, STEM_EXCESS, STEMS, MARGIN, RARE = (3, 4, 5, 6), 8, 8.0, 40, 4.0, 1e-3
#: How often a labelled document counts in the label model.
ANCHOR = 5.0


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) of a Poisson X, for any n and mean: terms from n on upwards, or one less those below n, from the largest."""
    if n <= 0 or mean <= 0:
        return float(n <= 0)
    up = n > mean
    i = n if up else n - 1
    term = math.exp(i * math.log(mean) - mean - math.lgamma(i + 1))
    total = 0.0
    while term > total * 1e-17:
        total += term
        i, term = (i + 1, term * mean / (i + 1)) if up else (i - 1, term * i / mean)
    return min(total, 1.0) if up else max(0.0, 1 - total)


class Voters:
    """The voters: the lexicon less its ``dropped`` words, patterns, and learned ``stems``.

    A stem voter counts the words that begin with a stem and compares with ``rate``, the
    share of such words in clean text: "stems" needs a surprising number, "some stems" one.
    """

    def __init__(self, dropped: set[str] = frozenset(), stems: list[str] = (), rate: float = 0.0):
        self.stems, self.rate = tuple(x.encode() for x in stems), rate
        self.words = {w.encode(): k for w, k in _OF.items() if w not in dropped}
        self.aimed = {w.encode() for w in [*_OF, *AIMED, "yourself"] if w not in dropped}

    def __call__(self, text: str | None, words: set[bytes] | None = None) -> int:
        """Bit k: voter k votes toxic; 0: it abstains."""
        if not text:
            return 0
        out, own, k = 0, self.words, len(LEXICON)
        raw = text.lower().encode("utf-8", "surrogatepass") if self.stems else b""
        for w in (words if words is not None else words_of(text)) & own.keys():
            out |= own[w]
        if (out or not self.aimed.isdisjoint(words or words_of(text))) and any((m[1] or m[2]).lower().strip(".,;:!?").encode() in self.aimed for m in _AIMED.finditer(text)):
            out |= 1 << k
        if text.count("!!") > 2 and sum(map(str.isupper, text)) > 0.5 * len(text):
            out |= 2 << k
        if self.stems and any(x in raw for x in self.stems) and (n := self.stemmed(text)[0]):
            mean = MARGIN * self.rate * max(len(text) / 6, 1)
            out |= (12 if n > 1 and poisson_tail(n, mean) < RARE else 8) << k
        return out

    def stemmed(self, text: str | None) -> tuple[int, int]:
        """Words that begin with a stem, and all words."""
        words = text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
        return sum(w.startswith(self.stems) for w in words) if self.stems else 0, len(words)


class LabelModel:
    """Hidden class, voters' rates, and tables of correlated groups, from pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, voters: int, share: float | None = None, rounds: int = 200, anchors: np.ndarray | None = None):
        #: Counts of labelled documents, clean and toxic, of each pattern: their class is known.
        self.anchors = np.zeros((2, len(patterns))) if anchors is None else ANCHOR * anchors
        self.voters, self.share, self.fixed = voters, share or 0.1, share is not None
        bits = (patterns[:, None] >> np.arange(voters)) & 1
        self.groups, self.correlated = [[k] for k in range(voters)], []
        best = self._em(bits, counts, rounds)
        # Join the voters whose joint table explains the counts best, while it is worth its parameters (BIC).
        used = [k for k in range(voters) if bits[:, k] @ counts > 0]
        while True:
            found = []
            for a, b in combinations([g for g in self.groups if g[0] in used], 2):
                if len(a) + len(b) <= LARGEST_GROUP:
                    kept, self.groups = self.groups, [g for g in self.groups if g is not a and g is not b] + [a + b]
                    cost = (2 ** (len(a) + len(b)) - 2 ** len(a) - 2 ** len(b) + 1) * np.log(max(counts.sum(), 2))
                    found.append((self._em(bits, counts, rounds) - best - cost, a + b))
                    self.groups = kept
            if not found or (gain := max(found))[0] <= 0:
                break
            self.groups = [g for g in self.groups if not set(g) <= set(gain[1])] + [gain[1]]
            best = self._em(bits, counts, rounds)
        self.correlated = [g for g in self.groups if len(g) > 1]
        self._em(bits, counts, rounds)

    def _start(self, bits: np.ndarray) -> np.ndarray:
        """Documents with votes of more groups are likelier to be toxic."""
        n = sum((c > 0).astype(int) for c in self._codes(bits))
        return np.select([n > 1, n == 1], [0.95, 0.4], 0.01)

    def _codes(self, bits: np.ndarray) -> list[np.ndarray]:
        return [sum(bits[:, k] << i for i, k in enumerate(g)) for g in self.groups]

    def _em(self, bits, counts, rounds) -> float:
        """Fit the tables of the present groups; the log likelihood of the counts."""
        codes, post = self._codes(bits), self._start(bits)
        for _ in range(rounds):
            own = np.stack([(1 - post) * counts, post * counts]) + self.anchors
            if not self.fixed:
                self.share = float(np.clip((own[1].sum() + 1) / (counts.sum() + 2 / max(self.share, 1e-3)), 1e-4, 0.5))
            self.tables = []
            for g, code in zip(self.groups, codes, strict=True):
                size = 1 << len(g)
                # Prior counts: clean documents rarely get a vote, toxic ones often.
                votes = (np.arange(size)[:, None] >> np.arange(len(g)) & 1).sum(1)
                t = np.stack([np.bincount(code, own[0], size) + 20 * 0.001**votes, np.bincount(code, own[1], size) + 5 * 0.3**votes * 0.7 ** (len(g) - votes)])
                self.tables.append(self._monotone(t / t.sum(1, keepdims=True)))
            new = self._posterior(codes)
            if np.abs(new - post).max() < 1e-5:
                break
            post = new
        joint = [np.log(p) + sum(np.log(t[k][c]) for t, c in zip(self.tables, codes, strict=True)) for k, p in enumerate((1 - self.share, self.share))]
        return float(counts @ np.logaddexp(*joint) + sum((a * (j - np.logaddexp(*joint))).sum() for a, j in zip(self.anchors, joint, strict=True)))

    @staticmethod
    def _monotone(t: np.ndarray) -> np.ndarray:
        """More votes of a group are no weaker evidence than fewer: lower the clean rate where they are."""
        for code in sorted(range(1, t.shape[1]), key=int.bit_count):
            fewer = [t[1][c] / t[0][c] for i in range(code.bit_length()) if code >> i & 1 and (c := code & ~(1 << i))]
            if fewer and t[1][code] < max(fewer) * t[0][code]:
                t[0][code] = t[1][code] / max(fewer)
        return t / t.sum(1, keepdims=True)

    def _posterior(self, codes) -> np.ndarray:
        odds = np.log(self.share / (1 - self.share)) + sum(np.log(t[1][c] / t[0][c]) for t, c in zip(self.tables, codes, strict=True))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._codes((np.asarray(patterns)[:, None] >> np.arange(self.voters)) & 1))

    def odds(self) -> dict[str, float]:
        return {k: float(np.log(b / a)) for k, (a, b) in self.accuracy().items()}

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """Rates of voting in the clean and the toxic class."""
        out = {}
        for g, t in zip(self.groups, self.tables, strict=True):
            for i, k in enumerate(g):
                out[NAMES[k]] = tuple(float(t[y][(np.arange(len(t[y])) >> i) & 1 == 1].sum()) for y in (0, 1))
        return out


class Linear:
    """Weights of votes, of any vote at all, and of hashed words."""

    def __init__(self, weights: np.ndarray, bias: float, voters: Voters):
        self.weights, self.bias, self.voters, self.cache = weights, bias, voters, {}

    def logit(self, text: str | None) -> float:
        if not text:
            return self.bias
        words = words_of(text)
        mask = self.voters(text, words)
        cache = self.cache
        if len(cache) > 200_000:
            cache.clear()
        hashed = 0.0
        for w in words:
            x = cache.get(w)
            if x is None:
                x = cache[w] = float(self.weights[slot(w)])
            hashed += x
        dense = sum(float(self.weights[k]) for k in range(len(NAMES)) if mask >> k & 1) + (float(self.weights[len(NAMES)]) if mask & LEXICAL else 0.0)
        return self.bias + dense + hashed / np.sqrt(len(words) or 1)


LEXICAL = (1 << len(LEXICON) + 1) - 1  # all but shouting and stems
DENSE = len(NAMES) + 1


def slot(word: bytes) -> int:
    return DENSE + (zlib.crc32(word) & ((1 << BITS) - 1))


def features(text: str | None, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """Votes of a whole text, and the slots of its distinct words with the number of words in each."""
    words = words_of(text) if text else set()
    slots, n = np.unique(np.fromiter(map(slot, words), np.uint16, len(words)), return_counts=True)
    return voters(text, words), slots, n.astype(np.uint32)


def fit_linear(vectors: list[tuple[int, np.ndarray, np.ndarray]], posterior: np.ndarray, voters: Voters, start: dict[str, float], epochs: int = 12) -> Linear:
    """Logistic regression on soft labels by stochastic gradient, from the label model's log odds of each vote."""
    rows = []
    for mask, slots, n in vectors:
        dense = [k for k in range(len(NAMES)) if mask >> k & 1] + ([len(NAMES)] if mask & LEXICAL else [])
        rows.append((np.r_[np.array(dense, np.int64), slots.astype(np.int64)], np.r_[np.ones(len(dense)), n / np.sqrt(n.sum() or 1)]))
    w, bias, rng = np.zeros(DENSE + (1 << BITS)), -3.0, np.random.default_rng(5)
    w[: len(NAMES)] = [np.clip(start.get(k, 0.0), -2, 6) for k in NAMES]
    heavy = np.where(posterior > 0.5, min(10.0, max(1.0, (posterior <= 0.5).sum() / max((posterior > 0.5).sum(), 1))), 1.0)
    shrink = np.r_[np.full(DENSE, 1e-6), np.full(1 << BITS, 1e-3)]
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -30, 30)))
            g = heavy[i] * (p - posterior[i])
            w[at] -= rate * g * x
            bias -= rate * g * 0.2
        w *= 1 - np.minimum(1, shrink * len(rows) * rate)
    return Linear(w.astype(np.float32), float(bias), voters)


def _map(docs: DataFrame, text: str, keep: tuple[str, ...], name: str, kind: T.DataType, of, prefix: str = ""):
    """``keep`` columns and the column ``name``: a function, made by ``of`` in the worker, of each whole text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    base.ship(docs.sparkSession)
    h = base.Held(docs, keep, (name,), prefix, t=text)
    through, at, schema = h.through, h.at["t"], h.schema(T.StructField(name, kind))

    def run(batches):
        base.claim("toxicity")
        f = of()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in through), pa.array([f(t.as_py()) for t in b.column(at)], to_arrow_type(kind))], names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))


def vote(docs: DataFrame, voters: Voters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``votes``, a bit for each of ``NAMES``."""
    shared = base.share(docs.sparkSession, voters)
    return _map(docs, text, keep, "votes", T.LongType(), lambda: shared.value)


def misleading(labelled: DataFrame, text: str = "text", toxic: str = "toxic", least: int = 5, rate: float = 0.5) -> set[str]:
    """Lexicon words that mostly stand in documents labelled clean (counted over all labelled rows)."""

    def of():
        lexicon = {w.encode(): w for w in _OF}
        return lambda t: sorted(lexicon[w] for w in words_of(t) & lexicon.keys()) if t else []

    hits = _map(labelled.filter(F.col(toxic).isNotNull()), text, (toxic,), "hit", T.ArrayType(T.StringType()), of)
    got = hits.select(toxic, F.explode("hit").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.avg(F.col(toxic).cast("double")).alias("rate"))
    return {r.w for r in got.filter((F.col("n") >= least) & (F.col("rate") < rate)).collect()}  # at most the lexicon


def learned_stems(labelled: DataFrame, voters: Voters, text: str = "text", toxic: str = "toxic") -> list[str]:
    """Beginnings of words that toxic documents without a lexicon word have far more often than clean ones."""

    def of():
        def beginnings(t):
            if not t or voters(t):
                return None
            return sorted({w[:k] for w in set(t.lower().split()) if w.isalpha() for k in STEM_LETTERS if len(w) > k})

        return beginnings

    rows = _map(labelled.filter(F.col(toxic).isNotNull()), text, (toxic,), "stems", T.ArrayType(T.StringType()), of).filter("stems is not null")
    total = {bool(r[0]): r[1] for r in rows.groupBy(F.col(toxic) > 0).count().collect()}
    if not total.get(True) or not total.get(False):
        return []
    got = rows.select(toxic, F.explode("stems").alias("stem")).groupBy("stem").agg(F.count_if(F.col(toxic) > 0).alias("t"), F.count_if(F.col(toxic) <= 0).alias("c"))
    excess = (F.col("t") / total[True]) / ((F.col("c") + 1) / total[False])
    best = got.filter((F.col("t") >= STEM_DOCS) & (excess >= STEM_EXCESS)).withColumn("score", F.col("t") * F.log(excess)).collect()  # of a bounded number of labelled rows
    out: list[str] = []
    for r in sorted(best, key=lambda r: (-r.score, -len(r.stem), r.stem)):
        if len(out) < STEMS and not any(r.stem.startswith(x) or x.startswith(r.stem) for x in out):
            out.append(r.stem)
    return out


def fit(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> tuple[LabelModel, Linear]:
    """Label model over all of ``docs``, linear classifier on about ``sample`` of them.

    ``labelled`` (text and ``toxic``, a bounded number of rows) shows which lexicon words
    mislead here, which beginnings of words go with toxic documents, the share of these,
    and the classes of its own vote patterns.
    """
    voters, share, known = Voters(), None, {}
    if labelled is not None:
        seen = labelled.select(base.column(text).alias("t"), base.column(toxic).alias("y")).filter("y is not null")
        dropped = misleading(seen, "t", "y")
        stems = learned_stems(seen, Voters(dropped), "t", "y")
        if stems:
            counter = Voters(dropped, stems)
            # Two numbers of each labelled row, of which there is a bounded number.
            rows = [r[0] for r in _map(seen.filter("y <= 0"), "t", (), "n", T.ArrayType(T.LongType()), lambda: lambda t: list(counter.stemmed(t))).collect()]
            voters = Voters(dropped, stems, (sum(n for n, _ in rows) + 1) / (sum(w for _, w in rows) + 1))
        else:
            voters = Voters(dropped)
        share = seen.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
        share = min(max(share, 0.001), 0.5) if share is not None else None
        known = {(r[0], r[1]): r[2] for r in vote(seen, voters, "t", ("y",)).groupBy("votes", (F.col("y") > 0).alias("y")).count().collect()}
    # Bounded: at most 2 ** len(NAMES) patterns.
    got = {r[0]: r[1] for r in vote(docs, voters, text, ()).groupBy("votes").count().collect()}
    total = sum(got.values())
    patterns = sorted({*got, *(v for v, _ in known)} or {0})
    anchors = np.array([[known.get((v, y), 0) for v in patterns] for y in (False, True)], float)
    model = LabelModel(np.array(patterns, np.int64), np.array([got.get(v, 0) + (not total) for v in patterns], float), len(NAMES), share, anchors=anchors)
    draw = F.pmod(F.xxhash64(base.column(doc_id), F.lit("weak")), F.lit(1 << 30)) / float(1 << 30)
    some = docs.filter(draw < min(1.0, sample / max(total, 1)))
    # Bounded: about `sample` rows, of each two numbers for a slot it uses, 2 ** BITS slots at most.
    kind = T.StructType([T.StructField("votes", T.LongType()), T.StructField("slots", T.BinaryType()), T.StructField("n", T.BinaryType())])
    shared = base.share(docs.sparkSession, voters)

    def of():
        def sparse(t):
            mask, slots, n = features(t, shared.value)
            return {"votes": mask, "slots": slots.tobytes(), "n": n.tobytes()}

        return sparse

    vectors = sorted((r.x.votes, bytes(r.x.slots), bytes(r.x.n)) for r in _map(some, text, (), "x", kind, of).collect())
    vectors = [(v, np.frombuffer(x, np.uint16), np.frombuffer(n, np.uint32)) for v, x, n in vectors]
    return model, fit_linear(vectors, model.posterior(np.array([v for v, _, _ in vectors], np.int64)) if vectors else np.zeros(0), voters, model.odds())


def score(docs: DataFrame, linear: Linear, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns and ``score`` of each whole text."""
    shared = base.share(docs.sparkSession, linear)

    def of():
        model = shared.value
        return lambda t: float(1 / (1 + np.exp(-np.clip(model.logit(t), -30, 30))))

    return _map(docs, text, keep, "score", T.DoubleType(), of, prefix)
