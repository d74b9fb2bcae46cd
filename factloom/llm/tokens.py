"""Greedy word-piece lengths from a linear longest-match automaton.

The vocabulary is a trie with two roots (word starts, continuations).  Every
node has a failure link and the number of pieces that following it pops, both
precomputed, so the number of pieces of a word falls out of one pass over its
characters; no piece is ever built.  A word that cannot be covered counts as one
unknown piece, as in the greedy algorithm.

Null and empty texts have no words and no pieces.  A word's cost is linear in
its length, whatever the length.  Repeated words are looked up in a worker's
cache (a bounded dictionary).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm import base
from factloom.llm.pieces import MARK, PieceModel

WORDS = re.compile(r"\w+|[^\w\s]")
#: Entries of a worker's word cache, and the longest word in it.
CACHE, CACHED = 250_000, 100
_UNKNOWN = (1 << 40) + 1  # one piece, one unknown word
_WORKER: dict[str, "LongestMatch"] = {}


def vocabulary(blob: bytes) -> tuple[list[str], list[str]]:
    """Word-start and continuation pieces of a SentencePiece file: with and without the mark."""
    ids = PieceModel(blob).ids
    start = sorted(p[1:] for p in ids if p[0] == MARK and len(p) > 1 and MARK not in p[1:])
    return start, sorted(p for p in ids if MARK not in p)


class LongestMatch:
    def __init__(self, start: list[str], inner: list[str]):
        self.step: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: continuation
        token = [False, False]
        for root, pieces in ((0, start), (1, inner)):
            for p in pieces:
                at = root
                for c in p:
                    nxt = self.step[at].get(c)
                    if nxt is None:
                        nxt = self.step[at][c] = len(self.step)
                        self.step.append({})
                        token.append(False)
                    at = nxt
                token[at] = True
        self.link, self.pops = [-1] * len(self.step), [0] * len(self.step)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.step[u].items():
                    if token[v]:
                        self.link[v], self.pops[v] = 1, 1
                    else:
                        z, n = self.link[u], self.pops[u]
                        while z >= 0 and c not in self.step[z]:
                            n += self.pops[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[v], self.pops[v] = self.step[z][c], n
                    below.append(v)
            level = below
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; ``_UNKNOWN`` where the vocabulary cannot cover it."""
        step, link, pops = self.step, self.link, self.pops
        at = n = 0
        for c in word:
            while c not in step[at]:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return _UNKNOWN
            at = step[at][c]
        while at != 1:
            n += pops[at]
            at = link[at]
            if at < 0:
                return _UNKNOWN
        return n

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces and unknown words of a text."""
        words = WORDS.findall(text) if text else []
        cache = self.cache
        try:
            total = sum(map(cache.__getitem__, words))
        except KeyError:
            total = 0
            for w in words:
                n = cache.get(w)
                if n is None:
                    n = self.count(w)
                    if len(w) <= CACHED:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = n
                total += n
        return len(words), total & ((1 << 40) - 1), total >> 40


def _automaton(blob: bytes) -> LongestMatch:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = LongestMatch(*vocabulary(blob))
    return _WORKER[key]


def token_counts(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns with ``n_words``, ``n_tokens`` and ``n_unknown`` of each whole text."""
    import pyarrow as pa

    spark = docs.sparkSession
    base.ship(spark)
    with open(model_path, "rb") as f:
        blob = base.share(spark, f.read())
    results = ("n_words", "n_tokens", "n_unknown")
    h = base.Held(docs, keep, results, prefix, t=text)
    through, at, schema = h.through, h.at["t"], h.schema(*(T.StructField(c, T.LongType()) for c in results))

    def run(batches):
        base.claim("tokens", _WORKER.clear)
        model = _automaton(blob.value)
        for b in batches:
            got = [model.text(t.as_py()) for t in b.column(at)]
            cols = [b.column(i) for i in through] + [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))
