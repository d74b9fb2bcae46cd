"""Benchmark decontamination with an FM-index for each training shard.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters.  A
window is ``width`` consecutive words of a benchmark item, or the whole of a
shorter item.  Each shard of documents (a batch of rows, closed at ``SHARD`` symbols)
gets an FM-index of all its words: suffix array, Burrows-Wheeler transform in a
wavelet matrix with 64-bit rank blocks, sampled suffix positions.  All windows are
searched backwards together, their occurrences located through the samples, and the
overlapping ones merged to spans.

The alphabet is the benchmark's vocabulary.  No window can have another word, so a run
of others is one break, as is a document's end.  Breaks sort by position, so suffixes
differ at the next break at the latest, and only suffixes that are still tied are sorted
again when the compared length doubles.  A document of more than a shard's words is
indexed in pieces that overlap by a window less one word.

The benchmark is broadcast in blocks of at most ``BLOCK`` words; a larger one
passes over the documents block by block.  Spans are cut after the last block, and the
cut texts searched again until none is left, so blocks change nothing.

Null, empty or wordless texts have no words; null items are no items; equal items each
count; rows with equal ids are rows of their own.  Kept columns may have any names: one
named like a result gives way to it (``prefix`` renames the results).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

WIDTH = 10
#: Words of one broadcast block of the benchmark; symbols at which a shard closes.
BLOCK, SHARD = 500_000, 500_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Ranks:
    """A wavelet matrix: how often does a symbol stand before a place?"""

    def __init__(self, seq: np.ndarray, top: int):
        self.n, self.levels = len(seq), max(1, int(top).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        pad = np.zeros(-len(seq) % 64 + 64, bool)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq & (1 << level)) != 0
            packed = np.packbits(np.concatenate([bit, pad]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - self.sums[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(top + 1)
        #: Where each symbol's places begin in the last level.
        self.start = self._down(every, np.zeros(top + 1, np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.sums[k][block] + np.bitwise_count(self.bits[k][block] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            ones = self._ones(k, at)
            bit = ((self.bits[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """Over symbols 1.. and breaks (0); the last symbol is a break."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        order = self._suffixes(text)
        before = np.where(order > 0, text[order - 1], 0)  # of the first suffix: a break
        self.top = top = int(text.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.ranks = Ranks(before, top)
        #: Rows whose position is kept: every eighth place, and those after a break, where walking back ends.
        self.kept = (order % self.SAMPLE == 0) | (before == 0)
        self.number, self.place = np.cumsum(self.kept, dtype=np.int32) - 1, order[self.kept].astype(np.int32)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array; a break is less than all words and than every later break."""
        n = len(text)
        low, bits = n.bit_length(), max(1, int(text.max(initial=0)).bit_length())
        step = max(1, (62 - low) // bits)
        # The first `step` symbols in one number, nothing after a break, and the place below them:
        # equal beginnings that have a break are in their final order by that.
        key, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(step):
            there = np.concatenate([text[k:], np.zeros(min(k, n), text.dtype)])[:n]
            whole &= there > 0
            key = (key << bits) | np.where(whole, there, 0)
        key = np.sort((key << low) | np.arange(n))
        order = key & ((1 << low) - 1)
        key >>= low
        head = np.concatenate([[True], (key[1:] != key[:-1]) | ~whole[order[1:]]]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        tied = np.flatnonzero(~head | np.concatenate([~head[1:], [False]])) if n else np.zeros(0, np.int64)
        while len(tied):
            own = order[tied]
            key = rank[own] * n + rank[own + step]  # no break in `step` symbols, so there is a symbol after them
            at = np.argsort(key)
            own, key = own[at], key[at]
            order[tied] = own
            head = np.concatenate([[True], key[1:] != key[:-1]])
            rank[own] = np.maximum.accumulate(np.where(head, tied, 0))
            tied = tied[~head | np.concatenate([~head[1:], [False]])]
            step *= 2
        return order

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of ``patterns`` (equal lengths) by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            ok = (c <= self.top) & (c > 0)
            hi[live[~ok]] = lo[live[~ok]]
            live, c = live[ok], c[ok]
            both = self.first[np.concatenate([c, c])] + self.ranks.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(c)], both[len(c) :]
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            got = self.kept[at[todo]]
            done = todo[got]
            out[done] = self.place[self.number[at[done]]] + steps[done]
            todo = todo[~got]
            c = self.ranks.symbol(at[todo])
            at[todo] = self.first[c] + self.ranks.rank(c, at[todo])
            steps[todo] += 1
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The windows of a block of benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.vocab, self.longest = _Numbers(vocab), max(map(len, found), default=1)
        self.items = [sorted(x) for x in found.values()]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(w) for w in found], np.int64)
        rows = list(found)
        for m in np.unique(lengths):
            own = np.flatnonzero(lengths == m)
            self.by_length[int(m)] = np.array([rows[i] for i in own], np.int64), own

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.__getitem__, words), np.int64, len(words))


def _occurrences(windows: Windows, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and window number of all occurrences in a shard."""
    index, out = FMIndex(text), []
    for m, (patterns, own) in windows.by_length.items():
        lo, hi = index.search(patterns)
        n = hi - lo
        hit = np.flatnonzero(n > 0)
        rows = np.repeat(lo[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
        out.append((index.locate(rows), np.full(len(rows), m), np.repeat(own[hit], n[hit])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Shard:
    """Texts added one by one; :meth:`close` gives each one's words, merged spans of hit words, and items."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.sizes: list[int] = []
        self.spans: list[list[tuple[int, int]]] = []
        self.items: list[set[str]] = []
        self._empty()

    def _empty(self) -> None:
        self.pieces, self.words, self.docs, self.symbols = [], [], [], 0

    def add(self, text: str | None) -> None:
        ids = self.windows.numbers(words_of(text))
        doc = len(self.sizes)
        self.sizes.append(len(ids))
        self.spans.append([])
        self.items.append(set())
        if not self.windows.by_length:
            return
        for lo in range(0, len(ids), SHARD):
            self._piece(doc, lo, ids[lo : lo + SHARD + self.windows.longest - 1])

    def _piece(self, doc: int, at: int, ids: np.ndarray) -> None:
        # Of a run of words that no window has, one break stays; so does one at the end.
        known = ids > 0
        keep = np.flatnonzero(known | np.concatenate([[False], known[:-1]]))
        if not len(keep):
            return
        self.pieces += [ids[keep], np.zeros(1, np.int64)]
        self.words += [keep + at, np.zeros(1, np.int64)]
        self.docs.append((self.symbols, doc))
        self.symbols += len(keep) + 1
        if self.symbols >= SHARD:
            self._search()

    def _search(self) -> None:
        if self.pieces:
            place, length, window = _occurrences(self.windows, np.concatenate(self.pieces))
            start, doc = np.array(self.docs, np.int64).T
            doc, at = doc[np.searchsorted(start, place, side="right") - 1], np.concatenate(self.words)[place]
            for d, s, m, w in zip(doc.tolist(), at.tolist(), length.tolist(), window.tolist(), strict=True):
                self.items[d].update(self.windows.items[w])
                self.spans[d].append((s, s + m))
        self._empty()

    def close(self) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        self._search()
        return list(zip(self.sizes, map(merge, self.spans), self.items, strict=True))


def search(texts: list[str | None], windows: Windows) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    shard = Shard(windows)
    for t in texts:
        shard.add(t)
    return shard.close()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans``."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    src = benchmark.select(base.column(item).cast("string").alias("item"), base.column(text).alias("text")).filter("item is not null and text is not null")
    # spaces and marks bound the words of a text from above
    n = src.agg(F.sum(F.size(F.split("text", _NO_WORD)))).first()[0] or 0
    k = -(-n // BLOCK) or 1
    return [src if k == 1 else src.filter(F.pmod(F.xxhash64("item", "text"), F.lit(k)) == i) for i in range(k)]


RESULTS = ("n_words", "spans", "items")
_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def _fresh(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", width: int = WIDTH, prefix: str = "") -> DataFrame:
    """``keep`` columns, ``n_words``, ``spans`` (start and end word, merged) and ``items`` (sorted strings)."""
    h = base.Held(docs, keep, RESULTS, prefix, t=text)
    out = _fresh(h.rows)
    for block in _blocks(benchmark, item, item_text):
        out = _pass(out, _windows(block, width))
    return h.named(out)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, prefix: str = "") -> DataFrame:
    """The columns of ``docs``, ``text`` without the benchmark's words, and ``n_cut``, the number of words cut (0: as it was).

    What a cut joins to a new window goes as well, whichever block of the benchmark has it.
    """
    h = base.Held(docs, docs.columns, ("n_cut",), prefix, t=text)
    out = h.rows.withColumn("n_cut", F.lit(0).cast("long"))
    windows = [_windows(block, width) for block in _blocks(benchmark, item, item_text)]
    if len(windows) == 1:
        return h.named(_pass(out, windows[0], cut=True))
    while True:
        found = _fresh(out)
        for w in windows:
            found = _pass(found, w)
        done = base.cut(_cut(found), "decontaminated")
        out = done.drop("again")
        if not done.filter("again").limit(1).count():
            return h.named(out)


def _windows(block: DataFrame, width: int):
    # Bounded: a block has BLOCK words at most.
    return base.share(block.sparkSession, Windows([(r.item, r.text) for r in block.collect()], width))


def _pass(rows: DataFrame, shared, cut: bool = False) -> DataFrame:
    """One block of the benchmark over all rows: spans and items are added, or all is cut from the text."""
    import pyarrow as pa

    base.ship(rows.sparkSession)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        base.claim("decontaminate")
        windows, arrow = shared.value, to_arrow_schema(schema)
        for b in batches:
            texts = b.column(at["t"]).to_pylist()
            got = search(texts, windows)
            cols = list(b.columns)
            if cut:
                gone = b.column(at["n_cut"]).to_pylist()
                for i, (_, spans, _) in enumerate(got):
                    while spans:
                        texts[i], gone[i] = without(texts[i], spans), gone[i] + sum(e - s for s, e in spans)
                        spans = search([texts[i]], windows)[0][1]
                cols[at["t"]], cols[at["n_cut"]] = pa.array(texts, arrow.field(at["t"]).type), pa.array(gone, pa.int64())
            else:
                old = b.column(at["spans"]).to_pylist()
                spans = [merge([(x["s"], x["e"]) for x in a] + new) for a, (_, new, _) in zip(old, got, strict=True)]
                items = [sorted({*a, *new}) for a, (_, _, new) in zip(b.column(at["items"]).to_pylist(), got, strict=True)]
                cols[at["n_words"]] = pa.array([n for n, _, _ in got], pa.int64())
                cols[at["spans"]] = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], arrow.field(at["spans"]).type)
                cols[at["items"]] = pa.array(items, arrow.field(at["items"]).type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return rows.mapInArrow(run, schema)


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of ``find`` without their spans' words, and ``again``: was anything cut?"""
    import pyarrow as pa

    kept = [c for c in rows.columns if c not in RESULTS]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(*kept).schema] + [T.StructField("again", T.BooleanType())])
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            spans = [[(x["s"], x["e"]) for x in own] for own in b.column(at["spans"]).to_pylist()]
            new = {
                "t": [without(t, x) if x else t for t, x in zip(b.column(at["t"]).to_pylist(), spans, strict=True)],
                "n_cut": [n + sum(e - s for s, e in x) for n, x in zip(b.column(at["n_cut"]).to_pylist(), spans, strict=True)],
            }
            cols = [pa.array(new[c], arrow.field(i).type) if c in new else b.column(at[c]) for i, c in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([bool(x) for x in spans])], schema=arrow)

    return rows.mapInArrow(run, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The report of each document: hit words, items and their digest."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(*keep, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
