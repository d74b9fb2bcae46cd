"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (a run of word-start marks and what follows it) never merge with each
other when no vocabulary piece has a mark after another character, so a text is
cut into words, and each distinct word of a batch is encoded once.  All new
words of a batch lie in flat numpy arrays; a round finds the best-ranked
adjacent pair of each word (segmented minimum), merges its occurrences from the
left, and compacts the arrays, until no pair is left.

Exactness.  The library merges one pair at a time: best score first, leftmost
among equals.  Merging all occurrences of a word's best pair in one round gives
the same result unless merging one of them makes a pair that ranks better than
the current one; such words merge only their leftmost occurrence in that round.
Words longer than ``LONG`` symbols go to an equivalent heap, whose cost is
n log n for any length.

Null texts count as empty and give no ids.  Text is taken as the library takes
it: the identity or the model's own normaliser is not re-implemented, so a model
with a non-identity character map is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm import base

MARK = "▁"
LONG = 400
#: Entries and characters of a worker's word cache; it is emptied when full, and longer words stay out.
CACHE, CACHE_CHARS, CACHED = 200_000, 4_000_000, 400
_WORKER: dict[str, "PieceModel"] = {}


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes):
    """Fields of one protobuf message: (number, wire value)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, v


class PieceModel:
    """Vocabulary, merge ranks and flags read from the model file itself."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, blob: bytes):
        pieces, scores, kinds = [], [], []
        self.add_prefix, self.squeeze, self.escape, self.byte_fallback, model_type, charsmap = True, True, True, False, 1, b""
        for n, v in _fields(blob):
            if n == 1:
                text, score, kind = "", 0.0, 1
                for m, w in _fields(v):
                    if m == 1:
                        text = w.decode("utf-8")
                    elif m == 2:
                        score = float(np.frombuffer(w, "<f4")[0])
                    elif m == 3:
                        kind = w
                pieces.append(text)
                scores.append(score)
                kinds.append(kind)
            elif n == 2:
                for m, w in _fields(v):
                    if m == 3:
                        model_type = w
                    elif m == 35:
                        self.byte_fallback = bool(w)
            elif n == 3:
                for m, w in _fields(v):
                    if m == 2:
                        charsmap = w
                    elif m == 3:
                        self.add_prefix = bool(w)
                    elif m == 4:
                        self.squeeze = bool(w)
                    elif m == 5:
                        self.escape = bool(w)
        if model_type != 2 or charsmap or not self.escape:
            raise ValueError("only BPE models with identity normalisation are supported")
        self.pieces, self.kinds = pieces, kinds
        self.unk = kinds.index(self.UNKNOWN)
        usable = {p: i for i, p in enumerate(pieces) if kinds[i] == self.NORMAL}
        if any(k in (self.USER, self.UNUSED) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in usable):
            raise ValueError("pieces across words are not supported")
        self.ids = usable
        self.byte_ids = [0] * 256
        for i, p in enumerate(pieces):
            if kinds[i] == self.BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        #: Pieces of one score rank alike: the leftmost goes first.
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in usable.values()}, reverse=True))}
        self.rank = np.full(len(pieces), np.iinfo(np.int32).max, np.int32)
        for i in usable.values():
            self.rank[i] = order[scores[i]]
        # One symbol for each piece, then for each character that pieces are made of but that is none itself.
        self.sym = dict(usable)
        for p in usable:
            for c in p:
                self.sym.setdefault(c, len(pieces) + len(self.sym))
        self.span = max(self.sym.values()) + 2  # symbols of unseen characters are span - 1
        keys, merged = [], []
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = self.sym.get(p[:k]), self.sym.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    merged.append(i)
        self.pair = dict(zip(keys, merged, strict=True))
        self._hash_pairs()
        # A word can also be cut between a letter and any mark of punctuation that no piece has after a letter.
        inside = {(p[k - 1], p[k]) for p in usable for k in range(1, len(p))}
        letters = set(string.ascii_letters) | {chr(c) for c in range(0xC0, 0x180)}
        ends = {c for c in [*string.punctuation, "\n"] if not any((a, c) in inside for a in letters)}
        some, alpha = "".join(map(re.escape, sorted(ends))), "a-zA-Z\u00c0-\u017f"
        self.cut = re.compile(f"{MARK}*[^{MARK}{alpha}]*[{alpha}]+(?=[{some}{MARK}]|\\Z)|{MARK}*[^{MARK}{alpha}]+(?={MARK}|\\Z)|{MARK}*[^{MARK}]+|{MARK}+").findall
        self.cache: dict[str, str] = {}
        self.cached = 0

    # -- encoding ---------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.add_prefix else "") + text).replace(" ", MARK)

    def _hash_pairs(self) -> None:
        """An open hash table of the pairs in arrays, probed in step for many keys at once."""
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        values = np.fromiter(self.pair.values(), np.int32, len(self.pair))
        bits = max(10, int(len(keys) * 3).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slot_key, self.slot_piece = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, rest, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(rest):
            self.probes += 1
            free = np.flatnonzero(self.slot_key[at[rest]] < 0)
            _, pick = np.unique(at[rest][free], return_index=True)
            put = rest[free[pick]]
            self.slot_key[at[put]], self.slot_piece[at[put]] = keys[put], values[put]
            rest = np.setdiff1d(rest, put)
            at[rest] = (at[rest] + 1) & self.mask
        self.slot_rank = np.where(self.slot_piece >= 0, self.rank[np.maximum(self.slot_piece, 0)], np.iinfo(np.int32).max).astype(np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _best(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of each pair; -1 and the largest rank where it is none."""
        key = left * self.span + right
        at = self._slot(key)
        found = self.slot_key[at]
        piece, rank = np.where(found == key, self.slot_piece[at], -1), np.where(found == key, self.slot_rank[at], np.iinfo(np.int32).max)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.slot_key[at[rest]]
            ok = found == key[rest]
            piece[rest[ok]], rank[rest[ok]] = self.slot_piece[at[rest[ok]]], self.slot_rank[at[rest[ok]]]
            rest = rest[~ok & (found >= 0)]
        return piece, rank

    def _heap(self, word: str) -> list[int]:
        """The same merges for one word of any length."""
        sym = [self.sym.get(c, self.span - 1) for c in word]
        size = [1] * len(sym)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < len(sym):
                m = self.pair.get(sym[i] * self.span + sym[nxt[i]])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), i, size[i], size[nxt[i]], m))

        for i in range(len(sym)):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if not size[i] or size[i] != a or j >= len(sym) or size[j] != b or self.pair.get(sym[i] * self.span + sym[j]) != m:
                continue
            sym[i], size[i], size[j] = m, a + b, 0
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        out, at = [], 0
        while at < len(sym):
            out.append((sym[at], at))
            at = nxt[at]
        return [x for s, p in out for x in self._emit(s, word[p])]

    def _emit(self, symbol: int, char: str) -> list[int]:
        if symbol < len(self.pieces):
            return [symbol]
        if self.byte_fallback:
            return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each (distinct) word by merge rounds."""
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._heap(w)
        if not short:
            return out
        text = "".join(words[k] for k in short)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        chars, back = np.unique(codes, return_inverse=True)
        sym = np.array([self.sym.get(chr(c), self.span - 1) for c in chars], np.int64)[back]
        word = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        char = np.arange(len(codes))
        top = np.iinfo(np.int32).max
        done_s, done_w, done_c = [], [], []
        # piece and rank belong to the pair of a symbol and its right neighbour; only pairs beside a merge are looked up again.
        piece, rank = self._best(sym, np.r_[sym[1:], sym[:1]])
        rank[np.flatnonzero(np.r_[word[1:] != word[:-1], True])] = top
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            own = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(own, sizes)
            live = least < top
            if not live.all():  # finished words leave the arrays
                for to, x in ((done_s, sym), (done_w, word), (done_c, char)):
                    to.append(x[~live])
                sym, word, char, piece, rank, least = (x[live] for x in (sym, word, char, piece, rank, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            # Leftmost, non-overlapping: of a run of adjacent occurrences every second one.
            if len(hit) > 1 and (near := hit[1:] - hit[:-1] == 1).any():
                run = np.cumsum(np.r_[True, ~near]) - 1
                within = np.arange(len(hit)) - np.searchsorted(run, run)
                hit = hit[within % 2 == 0]
            made, w = piece[hit].astype(np.int64), word[hit]
            first = np.r_[True, w[1:] != w[:-1]]
            if not first.all():
                # Would a merge make a better pair?  Its left neighbour may be merged already, its right one is not.
                many = np.isin(w, w[~first])
                h, m, mw = hit[many], made[many], w[many]
                before, after = np.maximum(h - 1, 0), np.minimum(h + 2, len(sym) - 1)
                left = sym[before]
                joined = np.flatnonzero(np.r_[False, h[1:] - h[:-1] == 2])
                left[joined] = m[joined - 1]
                has_left, has_right = (h > 0) & (word[before] == mw), (h + 2 < len(sym)) & (word[after] == mw)
                risky = (has_left & (self._best(left, m)[1] < least[h])) | (has_right & (self._best(m, sym[after])[1] < least[h]))
                if risky.any():
                    ok = first | ~np.isin(w, mw[risky])
                    hit, made = hit[ok], made[ok]
            sym[hit] = made
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols stand after compaction
            sym, word, char, piece, rank = (x[keep] for x in (sym, word, char, piece, rank))
            again = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            nxt = np.minimum(again + 1, len(sym) - 1)
            piece[again], rank[again] = self._best(sym[again], sym[nxt])
            rank[again[(nxt == again) | (word[nxt] != word[again])]] = top
        s, w, c = (np.concatenate(x) for x in (done_s, done_w, done_c))
        order = np.argsort(c, kind="stable")
        s, w, c = s[order], w[order], c[order]
        bounds = np.searchsorted(w, np.arange(len(short) + 1)).tolist()
        s, c = s.tolist(), c.tolist()
        limit = len(self.pieces)
        for n, k in enumerate(short):
            a, b = bounds[n], bounds[n + 1]
            ids = s[a:b]
            out[k] = ids if max(ids) < limit else [x for i in range(a, b) for x in self._emit(s[i], text[c[i]])]
        return out

    def encode(self, texts: list[str | None]) -> list[str]:
        """Comma-joined ids of each text."""
        cut = [self.cut(self.normalise(t)) if t else [] for t in texts]
        cache = self.cache
        new = list({w for words in cut for w in words if w not in cache})
        size = sum(map(len, new))
        if len(cache) + len(new) > CACHE or self.cached + size > CACHE_CHARS:
            cache.clear()
            self.cached = 0
            new = list({w for words in cut for w in words})
            size = sum(map(len, new))
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            cache.update(zip(some, (",".join(map(str, x)) for x in self.encode_words(some)), strict=True))
        self.cached += size
        out = [",".join([cache[w] for w in words]) for words in cut]
        for w in new:
            if len(w) > CACHED:
                del cache[w]
                self.cached -= len(w)
        return out

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: str) -> str:
        """Text of comma-joined ids: marks become spaces, the added prefix goes, runs of bytes are read as UTF-8."""
        if not ids:
            return ""
        table = self.__dict__.get("_table")
        if table is None:
            table = {}
            for i, p in enumerate(self.pieces):
                k = self.kinds[i]
                table[str(i)] = bytes([int(p[3:5], 16)]) if k == self.BYTE else b" \xe2\x81\x87 " if k == self.UNKNOWN else b"" if k == self.CONTROL else p.replace(MARK, " ").encode("utf-8")
            self._table = table
        tokens = ids.split(",")
        raw = b"".join(map(table.__getitem__, tokens))
        head = next((x for x in tokens if table[x]), "")
        if self.add_prefix and raw[:1] == b" " and self.pieces[int(head)].startswith(MARK):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _replace_bad(raw)


def _replace_bad(raw: bytes) -> str:
    """Every byte that starts no valid sequence becomes one replacement character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode("utf-8"))
            out.append("�")
            at += e.start + 1
    return "".join(out)


def model_of(blob: bytes) -> PieceModel:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceModel(blob)
    return _WORKER[key]


def encode_column(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, prefix: str = "") -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``with_ids`` also ``ids`` and ``decoded``.

    The model file (a few hundred kB) is read on the driver and broadcast.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = docs.sparkSession
    base.ship(spark)
    with open(model_path, "rb") as f:
        blob = base.share(spark, f.read())
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    h = base.Held(docs, keep, results, prefix, t=text)
    through, at = h.through, h.at["t"]
    schema = h.schema(*(T.StructField(r, T.LongType() if r == "n_tokens" else T.StringType()) for r in results))

    def run(batches):
        base.claim("pieces", _WORKER.clear)
        model = model_of(blob.value)
        for b in batches:
            lo = 0
            while lo < b.num_rows:  # few documents at a time: their words are held as lists meanwhile
                hi, size = lo, 0
                while hi < b.num_rows and (hi == lo or hi - lo < 200 and size < 1 << 20):
                    size += len(b.column(at)[hi].as_py() or "")
                    hi += 1
                part, lo = b.slice(lo, hi - lo), hi
                ids = model.encode(part.column(at).to_pylist())
                back = [model.decode(x) for x in ids]
                cols = [part.column(i) for i in through]
                cols += [pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
                if with_ids:
                    cols += [pa.array(ids, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))
