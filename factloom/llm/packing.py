"""Documents packed without padding by power-of-two decomposition.

A document's ids (and the id that ends it) are cut into pieces whose lengths are powers of two: as many
of ``most`` ids as fit, then the binary digits of the rest, longest first.  Every piece is a sequence of
its own, so no sequence crosses documents and none is padded.  Sequences of one length are a bucket;
buckets are numbered one after another, longest first, so that batches of equal lengths are ranges of
``bucket_row``.

Ids are those of the ``tokenizers`` library for a lower-casing BPE with word ends.  White space parts words,
so texts are encoded by word: plain ones by the merge ranks directly, words with letters beyond Latin,
marks, or the text of a special token by the library itself.  A worker keeps words it has met (bounded).

Numbers need no order of all rows: a task counts its own sequences by length, the counts of tasks are
summed in blocks of tasks, and a sequence's number is what lies before its task and its place there.

Null and empty texts have the end id only (one piece of one id).  Texts may have any length: memory is a few
times the text.  Repeated rows and rows of equal or null ids are packed each for itself.  An empty
table gives no rows.  Kept columns may have any names; one of a result's name gives way to the result.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

#: Ids of the longest sequence (a power of two), and the id that ends a document.
MOST, END = 2048, 1
#: Entries and characters of a worker's word cache, and the longest word in it.
CACHE, CACHE_CHARS, CACHED = 200_000, 4 << 20, 100
#: Characters encoded at a time.
STRETCH = 1 << 20
#: A word of more letters goes to the library, whose merges do not slow down with its length.
LONG = 200
#: Tasks in a block of the numbering.
BLOCK = 1024
_WORKER: dict[str, "WordBpe"] = {}

_LETTERS = "a-zÀ-ÖØ-öø-ſ"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r 0-9{_LETTERS}]+")
_OTHER = re.compile("[^\\x00-\\x7fÀ-įı-ſ]|<\\|")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class WordBpe:
    """Ids of words as little-endian 32-bit integers.

    In the ranks a line feed stands for the end of a word (no word holds one): its pair with the last
    byte has the lowest rank of all, so it is merged first, as the vocabulary has it.
    """

    END = "</w>"

    def __init__(self, blob: bytes):
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(blob)
        model, letters = json.loads(blob)["model"], _bytes_of_letters()
        vocab = model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith(self.END)
            return bytes(map(letters.__getitem__, token.removesuffix(self.END))) + b"\n" * end

        tokens = [x + e for e in ("", self.END) for x in letters]
        tokens += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks = {raw(x): i for i, x in enumerate(tokens)}
        self.core = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.array([vocab[x] for x in tokens], "<u4")
        self.ends = np.array([x.endswith(self.END) for x in tokens])
        self.cache: dict[str, bytes] = {"": b""}
        self.chars = 0

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        parts, owners, other = [], [], []
        for i, w in enumerate(words):
            if w.isalpha() and w.isascii() and len(w) <= LONG:
                parts.append(w.lower())
                owners.append(i)
            elif _OTHER.search(w) or len(w) > LONG:
                other.append(i)
            else:
                got = _PARTS.findall(w.lower())
                parts += got
                owners += [i] * len(got)
        if parts:
            tokens = self.core.encode_to_numpy("\n".join(parts) + "\n", disallowed_special=())
            stops = np.flatnonzero(self.ends[tokens]) + 1  # one for each part
            last = np.flatnonzero(np.r_[np.diff(owners) > 0, True])
            raw, lo = self.id_of[tokens].tobytes(), 0
            for i, hi in zip(np.array(owners)[last].tolist(), (4 * stops[last]).tolist(), strict=True):
                out[i], lo = raw[lo:hi], hi
        for i in other:  # one at a time: long words make large encodings
            out[i] = array.array("I", self.library.encode_batch_fast([words[i]], add_special_tokens=False)[0].ids).tobytes()
        return out

    def text(self, text: str) -> bytes:
        """Ids of a text, a stretch at a time."""
        out, lo = [], 0
        while lo < len(text):
            hi = lo + STRETCH
            if hi < len(text):  # to the next space
                at = text.find(" ", hi)
                hi = len(text) if at < 0 else at
            out += self._stretches([text[lo:hi]])
            lo = hi
        return b"".join(out)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; the new words of short ones are encoded together."""
        if sum(map(len, texts)) <= STRETCH:
            return self._stretches(texts)
        return [self.text(t) for t in texts]

    def _stretches(self, texts: list[str]) -> list[bytes]:
        cut, cache = [t.replace("\n", " ").split(" ") for t in texts], self.cache
        new = list(set().union(*cut).difference(cache))
        size = sum(map(len, new))
        if new and (len(cache) + len(new) > CACHE or self.chars + size > CACHE_CHARS):
            cache.clear()
            self.chars, new = 0, list(set().union(*cut))
            size = sum(map(len, new))
        if new:
            cache.update(zip(new, self.words(new), strict=True))
            self.chars += size
        out = [b"".join(map(cache.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > CACHED:
                del cache[w]
                self.chars -= len(w)
        return out


def _bpe(blob: bytes) -> WordBpe:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordBpe(blob)
    return _WORKER[key]


def lengths(tokens: int, most: int = MOST) -> list[int]:
    """The pieces of a document of so many ids: whole sequences, then the binary digits of the rest."""
    whole, rest = divmod(tokens, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MOST, end: int = END, with_ids: bool = False, prefix: str = "") -> DataFrame:
    """A row per piece: ``keep`` columns, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``bucket_row``; with ``with_ids`` also ``ids``.

    ``start`` is the number of its document's ids before the piece, ``bucket_row`` its number among the sequences
    of its length.  The tokenizer's file (a few MB) is read on the driver and broadcast.
    """
    import pyarrow as pa

    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    base.ship(spark)
    with open(model_path, "rb") as f:
        blob = base.share(spark, f.read())
    own = ["start", "length", "ids_crc32", "doc_tokens"]
    results = [*own, "sequence_id", "offset", "bucket_row", *(["ids"] if with_ids else [])]
    h = base.Held(docs, keep, results, prefix, t=text)
    through, at = h.through, h.at["t"]
    counted = [*own, "task", "nth"]
    schema = h.schema(*(T.StructField(c, T.LongType()) for c in counted), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches):
        from pyspark import TaskContext

        base.claim("packing", _WORKER.clear)
        bpe, task, met = _bpe(blob.value), TaskContext.get().partitionId(), {}
        last = array.array("I", [end]).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                row, rows, ids = [], [], []
                for i, raw in enumerate(bpe.texts([t or "" for t in part.column(at).to_pylist()])):
                    raw = memoryview(raw + last)
                    tokens, start = len(raw) // 4, 0
                    for n in lengths(tokens, most):
                        piece = raw[4 * start : 4 * (start + n)]
                        rows.append((start, n, zlib.crc32(piece), tokens, task, met.get(n, 0)))
                        row.append(i)
                        met[n] = met.get(n, 0) + 1
                        start += n
                        if with_ids:
                            ids.append(piece.cast("I").tolist())
                cols = [part.column(i).take(pa.array(row, pa.int64())) for i in through]
                cols += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    # The table fixes which task counted which sequence, whatever is lost afterwards.
    table = base.cut(h.rows.mapInArrow(run, schema), "packing")
    counts = table.groupBy("length", "task").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("task") / BLOCK))
    inside = Window.partitionBy("length", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before.select("length", "block", "before"), ["length", "block"])
    places = places.select(F.col("length").alias("l"), F.col("task").alias("k"), (F.col("before") + F.col("inside")).alias("first"))
    buckets, base_of = blocks.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect(), {}  # a row per power of two
    for r in buckets:
        base_of[r.length] = sum(x.n for x in buckets if x.length > r.length)
    first = F.create_map(*(F.lit(x).cast("long") for pair in base_of.items() for x in pair)) if base_of else F.lit(None).cast("map<long,long>")
    out = table.join(places, (F.col("length") == F.col("l")) & (F.col("task") == F.col("k")))
    out = out.withColumn("bucket_row", F.col("first") + F.col("nth")).withColumn("offset", F.lit(0).cast("long"))
    return h.named(out.withColumn("sequence_id", F.element_at(first, F.col("length")) + F.col("bucket_row")))


def batches(packed: DataFrame, tokens: int, prefix: str = "") -> DataFrame:
    """``packed`` with ``batch``: sequences of one length, about ``tokens`` ids together (one sequence at least)."""
    size = F.greatest(F.floor(F.lit(tokens) / base.column(prefix + "length")), F.lit(1))
    return packed.withColumn(prefix + "batch", F.floor(base.column(prefix + "bucket_row") / size).cast("long"))


def write_buckets(packed: DataFrame, path: str, prefix: str = "") -> None:
    """One folder of Parquet files for each length."""
    packed.write.partitionBy(prefix + "length").parquet(path)
