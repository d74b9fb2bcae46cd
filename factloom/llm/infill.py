"""Fill-in-the-middle rearrangement by a sparse scan of events.

A unit is a run of other characters with the white space before it, or the white space at a text's end.
One Aho-Corasick automaton finds the characters that change class (the six ASCII spaces) and the
sentinels.  A gap between two spaces is one unit, whatever its length, so the number of units is the number of
gaps (and one at the end), and the end of unit r is the space that follows gap r: no character is
classed and no unit is built.  Long texts are scanned a stretch at a time; a stretch keeps only the number of
units before it, and the two that hold the cuts are scanned again.

The two cuts and the form come from the hash of a seed and the document's id alone.  A text that is
empty or holds a sentinel stays plain; every other output can be turned back, as each sentinel is in it once.

Null texts are empty.  A null id hashes as no digits.  Repeated rows give the same output each.  An empty table
gives no rows.  Kept columns may have any names; one of a result's name gives way to the result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm import base

SEED = 42
#: Of a hundred documents so many are rearranged, and of a hundred of those so many suffix first.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SPACES = "\t\n\v\f\r "
#: Characters of a stretch.
STRETCH = 1 << 20
_WORKER: dict[tuple, "Events"] = {}


class Events:
    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        import ahocorasick

        self.automaton, self.over = ahocorasick.Automaton(), max(map(len, sentinels)) - 1
        for c in SPACES:
            self.automaton.add_word(c, 0)
        for s in sentinels:
            self.automaton.add_word(s, 1)
        self.automaton.make_automaton()

    def stretch(self, text: str, lo: int, hi: int, last: int):
        """Ends of the units that a space of ``text[lo:hi]`` ends, the last space so far, and whether a sentinel begins there."""
        import numpy as np

        got = np.fromiter(self.automaton.iter(text, lo, min(hi + self.over, len(text))), dtype=[("at", "i8"), ("sentinel", "i8")])
        spaces = got["at"][(got["sentinel"] == 0) & (got["at"] < hi)]
        ends = spaces[np.diff(spaces, prepend=last) > 1]
        return ends, int(spaces[-1]) if len(spaces) else last, bool(got["sentinel"].any())


class Units:
    """Units of one text: their number, and where a unit ends."""

    def __init__(self, text: str, events: Events, stretch: int = STRETCH):
        self.text, self.events, self.step = text, events, stretch
        self.before, self.last, self.sentinel, self.n = [], [], False, 0
        at = -1
        for lo in range(0, len(text), stretch):
            self.before.append(self.n)
            self.last.append(at)
            self.ends, at, found = events.stretch(text, lo, lo + stretch, at)
            self.n += len(self.ends)
            self.sentinel |= found
        self.held = len(self.before) - 1  # the stretch whose ends are at hand
        self.n += bool(text)

    def end(self, rank: int) -> int:
        """The place after the first ``rank`` units."""
        if rank <= 0 or rank >= self.n:
            return len(self.text) if rank > 0 else 0
        k = bisect.bisect_left(self.before, rank) - 1
        if k != self.held:
            self.ends, _, _ = self.events.stretch(self.text, k * self.step, (k + 1) * self.step, self.last[k])
            self.held = k
        return int(self.ends[rank - self.before[k] - 1])


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, doc_id, events: Events, seed: int = SEED, rate: int = RATE, spm: int = SPM):
    """Units, form, characters of prefix and middle (None where plain), and the output."""
    units, (h1, h2, h3, h4) = Units(text, events), draws(doc_id, seed)
    n = units.n
    if not text or units.sentinel or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = map(units.end, sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, rate: int = RATE, spm: int = SPM, with_output: bool = False, prefix: str = "") -> DataFrame:
    """``keep`` columns, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256``, ``restored_sha256``; with ``with_output`` also ``output``."""
    import pyarrow as pa

    base.ship(docs.sparkSession)
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output_sha256": T.StringType(), "restored_sha256": T.StringType()}
    if with_output:
        kinds["output"] = T.StringType()
    h = base.Held(docs, keep, list(kinds), prefix, t=text, i=doc_id)
    through, at, key = h.through, h.at["t"], h.at["i"]
    schema = h.schema(*(T.StructField(c, t) for c, t in kinds.items()))

    def digest(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches):
        base.claim("infill", _WORKER.clear)
        if SENTINELS not in _WORKER:
            _WORKER[SENTINELS] = Events()
        events = _WORKER[SENTINELS]
        for b in batches:
            rows = []
            for t, i in zip(b.column(at), b.column(key), strict=True):
                n, form, before, middle, out = rearrange(t.as_py() or "", i.as_py(), events, seed, rate, spm)
                rows.append((n, form, before, middle, digest(out), digest(restore(out, form)), *((out,) if with_output else ())))
            made = [pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in through] + made, names=schema.names)

    return h.named(h.rows.mapInArrow(run, schema))
