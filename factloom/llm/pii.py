"""Personal data: base patterns, and information-theoretic sanitisation around them.

Base kinds are e-mail addresses, IP addresses, payment cards and phone numbers,
leftmost and non-overlapping per kind, by linear scans.  Unbroken strings of high
information (keys, tokens) are spans of kind ``secret``.  Each found value is a
protected entity.  A term (word) near mentions of an entity discloses it when the
corpus says so: with document counts, the pointwise mutual information

    PMI(term, entity) = log2( p(term, entity) / (p(term) p(entity)) )

leaves at most ``RESIDUAL`` bits of the entity's information -log2 p(entity): of the documents with the term
at least one in 2^RESIDUAL has the entity.  (For an entity that many documents name, the PMI must also reach half of its
information, or every word would disclose it.)  The estimate of p(entity | term) is its lower confidence bound: the term
discloses the entity when as many joint documents as were seen would come about with a chance of at
most ``DOUBT``, divided by the number of terms tried with that entity, if p(entity | term) were just at the threshold.
Neither threshold nor doubt depends on the size of the corpus.  Copies are no evidence: equal texts count as one
document, and of joint documents that are near copies (the least hash of the five-word shingles outside their spans agrees) one counts
for the confidence.  Evidence is also pooled above the single value, as what a value belongs to (``pool``: an address's
domain, a network, a card's issuer, a phone's area) is an entity like the value itself.

A term and an entity stand together in a document, wherever in it.  Such terms are
spans of kind ``term`` in all texts, the whole of each, with or without a mention: where
the entity is not named, the term is what discloses it.  Sanitising replaces base spans
by their kind and generalises disclosing terms (a number to ``[NUMBER]``) or removes them
(``[TERM]``).  Documents without a mention or a disclosing term are never changed.

All counts cover the whole corpus.  Terms' document counts are taken only for
candidate terms, let through by a Bloom filter of fixed size (a full filter lets
more through, and the join after it is exact); so are the words looked up for spans.
Entities of too few documents to reach the threshold with any term form no pairs, and entities of the very same
documents (a directory of addresses) form them together.  Null and empty texts have no spans.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import base

KINDS = ("email", "ip", "card", "phone")
#: Bits of an entity that a disclosing term may leave open (5: fewer than 32 candidates), and the doubt for an entity.
RESIDUAL, DOUBT = 5.0, 0.05
#: Words of a shingle by which near copies are told.
SHINGLE = 5
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")
_KEYLIKE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
#: Bits of information (by its own symbol shares) that make an unbroken string a secret.
SECRET_BITS = 64.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    for m in _CHAIN.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def bits(word: str) -> float:
    """Information of a string under its own symbol shares."""
    n = len(word)
    return sum(k * math.log2(n / k) for k in collections.Counter(word).values())


def secrets(text: str | None, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Keys, tokens and the like: unbroken strings of letters and digits mixed with at least ``SECRET_BITS``, outside ``spans``.

    Words and numbers alone are none, nor is a string in which digits only end or begin words.
    """
    out = []
    for m in _KEYLIKE.finditer(text or ""):
        word = m.group()
        mixed = sum(a.isdigit() != b.isdigit() for a, b in itertools.pairwise(c for c in word if c.isalnum()))
        if mixed >= 4 and bits(word) >= SECRET_BITS:
            out.append(("secret", *m.span()))
    if out and spans:
        covered = _covered(text, spans)
        out = [x for x in out if not covered[x[1] : x[2]].any()]
    return out


def _covered(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(text) + 1, bool)
    for _, s, e in spans:
        out[s:e] = True
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then start; code points, end exclusive."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", s, e) for s, e in _ips(text)]
    out += [("card", s, e) for s, e in _cards(text)]
    if "+" in text:
        out += [("phone", s, e) for s, e in _phones(text)]
    return out


def pool(kind: str, value: str) -> str | None:
    """What a value belongs to: an address's domain, a network of 256, a card's issuer, a phone's country and area; a secret to nothing."""
    if kind == "secret":
        return None
    if kind == "email":
        return value.rpartition("@")[2]
    if kind == "ip":
        return value.rpartition(".")[0]
    digits = "".join(c for c in value if "0" <= c <= "9")
    return digits[:6] if kind == "card" else digits[:5]


def entities(kind: str, value: str) -> list[int]:
    """The value and its pool, as numbers."""
    above = pool(kind, value.lower())
    names = [f"{kind}:{value.lower()}", *([f"{kind}*{above}"] if above is not None else [])]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def chance(k: int, m: int, p: float) -> float:
    """P(X >= k) of a binomial X of m trials of probability p, with k / m above p or nearly so."""
    if p >= 1 or k <= 0:
        return 1.0
    term = math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, m + 1):
        total += term
        term *= (m - i) / (i + 1) * p / (1 - p)
        if term < total * 1e-12:
            break
    return total


def threshold(entity_docs: int, total: int, residual: float = RESIDUAL) -> float:
    """The least p(entity | term) of a disclosing term."""
    return max(2.0**-residual, math.sqrt(entity_docs / total))


def reveals(together: int, term_docs: int, entity_docs: int, total: int, classes: int | None = None, tried: int = 1, residual: float = RESIDUAL, doubt: float = DOUBT) -> bool:
    """Whether p(entity | term) reaches its threshold, by its lower confidence bound with ``tried`` terms; ``classes`` of the joint documents are no near copies of each other."""
    least, classes = threshold(entity_docs, total, residual), together if classes is None else classes
    return least < 1 and together > least * term_docs and chance(classes, term_docs - (together - classes), least) <= doubt / tried


def near_class(words: list[str]) -> str:
    """The least hash of a text's shingles: near copies have it in common as often as they have shingles in common."""
    n = min(SHINGLE, len(words))
    return min((hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest() for i in range(len(words) - n + 1)), default="") if n else ""


def words_outside(text: str, spans: list[tuple[str, int, int]], among: set[str] | None = None):
    """(word, start, end) of the lower-cased words (of ``among``, where given) that no span touches."""
    covered = _covered(text, spans) if spans else None
    for m in _TERM.finditer(text):
        word = m.group().lower()
        if (among is None or word in among) and (covered is None or not covered[m.start() : m.end()].any()):
            yield word, m.start(), m.end()


_LONGS, _STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, id, h, base, secrets, entities, words, near) of every row; h is of its text, entities and words are distinct, they and near of rows with spans; key names a row by its id and text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    src = docs.select(_key(doc_id, text).alias("key"), base.column(doc_id).alias("id"), _text_hash(text).alias("h"), base.column(text).alias("text"))
    schema = T.StructType([T.StructField("key", T.StringType()), src.schema["id"], T.StructField("h", T.LongType()), T.StructField("base", _SPAN), T.StructField("secrets", _SPAN), T.StructField("entities", _LONGS), T.StructField("words", _STRINGS), T.StructField("near", T.StringType())])

    def run(batches):
        base.claim("pii")
        arrow = to_arrow_schema(schema)
        for b in batches:
            base_, hidden, own, words, near = [], [], [], [], []
            for t in b.column(3):
                t = t.as_py()
                spans = base_spans(t)
                more = secrets(t, spans)
                for to, some in ((base_, spans), (hidden, more)):
                    to.append([{"kind": k, "s": s, "e": e} for k, s, e in some])
                spans = spans + more
                own.append(sorted({x for k, s, e in spans for x in entities(k, t[s:e])}))
                outside = [w for w, _, _ in words_outside(t, spans)] if spans else []
                words.append(sorted(set(outside)))
                near.append(near_class(outside) if spans else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, arrow.field(3 + k).type) for k, x in enumerate((base_, hidden, own, words, near)))], names=schema.names)

    return src.mapInArrow(run, schema)


def _terms(text: str) -> set[str]:
    """The lower-cased words.  Lower-casing the whole text first is the same but for two letters: one grows, one depends on what follows."""
    if "\u0130" in text or "\u03a3" in text:
        return {w.lower() for w in set(_TERM.findall(text))}
    return set(_TERM.findall(text.lower()))


class _Known:
    """Which words a filter lets through, remembered for the words of a worker."""

    MOST = 300_000

    def __init__(self, bloom):
        self.bloom, self.yes, self.no = bloom, set(), set()

    def among(self, words: set[str]) -> set[str]:
        new = words - self.no - self.yes
        if new:
            if len(self.no) + len(self.yes) > self.MOST:
                self.yes, self.no, new = set(), set(), words
            hit = {w for w in new if w in self.bloom}
            self.yes |= hit
            self.no |= new - hit
        return words & self.yes


def disclosing(scan: DataFrame, docs: DataFrame, text: str, residual: float = RESIDUAL, doubt: float = DOUBT) -> DataFrame:
    """(entity, term) pairs whose information reaches the threshold; of entities that stand in the same documents one."""
    import pyarrow as pa

    spark = docs.sparkSession
    total = scan.select("h").distinct().count()
    least = F.greatest(F.lit(2.0**-residual), F.sqrt(F.col("entity_docs") / F.lit(float(max(total, 1)))))
    some = 1 + 1e-9
    own = base.cut(scan.filter(F.size("entities") > 0).dropDuplicates(["h"]).select("h", "near", "entities", "words"), "pii-mentions")
    each = own.select("h", "near", F.size("words").alias("w"), F.explode("entities").alias("entity"))
    mention = each.groupBy("entity").agg(F.count("*").alias("entity_docs"), F.count_distinct("near").alias("classes"), F.max("w").alias("w"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    # At best all documents of the entity have the term and no others do, and the words of one of them are tried: an entity for which that is too little has no pairs.
    mention = mention.filter((least < 1) & (F.pow(least, F.col("classes")) <= F.lit(doubt) / F.greatest("w", F.lit(1)) * some))
    mention = base.cut(mention.groupBy("entity_docs", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "entity_docs"), "pii-entities")
    said = own.select("near", "words", F.explode("entities").alias("entity")).join(mention.select("entity"), "entity", "left_semi")
    pair = said.select("entity", "near", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("together"), F.count_distinct("near").alias("classes"))
    pair = base.cut(pair, "pii-tried")
    tried = pair.groupBy("entity").agg(F.count("*").alias("tried"))
    pair = pair.join(mention.join(tried, "entity"), "entity")
    # The same for the pair: its documents alone, if the term were in no others.
    pair = pair.filter(F.pow(least, F.col("classes")) <= F.lit(doubt) / F.col("tried") * some)

    def decide(batches):
        for b in batches:
            keep = [reveals(k, m, e, total, c, n, residual, doubt) for k, c, m, e, n in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    def decided(pairs, docs_of_term):
        with_counts = pairs.join(docs_of_term, "term").select("entity", "term", "together", "classes", "term_docs", "entity_docs", "tried")
        # More documents of the term only make it say less, so a count of some of them can rule it out.
        return with_counts.filter(F.col("together") > least * F.col("term_docs") * (1 - 1e-9)).mapInArrow(decide, with_counts.schema)

    mentioning = own.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    pair = base.cut(decided(pair, mentioning).drop("term_docs"), "pii-pairs")

    shared = base.share(spark, base.Bloom.of(pair.select("term").distinct(), "term"))

    def seen(batches):
        base.claim("pii")
        known = _Known(shared.value)
        met: set[tuple[str, int]] = set()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in met], pa.string()), pa.array([h for _, h in met], pa.int64())], names=["term", "h"])
            met.clear()
            return out

        for b in batches:
            for t, h in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                met.update((w, h) for w in known.among(_terms(t.as_py())))
            if len(met) > 200_000:
                yield flush()
        if met:
            yield flush()

    # Candidates are few by now, and each text counts once, however often it was copied.
    df = docs.select(base.column(text).alias("t"), _text_hash(text).alias("h")).filter("t is not null").mapInArrow(seen, "term string, h long").distinct().groupBy("term").agg(F.count("*").alias("term_docs"))
    return decided(pair, df).select("entity", "term")


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(base.column(text), F.lit("")))


def _key(doc_id: str, text: str) -> F.Column:
    return F.concat(F.coalesce(base.column(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64(F.coalesce(base.column(text), F.lit("")))))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``id`` and the ``base``, ``secrets`` and ``terms`` spans of each row (equal rows are equal here)."""
    base.ship(docs.sparkSession)
    scan = base.cut(_scan(docs, doc_id, text), "pii-scan")
    pairs = disclosing(scan, docs, text)
    terms = occurrences(docs, pairs.select("term").distinct(), doc_id, text)
    return scan.select("key", "id", "base", "secrets").join(terms, "key", "left")


def occurrences(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key`` and the spans of ``terms`` in each whole text that has some, outside its base spans."""
    import pyarrow as pa

    spark, terms = docs.sparkSession, base.cut(terms, "pii-terms")
    shared = base.share(spark, base.Bloom.of(terms, "term"))

    def run(batches):
        base.claim("pii")
        known = _Known(shared.value)
        for b in batches:
            rows: list[tuple[str, str, int, int]] = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = known.among(_terms(t))
                if hits:
                    spans = base_spans(t)
                    rows += [(key, w, s, e) for w, s, e in words_outside(t, spans + secrets(t, spans), hits)]
            kinds = pa.string(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "term", "s", "e"])

    at = docs.select(_key(doc_id, text).alias("key"), base.column(text).alias("t")).filter("t is not null").mapInArrow(run, "key string, term string, s long, e long")
    return at.join(terms, "term", "left_semi").select("key", F.struct(F.lit("term").alias("kind"), "s", "e").alias("x")).groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("terms"))


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, digest of the base spans, and all spans."""
    found = find(docs, doc_id, text)
    every = F.concat("base", "secrets", F.coalesce("terms", F.array().cast(_SPAN)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(doc_id), *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("secrets").cast("long").alias("n_secret"), F.size(F.coalesce("terms", F.array().cast(_SPAN))).cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"))


def replace(text: str | None, base_: list, terms: list | None) -> str | None:
    """The text with spans replaced; overlapping ones go together under the first kind."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted([(x["s"], x["e"], x["kind"]) for x in [*base_, *(terms or [])]]):
        if merged and k < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s)
        else:
            merged.append([k, s, e])
    for s, e, kind in merged:
        word = ("[NUMBER]" if text[s:e].isdigit() else "[TERM]") if kind == "term" else f"[{kind.upper()}]"
        out += [text[at:s], word]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their text sanitised; its columns may have any names."""
    import pyarrow as pa

    h = base.Held(docs, docs.columns, (), id=doc_id, t=text)
    found = find(h.rows, "id", "t").select("key", F.concat("base", "secrets").alias("base"), "terms").filter((F.size("base") > 0) | F.col("terms").isNotNull())
    found = base.cut(found.dropDuplicates(["key"]), "pii-found")
    # Most rows have no span and pass as they are; only those that may have one are shuffled.
    rows, bloom = h.rows.withColumn("key", _key("id", "t")), base.Bloom.of(found, "key")
    got = base.sift(rows, "key", bloom, True).join(found, "key", "left")
    cols = h.rows.columns
    schema, at = T.StructType([h.rows.schema[c] for c in cols]), cols.index("t")

    def run(batches):
        base.claim("pii")
        k = len(cols)
        for b in batches:
            new = pa.array([replace(t.as_py(), x.as_py() or [], y.as_py()) if x.is_valid else t.as_py() for t, x, y in zip(b.column(at), b.column(k), b.column(k + 1), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(k)], names=cols)

    return h.named(base.sift(rows, "key", bloom, False).select(*cols).unionAll(got.select(*cols, "base", "terms").mapInArrow(run, schema)))
