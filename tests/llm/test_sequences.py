"""Packing, fill-in-the-middle and centroids against brute force, and on awkward rows."""

import array
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import base, centroids, infill, packing, registry

SF = "/root/testdata/sf0.001"
WORDS = base.tokenizer_path(registry.WORDS)
AWKWARD = [None, "", " ", "\n\n", "a", "a b ", "!!!", "x" * 3_000, "wort " * 8_000, "é漢😀 \x00 ▁​", "İ ŉ Σας ΣΑΣ́ é ﬁ", "<|endoftext|> a<|startoftext|>b <|", "same text\x85 twice\xa0", "same text\x85 twice\xa0", "it's they'RE o'clock '' 's 'd12,5½"]


def frame(spark, texts):
    """Rows with null ids, repeated rows and columns that clash with names used inside."""
    rows = [(i, t, "t0", 1, 2, "r") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (4, "a", "t0", 1, 2, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, k0 string, length long, task long, nth string").repartition(3)


# -- packing ------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def bpe():
    with open(WORDS, "rb") as f:
        return packing.WordBpe(f.read())


def raw(ids):
    return array.array("I", ids).tobytes()


def test_words_as_the_library(bpe, library):
    rng = random.Random(5)
    alphabet = [*"aaabbbeiou  \n\t\r{}();.,'ésßÀŽ×÷12漢😀\x00\x1c\x85́ΣİK", "  ", "the", "'s", "'RE", "<|endoftext|>", "<|", "ing"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.randint(1, 26)], k=rng.randint(1, 700))) for _ in range(300)]
    texts += [t or "" for t in AWKWARD] + [chr(c) + "a" + chr(c) for c in range(0x20, 0x250)]
    for t in texts:
        assert bpe.text(t) == raw(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_merge_ranks_reach_every_token(bpe):
    """Each token of the vocabulary is what its own letters are merged to, so ranks and merges agree on every word."""
    rank = bpe.core._mergeable_ranks
    assert len(rank) == len(bpe.id_of) == len(set(bpe.id_of.tolist()))
    for token in rank:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 30), i))
            assert parts[best] + parts[best + 1] in rank
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def test_word_cache_is_emptied(bpe, library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    monkeypatch.setattr(packing, "CACHED", 3)
    for t in ("one two three four", "five six seven eight nine", "one two " * 5, "a-very-long-word one"):
        assert bpe.text(t) == raw(library.encode(t, add_special_tokens=False).ids)


def test_long_texts_in_stretches(bpe, library):
    text = "some words " * 150_000
    assert bpe.text(text) == raw(library.encode("some words", add_special_tokens=False).ids) * 150_000


def test_lengths_are_the_binary_digits():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 10**6 + 7):
        got = packing.lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert len(got) == n // 2048 + bin(n % 2048).count("1")


def checked_packing(rows, texts, library):
    """Every id in one piece of its document, every sequence whole, buckets numbered without a gap."""
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(ids)
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.length for r in pieces] == packing.lengths(len(ids[i])) and [r.start for r in pieces] == [sum(packing.lengths(len(ids[i]))[:k]) for k in range(len(pieces))]
        for r in pieces:
            part = ids[i][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[i]) and r.offset == 0
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in order] == list(range(len(order)))
    assert [r.length for r in order] == sorted((r.length for r in rows), reverse=True)
    for n in {r.length for r in rows}:
        assert sorted(r.bucket_row for r in rows if r.length == n) == list(range(sum(r.length == n for r in rows)))


def test_packing_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    checked_packing(registry.op11_packing(spark, SF).collect(), docs, library)


def test_packing_awkward(spark, library):
    docs = frame(spark, AWKWARD)
    out = packing.pack(docs, WORDS, keep=docs.columns, with_ids=True, prefix="p_")
    assert out.columns == [*docs.columns, *("p_" + c for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket_row", "ids"))]
    got = out.collect()
    for r in got:
        assert len(r.p_ids) == r.p_length and zlib.crc32(raw(r.p_ids)) == r.p_ids_crc32
    whole = collections.Counter((r.doc_id, r.text) for r in got if r.p_start == 0)
    assert whole == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    back = {r.doc_id: r for r in got if r.text == ""}
    assert [x.p_ids for x in back.values()] == [[1]]
    # Results named like kept columns take their place; another longest length; batches of one length.
    small = packing.pack(docs, WORDS, keep=("doc_id", "length", "nth"), most=64)
    assert small.columns == ["doc_id", "nth", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket_row"] and small.filter("length > 64").count() == 0
    for r in packing.batches(small, 128).groupBy("length", "batch").count().collect():
        assert r["count"] * r.length <= 128
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, most=100)


def test_packing_numbers_across_blocks_of_tasks(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2)
    docs = [(i, "word " * (i % 37)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    checked_packing(packing.pack(df, WORDS).collect(), docs, library)


def test_buckets_are_written_apart(spark, tmp_path):
    packed = packing.pack(frame(spark, AWKWARD), WORDS, with_ids=True)
    packing.write_buckets(packed, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == packed.count() and back.filter("size(ids) <> length").count() == 0


# -- fill in the middle --------------------------------------------------------
UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_units_as_the_pattern():
    rng, events = random.Random(6), infill.Events()
    for k in range(3000):
        text = "".join(rng.choices([*"ab  \t\n\x0b\x0c\r\x85\xa0\x1c é😀<", "<P>", "<S", "P>"], k=rng.randint(0, 40)))
        units = UNIT.findall(text)
        got = infill.Units(text, events, rng.choice([1, 2, 3, 7, 1 << 20]))
        assert (got.n, got.sentinel) == (len(units), "<P>" in text), repr(text)
        for r in rng.sample(range(len(units) + 1), min(4, len(units) + 1)):
            assert got.end(r) == len("".join(units[:r])), (repr(text), r)
        out = infill.rearrange(text, k, events)
        assert out == brute(text, k) and infill.restore(out[4], out[1]) == text


def test_infill_awkward(spark):
    docs = frame(spark, AWKWARD + ["a <S> b"] * 4 + ["one two  three\n"] * 60).withColumnRenamed("k0", "ends")
    out = infill.transform(docs, keep=docs.columns, with_output=True, prefix="n_").collect()
    assert len(out) == docs.count()
    for r in out:
        n, form, before, middle, text = brute(r.text, r.doc_id)
        assert (r.n_n, r.n_form, r.n_prefix_chars, r.n_middle_chars, r.n_output) == (n, form, before, middle, text)
        assert r.n_output_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.n_form for r in out} == {"plain", "spm", "psm"}
    assert infill.transform(docs.limit(0)).count() == 0


def test_infill_of_a_very_long_text():
    text = "wort  und\n" * 400_000
    got = infill.Units(text, infill.Events())
    assert got.n == 800_001 and got.end(2 * 399_999 + 1) == 10 * 399_999 + 4 and got.end(1) == 4


# -- centroids -----------------------------------------------------------------
def lloyd(rows, k=40, rounds=5, dims=64):
    """Whole numbers of any size, one row at a time."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [int(math.floor(256 * x)) if abs(x) < 2**40 else 256 * int(x) for x in v]) for i, v in fine]
    order = sorted(range(len(fine)), key=lambda r: (hashlib.sha256(f"2:{'' if fine[r][0] is None else fine[r][0]}".encode()).hexdigest(), fine[r][1]))
    cent = [whole[r][1] for r in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent)) for _, v in whole]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cent)):
            own = [v for (_, v), (_, c) in zip(whole, near, strict=True) if c == j]
            if own:
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    sums = collections.Counter()
    for d, c in near:
        sums[c] += d
    top = (1 << 63) - 1
    fit = lambda x: x if x <= top else None
    every = None if any(d > top for d, _ in near) else fit(sum(sums.values()))
    over = {c for d, c in near if d > top}
    return sorted(((i, c, fit(d), None if c in over else fit(sums[c]), every, hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(whole, near, strict=True)), key=str)


def clustered(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(map(tuple, centroids.cluster(df, **more).collect()), key=str)


def test_centroids_query_as_one_process(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, registry.op13_centroids(spark, SF).collect()), key=str) == lloyd(rows)


def test_centroids_awkward(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(3, [0.5] * 4)] * 5 + [(None, [0.5] * 4), (None, [0.25] * 4), (70, None), (71, [1.0] * 3), (72, [1.0, None, 1.0, 1.0]), (73, [float("nan")] * 4), (74, [float("inf"), 0.0, 0.0, 0.0]), (75, [-0.0] * 4)]
    assert clustered(spark, rows, k=5, dimensions=4) == lloyd(rows, 5, 5, 4)
    assert clustered(spark, rows[:3], k=5, dimensions=4) == lloyd(rows[:3], 5, 5, 4)
    assert clustered(spark, rows[-6:-1], k=5, dimensions=4) == []
    # Components beyond 64 bits, and distances beyond a long.
    far = rows + [(80, [1e6, -1e6, 3e5, 0.0]), (81, [1e18, 1e30, -1e38, 5.0]), (82, [-1e300, 1e300, 0.5, 0.5]), (83, [1e308, 1e308, 1e308, 1e308])]
    for k in (2, 7):
        got = clustered(spark, far, k=k, dimensions=4)
        assert got == lloyd(far, k, 5, 4) and any(r[2] is None for r in got) == (k == 2)
    # Kept columns of any name, and an empty table.
    df = spark.createDataFrame([(1, [0.5] * 4, "a", 9)], "vec_id long, embedding array<float>, k string, distance long")
    out = centroids.cluster(df, keep=df.columns, dimensions=4, prefix="c_")
    assert out.columns == [*df.columns, "c_cluster", "c_distance", "c_cluster_inertia", "c_inertia", "c_centroid_sha256"] and out.first().distance == 9
    assert centroids.cluster(df, keep=df.columns, dimensions=4).columns == ["vec_id", "embedding", "k", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(df.limit(0), dimensions=4).count() == 0


def test_ties_go_to_the_lowest_number():
    near = centroids.Nearest([[10, 0], [0, 10], [-10, 0], [0, -10], [10, 0]])
    assert near(np.array([[0, 0], [5, 5], [-5, -5], [-7, 0], [100, 0]], np.int64)).tolist() == [0, 0, 2, 2, 0]


def test_screening_is_exact_where_float32_is_not():
    """Distances that float32 cannot tell apart, at sizes up to the largest screened."""
    rng = np.random.default_rng(8)
    for size in (3, 1000, 1 << 20, (1 << 27) - 1):
        x = rng.integers(-size, size, (400, 64))
        cents = x[rng.integers(0, 400, 12)] + rng.integers(-1, 2, (12, 64))
        cents = np.clip(cents, -size, size)
        cents[5] = cents[3]
        gap = [[sum(int(a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents.tolist()] for v in x.tolist()]
        want = [min(range(12), key=lambda j: (g[j], j)) for g in gap]
        near = centroids.Nearest(cents.tolist())
        got = near(x)
        assert got.tolist() == want and near.distances(x, got) == [g[j] for g, j in zip(gap, want, strict=True)]


def test_vocabulary_file_is_a_parameter():
    with open(WORDS, "rb") as f:
        assert len(json.load(f)["model"]["vocab"]) > 1000
