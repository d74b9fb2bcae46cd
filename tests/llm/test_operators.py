"""Each operator against a brute-force version, an exact library or held-out truth, and on awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from factloom.llm import base, decontaminate, jaccard, language, licenses, pieces, pii, quality, registry, simhash, tokens, toxicity

MODEL = base.tokenizer_path(registry.PIECES)
AWKWARD = [None, "", " ", "\n\n", "a", "a b", "!!!", "x" * 30_000, "wort " * 8_000, "é漢😀 \x00 ▁", "the same text again and again " * 3, "the same text again and again " * 3]


def frame(spark, texts, **more):
    """Rows with null ids, repeated rows and columns that clash with names used inside."""
    rows = [(i, t, "key", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long, base string").repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    df = frame(spark, AWKWARD)
    return df.unionAll(spark.createDataFrame([(None, None, None, None, None), (None, "no id here", "k", 2, "y"), (4, "a", "key", 1, "x")], df.schema)).cache()


@pytest.fixture(scope="module")
def nothing(spark, awkward):
    return awkward.limit(0)


def ids(df, column="doc_id"):
    return sorted(str(r[0]) for r in df.select(column).collect())


# -- op8 ------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


def test_pieces_as_the_library(model, library):
    rng = random.Random(4)
    alphabet = [*"aaabbb  tth▁\n\r\t{}();.,eé漢😀\x00", "  ", "the", "</s>", "<0x0A>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.randint(1, 26)], k=rng.randint(1, 700))) for _ in range(300)]
    texts += [t or "" for t in AWKWARD]
    got = model.encode(texts)
    assert got == [",".join(map(str, x)) for x in library.encode(texts)]
    assert [model.decode(x) for x in got] == library.decode(library.encode(texts))


def test_piece_rounds_equal_the_heap(model):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcetho▁", k=rng.randint(1, 80))) for _ in range(500)]
    assert model.encode_words(words) == [model._heap(w) for w in words]


def test_pieces_query(awkward, nothing, library):
    got = pieces.encode_column(awkward, MODEL, with_ids=True).collect()
    assert len(got) == awkward.count()
    truth = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in got:
        if r.doc_id is not None:
            want = library.encode(truth[r.doc_id])
            assert r.n_tokens == len(want) and r.ids == ",".join(map(str, want))
            assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert pieces.encode_column(nothing, MODEL).count() == 0


# -- op7 ------------------------------------------------------------------
def test_token_counts_as_greedy_pieces(awkward, nothing):
    word_piece = pytest.importorskip("tokenizers").models.WordPiece
    with open(MODEL, "rb") as f:
        start, inner = tokens.vocabulary(f.read())
    vocab = {p: i for i, p in enumerate([*start, *("##" + p for p in inner), "[UNK]"])}
    greedy = word_piece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)
    machine = tokens.LongestMatch(start, inner)
    rng = random.Random(6)
    for _ in range(4000):
        w = "".join(rng.choices("aé漢theng😀ions", k=rng.randint(1, 14)))
        want = greedy.tokenize(w)
        n = machine.count(w)
        assert (n & ((1 << 40) - 1), n >> 40) == (len(want), int(want[0].value == "[UNK]"))
    got = {r.doc_id: r for r in tokens.token_counts(awkward, MODEL).collect()}
    assert got[0].n_words == got[0].n_tokens == got[1].n_tokens == 0 and got[8].n_words == 8000
    assert tokens.token_counts(nothing, MODEL).count() == 0


# -- op10 -----------------------------------------------------------------
def brute_hits(text, items, width):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = decontaminate.words_of(t)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            w = own[k : k + width]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), found


def test_fm_index_against_brute_force(monkeypatch):
    rng = random.Random(7)
    for trial in range(200):
        letters = [chr(97 + i) for i in range(rng.choice([2, 3, 8]))]
        items = [(str(i), " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 14])))) for i in range(rng.randint(0, 5))]
        if trial % 2:
            items = [x for x in items if len(x[1].split()) > 2]
        docs = [" ".join(rng.choices(letters + ["zz"] * rng.randint(0, 2), k=rng.randint(0, 60))) for _ in range(6)]
        monkeypatch.setattr(decontaminate, "SHARD", rng.choice([500_000, 40, 7]))
        windows = decontaminate.Windows(items)
        for d, (n, spans, found) in zip(docs, decontaminate.search(docs, windows), strict=True):
            assert (n, sum(e - s for s, e in spans), found) == brute_hits(d, items, 10)


def test_suffix_array():
    rng = random.Random(17)
    for _ in range(300):
        text = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))] * rng.randint(1, 3) + [0]
        key = lambda i: [(x > 0, x or j) for j, x in enumerate(text[i:], i)]  # noqa: E731 - breaks before words, by place
        assert decontaminate.FMIndex._suffixes(np.array(text)).tolist() == sorted(range(len(text)), key=key)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 9, 1000)
    ranks = decontaminate.Ranks(seq, 8)
    at, symbol = rng.integers(0, 1001, 300), rng.integers(0, 9, 300)
    assert ranks.rank(symbol, at).tolist() == [(seq[:a] == s).sum() for a, s in zip(at, symbol, strict=True)]
    assert ranks.symbol(np.arange(1000)).tolist() == seq.tolist()


@pytest.mark.parametrize("block", [2_000_000, 9])
def test_decontaminate_query(spark, awkward, nothing, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "the SAME text"), (3, None), (None, "a b c"), (4, ""), (5, "a b")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = awkward.unionByName(frame(spark, ["x One, two three four five six seven eight nine TEN eleven y", "one two three"]).selectExpr("doc_id + 100 doc_id", "text", "key", "n", "base"))
    found = decontaminate.find(docs, bench)
    got = {r.doc_id: r for r in decontaminate.digest(found).collect()}
    named = [(str(i), t) for i, t in items if i is not None]
    for r in docs.collect():
        if r.doc_id is not None:
            n, hit, its = brute_hits(r.text, named, 10)
            g = got[r.doc_id]
            assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(its), hit > 0)
            assert g.items_sha256 == hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()
    gone = decontaminate.remove(docs, bench, prefix="r_")
    assert gone.columns == [*docs.columns, "r_n_cut"]
    cut = {r.doc_id: (r.text, r.r_n_cut) for r in gone.collect()}
    assert cut[100] == ("x  y", 11) and cut[101] == ("one two three", 0) and cut[0] == (None, 0)
    assert decontaminate.find(nothing, bench).count() == 0
    assert decontaminate.digest(decontaminate.find(docs, bench.limit(0))).filter("contaminated").count() == 0


def test_cut_leaves_no_window(spark, monkeypatch):
    """Cutting may join words to a new window, of another block of the benchmark too: blocks change nothing."""
    rng = random.Random(21)
    items = [(i, " ".join(rng.choices("abcd", k=rng.choice([2, 3, 11])))) for i in range(6)]
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 50)))) for i in range(60)]
    bench, docs = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    windows = decontaminate.Windows([(str(i), t) for i, t in items])
    want = {}
    for i, t in rows:
        while spans := decontaminate.search([t], windows)[0][1]:
            t = decontaminate.without(t, spans)
        want[i] = t
    for block in (500_000, 9):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = {r.doc_id: r.text for r in decontaminate.remove(docs, bench).collect()}
        assert got == want and not any(brute_hits(t, items, 10)[1] for t in got.values())


CLASHES = "n_words spans items n_cut score __text n_tokens dir license __key key id t k0 n_chars lang_pred votes own_license path.x holder base terms doc_ID2".split()


def test_clashing_names(spark, nothing):
    """Columns named like those used inside, or like results, change no result, and come back where they are kept."""
    texts = ["the same words of a text again and again", "the same words of a text again and again", None, "", "mail ann@tarn.example or 10.0.0.1 now", "one two three"]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd = plain.select("*", *(base.F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHES)))
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    model, trees = quality.fit(plain, plain.select("doc_id")), language.fit(plain.withColumn("lang", base.F.lit("en")))
    _, linear = toxicity.fit(plain)
    named = lambda df: df.withColumn("path", base.F.concat(base.F.lit("a/"), base.F.col("doc_id").cast("string")))
    runs = {
        "find": lambda df, **k: decontaminate.find(df, bench, **k),
        "quality": lambda df, **k: quality.score(df, model, **k),
        "toxicity": lambda df, **k: toxicity.score(df, linear, **k),
        "language": lambda df, **k: language.identify(df, trees, **k),
        "pieces": lambda df, **k: pieces.encode_column(df, MODEL, with_ids=True, **k),
        "tokens": lambda df, **k: tokens.token_counts(df, MODEL, **k),
        "licenses": lambda df, **k: licenses.scan(named(df), **k),
    }
    own = base.free([*odd.columns, "path"])
    for name, run in runs.items():
        want = run(plain, keep=("doc_id",)).orderBy("doc_id").collect()
        got = run(odd, keep=[*odd.columns], prefix=own).orderBy("doc_id")
        assert got.columns[: len(odd.columns)] == odd.columns, name
        rows = got.collect()
        assert [tuple(r)[len(odd.columns) :] for r in rows] == [tuple(r)[1:] for r in want], name
        assert [tuple(r)[: len(odd.columns)] for r in rows] == sorted(map(tuple, odd.collect())), name
        bare = run(odd, keep=[*odd.columns]).orderBy("doc_id")  # a kept column named like a result gives way to it
        results = want[0].__fields__[1:]
        assert len({c.lower() for c in bare.columns}) == len(bare.columns) and [[r[c] for c in results] for r in bare.collect()] == [list(r)[1:] for r in want], name
    for run in (pii.sanitise, jaccard.keep_one, lambda df: decontaminate.remove(df, bench, prefix=own).drop(own + "n_cut")):
        got, want = run(odd), run(plain)
        assert got.columns == odd.columns
        assert sorted((r.doc_id, str(r.text)) for r in got.collect()) == sorted((r.doc_id, str(r.text)) for r in want.collect())
        assert {tuple(r)[2:] for r in got.collect()} == {tuple(f"x{k}" for k in range(len(CLASHES)))}
    assert sorted(simhash.digest(odd).collect()) == sorted(simhash.digest(plain).collect())
    assert sorted(pii.digest(odd).collect()) == sorted(pii.digest(plain).collect())


# -- op9 ------------------------------------------------------------------
def brute_bits(samples, text):
    """Code length with dictionaries, byte by byte."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(language.ORDER + 1)]
    for t in samples:
        t = language.symbols(t)
        for i in range(len(t)):
            for k in range(language.ORDER + 1):
                if i >= k:
                    seen[k][t[i - k : i]][t[i]] += 1
    data, bits = language.symbols(text), 0.0
    for i, b in enumerate(data):
        for k in range(min(i, language.ORDER), -1, -1):
            c = seen[k].get(data[i - k : i])
            if c:
                total = sum(c.values()) + len(c)
                if b in c:
                    bits -= math.log2(c[b] / total)
                    break
                bits -= math.log2(len(c) / total)
        else:
            bits += 8
    return bits


def test_context_trees_are_exact():
    samples = {"x": ["abracadabra abra", "cadabra"], "y": ["the cat sat on the mat"], "z": ["zzz"]}
    trees = language.Trees(samples)
    texts = ["abra the cat", "", "q", "zz zz zz abracadabra 123", "matt", "é"]
    got = trees.lengths([language.symbols(t) for t in texts])
    for i, t in enumerate(texts):
        for j, k in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(brute_bits(samples[k], t), abs=1e-3)


def test_language_query(spark, awkward, nothing):
    rng = random.Random(1)
    words = {"aa": ["lolo", "lamo", "olal"], "bb": ["grit", "trig", "tirg"]}
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame([*rows, (None, None, None), (999, "x", None)], "doc_id long, text string, lang string")
    trees = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, trees).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and got[None].lang_pred == "und"
    out = {r.doc_id: r for r in language.identify(awkward, trees).collect()}
    assert out[1].lang_pred == out[6].lang_pred == "und" and out[1].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(nothing, trees).count() == 0
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}


def test_all_languages_and_whole_texts_are_learned(spark):
    letters = "abcdefghijklmnopqrst"
    pairs = [a + b for a in letters for b in letters if a < b][:70]
    rows = [(3 * i + j, " ".join([p * 3, p[::-1]] * 6), f"l{i:02}") for i, p in enumerate(pairs) for j in range(3)]
    rows += [(1000 + j, "x " * 4_000 + "late words here " * 30, "long") for j in range(3)]  # tells only after 6,000 characters
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.fit(df)
    assert len(trees.langs) == 71 and len(trees.groups) == 2
    assert {r.doc_id: r.lang_pred for r in language.identify(df, trees).collect()} == {i: k for i, _, k in rows}
    assert trees.predict(["late words here"])[0] == ["long"]
    one = language.Trees({k: [t for _, t, x in rows if x == k] for k in trees.langs})
    texts = [language.symbols(t) for t in ("abab late", "qrstx", "é", "")]
    assert np.allclose(one.lengths(texts), trees.lengths(texts), atol=1e-3)


# -- op2 ------------------------------------------------------------------
def test_quality_learns_from_positives_alone(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(rng.choice("$%#@!*") * rng.randint(1, 9) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = df.filter("doc_id % 5 <> 0 and doc_id % 3 = 0").select("doc_id")
    model = quality.fit(df, trusted)
    assert 0.6 < model.prior < 0.95
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.mean([(got[i] >= quality.CUT) == (i % 5 != 0) for i, _ in rows]) > 0.95


def test_quality_awkward(awkward, nothing):
    model = quality.fit(awkward, awkward.select("doc_id"))
    assert all(0 <= r.score <= 1 for r in quality.score(awkward, model).collect())
    none = quality.fit(nothing, nothing.select("doc_id"))
    assert quality.score(nothing, none).count() == 0 and quality.score(awkward, none).count() == awkward.count()


# -- op5 ------------------------------------------------------------------
def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.1
    bits = np.stack([np.where(y, rng.random(len(y)) < p, rng.random(len(y)) < q) for p, q in ((0.8, 0.01), (0.7, 0.02), (0.6, 0.01), (0.5, 0.1))])
    bits = np.vstack([bits, np.where(rng.random(len(y)) < 0.95, bits[3], ~bits[3])])  # a voter that copies another
    patterns, counts = np.unique((bits.astype(int) << np.arange(5)[:, None]).sum(0), return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), 5)
    assert [set(g) for g in model.correlated] == [{3, 4}]
    assert 0.07 < model.share < 0.13
    rates = model.accuracy()
    assert [round(rates[k][1], 1) for k in toxicity.NAMES[:3]] == [0.8, 0.7, 0.6]


def test_toxicity(spark, awkward, nothing):
    rng = random.Random(8)
    words = ["river", "stone", "quiet", "window", "paper", "cloud", "number"]
    insult = ["idiot", "pathetic", "scum"]
    rows = [(i, " ".join(rng.choices(words, k=30) + (rng.choices(insult, k=3) if i % 8 == 0 else []) + (["vile"] if i % 7 == 1 else [])), int(i % 8 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, linear = toxicity.fit(df, df.filter("doc_id % 5 <> 0"))
    assert b"vile" not in linear.voters.words and b"idiot" in linear.voters.words
    got = {r.doc_id: r.score for r in toxicity.score(df, linear).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in rows)
    assert linear.logit("you are such a fool") > 0 > linear.logit("a fool and his money")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(awkward, linear).collect())
    _, none = toxicity.fit(nothing)
    assert toxicity.score(nothing, none).count() == 0 and toxicity.score(awkward, none).count() == awkward.count()


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(18)
    words = ["river", "stone", "quiet", "window", "paper", "cloud", "number"]
    rows = [(i, " ".join(rng.choices(words, k=900) + (["idiot", "scum", f"grobnak{i % 3}"] if i % 4 == 0 else ["pleasant"])), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    _, linear = toxicity.fit(df, df)
    weight = lambda w: linear.weights[toxicity.slot(w)]
    assert min(weight(b"grobnak%d" % k) for k in range(3)) > 0 > weight(b"pleasant")  # all after 4,000 characters
    mask, slots, n = toxicity.features(rows[0][1], linear.voters)
    assert mask == linear.voters(rows[0][1]) and n.sum() == len(set(rows[0][1].split())) and toxicity.slot(b"grobnak0") in slots


def test_stems_vote_at_any_length():
    for n, mean in ((1, 0.2), (3, 8.0), (20, 5.0), (59, 40.0), (100, 90.0)):
        plain = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(n))
        assert toxicity.poisson_tail(n, mean) == pytest.approx(plain, rel=1e-6, abs=1e-14)
    assert toxicity.poisson_tail(200, 80.0) < 1e-13 and toxicity.poisson_tail(100, 45.0) < 1e-11
    assert toxicity.poisson_tail(5, 3_000.0) == 1.0 and toxicity.poisson_tail(9_000, 3_000.0) == 0.0
    voters = toxicity.Voters(stems=["grob"], rate=0.001)
    votes = lambda n: voters("grobnak " * 5 * n + "stone " * 195 * n) >> toxicity.NAMES.index("stems") & 3
    assert votes(2) == votes(20) == votes(500) == 3  # long texts as short ones


# -- op1 ------------------------------------------------------------------
def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def test_base_spans_as_the_patterns():
    rng = random.Random(9)
    alphabet = [*"ab@@..--++0123456789  ()%_é\n", "4111111111111111", "192.168.0.1", "a@b.co", "+1 (743) 555-3824"]
    for _ in range(20_000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@") == []  # linear


def test_disclosing_terms(spark, awkward, nothing):
    rng = random.Random(10)
    filler = lambda: " ".join(rng.choices(["tree", "house", "lake", "road", "hill", "field", "barn"], k=12))
    rows = [(i, f"{filler()} Zebulon {filler()[:20]} write to zeb@farm.example please {filler()}") for i in range(6)]
    rows += [(i, filler()) for i in range(6, 80)] + [(80, "zebulon " + filler())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("text", pii.F.when(df.doc_id < 6, pii.F.regexp_replace("text", "Zebulon .* write", "Zebulon may write")).otherwise(df["text"]))
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    truth = {r.doc_id: r.text for r in df.collect()}
    for i, t in truth.items():
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t)).encode()).hexdigest()
    terms = {t[int(s) : int(e)].lower() for i, t in truth.items() for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x) if k == "term"}
    assert "may" in terms and "please" in terms and not terms & {"tree", "house", "lake"}
    assert got[80].spans == "term:0:7"  # six of the seven texts with the name have the address
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[80] == "[TERM]" + truth[80][7:] and "[EMAIL]" in clean[0] and "zeb@" not in clean[0] and "please" not in clean[0]
    out = pii.sanitise(awkward)
    assert out.columns == awkward.columns and sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert pii.digest(awkward).count() == awkward.count() and pii.digest(nothing).count() == 0


def test_disclosing_is_one_rule_at_any_size():
    for k, m, e, c, n in ((1, 1, 1, 1, 1), (1, 1, 1, 1, 2), (2, 2, 2, 2, 50), (2, 2, 2, 2, 60), (3, 3, 3, 3, 1000), (3, 3, 3, 1, 1000), (3, 90, 3, 3, 100), (4, 30, 5, 4, 40)):
        assert len({pii.reveals(k, m, e, total, c, n) for total in (10**4, 10**5, 10**7, 10**9)}) == 1
    assert pii.reveals(2, 2, 2, 10_000, tried=50) and not pii.reveals(2, 2, 2, 10_000, tried=60) and not pii.reveals(1, 1, 1, 10**9, tried=2)
    # Near copies are one piece of evidence; what many documents name is disclosed by less common words only.
    assert pii.reveals(3, 3, 3, 10_000, 3, 1000) and not pii.reveals(3, 3, 3, 10_000, 1, 1000) and not pii.reveals(300, 2000, 3000, 10_000, tried=5)
    for k, m, p in ((2, 3, 0.2), (5, 9, 0.4), (40, 60, 0.5)):
        assert pii.chance(k, m, p) == pytest.approx(sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k, m + 1)))


def test_copies_disclose_nothing_more(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(40)) + (f" Quillon tells ann@tarn.example {word()} " if i < 5 else f" at bo{i}@lone.example " if i < 8 else " ") + " ".join(word() for _ in range(40)) for i in range(300)]
    spans = lambda rows: {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = spans(list(enumerate(texts)))
    copied = spans(list(enumerate(texts)) + [(1000 * (k + 1) + i, texts[i]) for i in (0, 5, 6, 200) for k in range(9)])
    assert all(copied[i] == s for i, s in once.items()) and all(copied[i] == once[i % 1000] for i in copied)
    assert "term" in once[0] and "term" not in once[5]
    # Near copies of one page are one piece of evidence for what stands on it.
    near = spans(list(enumerate(texts)) + [(2000 + k, texts[6] + " " + word()) for k in range(6)])
    assert "term" not in near[6]


def test_directories_of_addresses_form_pairs_together(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(f"name{k} a{k}@d{k}.example" for k in rng.sample(range(300), 300))) for i in range(4)] + [(10 + i, f"plain text {i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base.ship(spark)
    pairs = pii.disclosing(pii._scan(df, "doc_id", "text"), df, "text").collect()
    assert len({p.entity for p in pairs}) == 1 and {p.term for p in pairs} == {f"name{k}" for k in range(300)}


def test_disclosing_terms_of_few_contexts(spark):
    fill = lambda i: " ".join(random.Random(i).choices([f"w{k}" for k in range(400)], k=9))
    rows = [(i, f"{fill(i)} Quillon ann{i}@tarn.example {fill(i)}" if i < 5 else f"{fill(i)} Ozwin bo@lone.example {fill(i)}" if i < 7 else fill(i)) for i in range(4000)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("Ozwin" in got[i] for i in (5, 6))  # one address, two contexts
    assert not any("Quillon" in got[i] for i in range(5))  # five addresses of one context each, one domain
    assert got[100] == rows[100][1] and "w" in got[0]


def test_disclosing_terms_in_whole_texts(spark):
    fill = lambda i: " ".join(random.Random(i).choices([f"w{k}" for k in range(400)], k=30))
    # The name stands far from the address, again at the end, and in two documents without the address.
    rows = [(i, f"Quillon {fill(i)} ann@tarn.example {fill(i)} QUILLON" if i < 12 else f"{fill(i)} quillon" if i < 14 else fill(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("quillon" not in got[i].lower() for i in range(14))
    assert got[0] == f"[TERM] {fill(0)} [EMAIL] {fill(0)} [TERM]" and got[13] == f"{fill(13)} [TERM]" and got[14] == rows[14][1]
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert spans[12] == f"term:{len(fill(12)) + 1}:{len(fill(12)) + 8}" and spans[14] == ""


# -- op3 ------------------------------------------------------------------
def test_simhash_edits_and_search(spark, awkward, nothing):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts[200:230] = texts[:30]
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = sorted(simhash.digest(df).collect())
    for k, r in enumerate(got):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    by = collections.defaultdict(set)
    for r, t in zip(got, texts, strict=True):
        by[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())
    prints = [int(r.fingerprint, 16) for r in got]
    for r, x in zip(got, prints, strict=True):
        assert r.n_within == (sum((x ^ y).bit_count() <= simhash.RADIUS for y in prints) if r.doc_id % 50 == 0 else None)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.4
    assert simhash.digest(awkward).count() == awkward.count() and simhash.digest(nothing).count() == 0
    one = simhash.digest(df.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1


@pytest.mark.parametrize("radius", [1, 3])
def test_block_tables_find_all(spark, radius):
    rng = random.Random(12)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in fps for _ in range(5)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.search(df, df, radius).collect()
    want = {(a, b) for a in fps for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


# -- op4 ------------------------------------------------------------------
def test_licenses(spark, awkward, nothing):
    rows = [
        ("a/LICENSE", "MIT License\n\n" + licenses.TEMPLATES["MIT"][3]),
        ("a/b/x.py", "plain words of a program"),
        ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/c/d/e/z.py", None),
        ("ab/q.py", "nothing"),
        ("top.py", "nothing"),
        ("top.py", "nothing"),
        (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = collections.defaultdict(list)
    for r in licenses.scan(df).collect():
        got[r.path].append((r.own_license, r.license, r.inherited_from))
    assert got["a/LICENSE"] == [("MIT", "MIT", None)] and got["a/b/x.py"] == [(None, "MIT", "a")]
    assert got["a/b/y.py"] == [("Apache-2.0", "Apache-2.0", None)] and got["a/c/d/e/z.py"] == [(None, "GPL-3.0", "a/c")]
    assert got["ab/q.py"] == [(None, None, None)] and got["top.py"] == [(None, None, None)] * 2 and len(got[None]) == 1
    named = awkward.withColumn("path", licenses.F.concat(licenses.F.lit("r/"), awkward.doc_id.cast("string")))
    assert licenses.scan(named, keep=("doc_id",)).count() == awkward.count()
    assert licenses.scan(named.limit(0)).count() == 0


def test_license_screen_loses_nothing(spark):
    rng = random.Random(13)
    words = [w for xs in licenses.TEMPLATES.values() for x in xs for w in x.split()]
    rows = [(f"f{i}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(200)]
    rows += [(f"g{i}", x[: rng.randint(10, len(x))]) for i, x in enumerate(x for xs in licenses.TEMPLATES.values() for x in xs)]
    got = {r.path: (r.license, r.score) for r in licenses.detect(spark.createDataFrame(rows, "path string, text string")).collect()}
    counts = collections.Counter(t for _, x in rows for t in set(licenses._terms(x)))
    idf, unseen = licenses.weights(counts, len(rows))
    for p, x in rows:
        v = {t: n * idf.get(t, unseen) for t, n in collections.Counter(licenses._terms(x)).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        best = max(sum(v.get(t, 0) * w for t, w in u.items()) / norm for _, _, u in licenses.vectors(idf))
        assert (p in got) == (round(best, 6) >= licenses.LEAST)
        if p in got:
            assert got[p][1] == pytest.approx(best, abs=2e-6)


def test_wrapped_notices_are_one_unit(spark):
    import textwrap

    rows, want = [], {}
    for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "MIT", "ISC", "Apache-2.0"):
        notice = max(licenses.TEMPLATES[name], key=len)
        for width in (25, 50, 60, 70, 76):
            path = f"{name}/{width}.c"
            rows.append((path, "import words\n\n" + "".join(f" * {x}\n *\n" for x in textwrap.wrap(notice, width, break_long_words=False)) + "\nint main of a thing\n"))
            want[path] = name, 1.0
    rows += [("same/path", "first words\nLicensed under the\nBSD 3-Clause License."), ("same/path", "other words")]
    rows += [(f"p{i}", f"plain words {i}") for i in range(50)]
    got = {r.path: (r.license, r.score) for r in licenses.detect(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want | {"same/path": ("BSD-3-Clause", 1.0)}


# -- op6 ------------------------------------------------------------------
def brute_join(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)

    def cut(t):
        w = t.lower().encode().translate(jaccard._FOLD).split()
        k = min(jaccard.SHINGLE, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets, up, links = {t: cut(t) for t in by}, {t: t for t in by}, collections.Counter()

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for a in by:
        for b in by:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = collections.defaultdict(lambda: 1 << 60)
    for t, own in by.items():
        least[root(t)] = min(least[root(t)], *own)
    return {i: (min(own), len(own), links[t], least[root(t)]) for t, own in by.items() for i in own}


def near_copies(rng, base_text, n, edits):
    out = []
    for _ in range(n):
        w = base_text.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "".join(rng.choices("abcdefgh", k=5))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limit,block", [(256, 256), (6, 7)])
def test_join_against_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(n))
    texts = [prose(rng.randint(0, 60)) for _ in range(60)]
    texts += near_copies(rng, prose(120), 60, 3) + [prose(40)] * 30 + near_copies(rng, prose(30), 15, 2)
    common = prose(40)
    texts += [common + " " + prose(30) for _ in range(40)] + [None, "", "one", "one two", "One, two"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: (r.class_id, r.copies, r.n_links, r.group_id) for r in jaccard.join(df).collect()}
    assert got == brute_join(rows)
    kept = sorted(r.doc_id for r in jaccard.keep_one(df).collect())
    assert kept == sorted({g[3] for g in got.values()})


def test_join_awkward(awkward, nothing):
    assert jaccard.join(awkward).count() == awkward.count()
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert ids(kept) == sorted(["None", "None", "0", "2", "3", "4", "5", "6", "7", "8", "9", "10"])  # texts without words differ; 1 is 0's copy, 11 is 10's
    assert jaccard.join(nothing).count() == jaccard.keep_one(nothing).count() == 0


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if r != x}


def test_runs_reach_the_recall():
    for depth in range(1, jaccard.DEEPEST + 1):
        assert (1 - jaccard._survival(depth)) ** jaccard.runs_needed(depth) <= 1 - jaccard.RECALL
    assert jaccard.runs_needed(jaccard.SHALLOWEST) <= jaccard.FIRST_RUNS


# -- shared ---------------------------------------------------------------
def test_bloom_never_misses(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(5000)] + [(None,)], "t string").repartition(7)
    bloom = base.Bloom.of(df, "t")
    assert all(f"t{i}" in bloom for i in range(5000)) and sum(f"u{i}" in bloom for i in range(5000)) < 50
    assert "x" not in base.Bloom.of(df.limit(0), "t")
