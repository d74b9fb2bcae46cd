"""The registered queries and the pipeline over the smallest driver tables."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language, oracles, quality, registry, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op11_packing", "op13_centroids"}))
def test_every_document_once(spark, name):
    got = registry.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns[0] == "doc_id"
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_held_out_folds(spark):
    for r in registry.op9_language(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for r in registry.op2_quality(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= quality.CUT)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < at.count() <= before
        before = at.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.count() == before
    assert sorted(r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r[0] for r in last.select("doc_id").collect())


# -- the queries that SQL cannot say, against one process ----------------------
def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def rows_of(spark, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*cols).collect()]


def draws(spark, ids, salt):
    """The share of the hash range below which an id's draw lies, as the fits take their samples."""
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r.d for r in df.select("id", (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)).alias("d")).collect()}


def test_quality_as_one_process(spark):
    docs, labels = dict(rows_of(spark, "documents", "doc_id", "text")), rows_of(spark, "labels", "doc_id", "quality")
    trusted = sorted(i for i, q in labels if q == 1 and not held(i, 5, 0))
    web = [i for i in docs if not held(i, 5, 0)]
    d, e = draws(spark, trusted, "positive"), draws(spark, web, "unlabelled")
    p = sorted(((str(i), quality.features(docs[i])) for i in trusted if i in docs and d[i] < min(1, quality.POSITIVES / len(trusted))), key=lambda x: (x[0], x[1].tobytes()))
    u = sorted(((str(i), quality.features(docs[i])) for i in web if e[i] < min(1, quality.UNLABELLED / len(web))), key=lambda x: (x[0], x[1].tobytes()))
    model = quality.train(np.array([x for _, x in p]), np.array([x for _, x in u]))
    got = {r.doc_id: r for r in registry.op2_quality(spark, SF).collect()}
    for i, t in docs.items():
        want = float(model.score(quality.features(t)[None])[0])
        assert got[i].score == pytest.approx(want, abs=1e-5) and got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity_as_one_process(spark):
    docs, labels = dict(rows_of(spark, "documents", "doc_id", "text")), dict(rows_of(spark, "labels", "doc_id", "toxic"))
    known = {i: y for i, y in labels.items() if y is not None and i in docs and not held(i, 5, 0)}
    # Misleading words, stems, the share of toxic documents.
    lexicon = {w.encode() for words in toxicity.LEXICON.values() for w in words.split()}
    seen = collections.defaultdict(list)
    for i, y in known.items():
        for w in toxicity.words_of(docs[i] or "") & lexicon:
            seen[w].append(y)
    dropped = {w.decode() for w, ys in seen.items() if len(ys) >= 5 and np.mean(ys) < 0.5}
    plain, counts, total = toxicity.Voters(dropped), collections.defaultdict(lambda: [0, 0]), [0, 0]
    for i, y in known.items():
        if docs[i] and not plain(docs[i]):
            total[y > 0] += 1
            for x in {w[:k] for w in set(docs[i].lower().split()) if w.isalpha() for k in toxicity.STEM_LETTERS if len(w) > k}:
                counts[x][y > 0] += 1
    rated = [(t * math.log(x), s) for s, (c, t) in counts.items() if t >= toxicity.STEM_DOCS and (x := (t / total[1]) / ((c + 1) / total[0])) >= toxicity.STEM_EXCESS] if all(total) else []
    stems = []
    for _, s in sorted(rated, key=lambda r: (-r[0], -len(r[1]), r[1])):
        if len(stems) < toxicity.STEMS and not any(s.startswith(x) or x.startswith(s) for x in stems):
            stems.append(s)
    voters = plain
    if stems:
        n = [toxicity.Voters(dropped, stems).stemmed(docs[i]) for i, y in known.items() if y <= 0]
        voters = toxicity.Voters(dropped, stems, (sum(a for a, _ in n) + 1) / (sum(b for _, b in n) + 1))
    share = min(max(np.mean([y > 0 for y in known.values()]), 0.001), 0.5)
    # The label model over all patterns, the classifier over the sample.
    votes = {i: voters(t) for i, t in docs.items()}
    patterns = sorted(set(votes.values()))
    anchors = np.array([[sum(votes[i] == v and (y > 0) == side for i, y in known.items()) for v in patterns] for side in (False, True)], float)
    every = collections.Counter(votes.values())
    model = toxicity.LabelModel(np.array(patterns), np.array([every[v] for v in patterns], float), len(toxicity.NAMES), share, anchors=anchors)
    d = draws(spark, list(docs), "weak")
    vectors = sorted((toxicity.features(docs[i], voters) for i in docs if d[i] < min(1, toxicity.SAMPLE / len(docs))), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    linear = toxicity.fit_linear(vectors, model.posterior(np.array([v for v, _, _ in vectors])), voters, model.odds())
    got = {r.doc_id: r for r in registry.op5_toxicity(spark, SF).collect()}
    for i, t in docs.items():
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-linear.logit(t))), abs=1e-4) and got[i].predicted == int(got[i].score >= 0.5)


def test_language_as_one_process(spark):
    rows = rows_of(spark, "documents", "doc_id", "text", "lang")
    learn = [(i, t, x) for i, t, x in rows if t is not None and x is not None and not held(i, 4, 2)]
    d, n = draws(spark, [i for i, _, _ in learn], "sample"), collections.Counter(x for _, _, x in learn)
    trees = language.Trees({x: [t for i, t, y in learn if y == x and d[i] < language.SAMPLE_ROWS / n[x]] for x in n})
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.op9_language(spark, SF).collect()}
    for (i, _, _), lang, score in zip(rows, *trees.predict([t for _, t, _ in rows]), strict=True):
        assert got[i] == (lang, pytest.approx(score, abs=1e-4))


def test_sql_of_the_queries(spark):
    """The SQL says what the queries say, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.oracles().items():
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        rows = sorted(map(str, ({c: v for c, v in zip(cols, r, strict=True)} for r in want.fetchall())))
        got = sorted(str({c: r[c] for c in cols}) for r in registry.QUERIES[name](spark, SF).collect())
        assert got == rows, name
    assert set(registry.oracles()) == set(oracles.all_of(registry.PIECES))
