"""The queries opN_*: each operator over its whole driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import base, centroids, decontaminate, infill, jaccard, language, licenses, packing, pieces, pii, quality, simhash, tokens, toxicity

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(base.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Label rows that may be learned from: doc_id and one label column, a row per document."""
    rows = base.read_table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~base.held_out("doc_id", 5, 0))
    return rows.groupBy("doc_id").agg(F.max(column).alias(column))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Network:
    trusted = _labelled(spark, sf_dir, "quality").filter("quality = 1").select("doc_id")
    return quality.fit(docs.filter(~base.held_out("doc_id", 5, 0)), trusted)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", base.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(base.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_path():
    """Documents as a tree of files: source, thousands, fifties; the first of each fifty stands as that directory's licence file."""
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), i.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"), F.floor(i / 50).cast("string"), name)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files; a document without an id has no path and no licence."""
    docs = base.read_table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), document_path()).alias("path"))
    return licenses.scan(docs, keep=("doc_id",))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # A bounded sample of the labelled rows shows misleading words and the share of toxic documents.
    labels = _labelled(spark, sf_dir, "toxic")
    rate = min(1.0, toxicity.SAMPLE / max(labels.count(), 1))
    some = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1 << 30)) / float(1 << 30) < rate)
    _, linear = toxicity.fit(docs, docs.join(F.broadcast(some), "doc_id").select("text", "toxic"))
    scored = toxicity.score(docs, linear)
    return scored.select("doc_id", base.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class (equal texts), links to other classes, and group."""
    return jaccard.join(base.read_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(base.read_table(spark, sf_dir, "documents"), base.tokenizer_path(PIECES))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_column(base.read_table(spark, sf_dir, "documents"), base.tokenizer_path(PIECES))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language.fit(docs.filter(~base.held_out("doc_id", 4, 2)))
    return language.identify(docs.select("doc_id", "text"), trees).select("doc_id", base.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (base.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.digest(decontaminate.find(docs.select("doc_id", "text"), items))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.read_table(spark, sf_dir, "documents").select("doc_id", "text"), base.tokenizer_path(WORDS))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(base.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(base.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_simhash, op4_licenses, op5_toxicity, op6_ngram_jaccard, op7_token_counts, op8_pieces, op9_language, op10_decontaminate, op11_packing, op12_infill, op13_centroids)}


def oracles() -> dict[str, str]:
    """The SQL of the queries that have one; it holds the vocabulary, so it is made when asked for."""
    from factloom.llm import oracles as sql

    return sql.all_of(PIECES)
