"""Five stages that make a training corpus of ``documents``.

quality classifier -> n-gram Jaccard join (one document of each group) ->
benchmark decontamination (spans go) -> PII (sanitised texts) -> encoding.
Every stage works on all that the one before it kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import base, decontaminate, jaccard, pieces, pii, quality, registry


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*map(base.column, docs.columns))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    model, own = registry.quality_model(spark, docs, sf_dir), base.free(docs.columns)
    scored = quality.score(docs, model, keep=docs.columns, prefix=own)
    return _as(docs, scored.filter(F.col(own + "score") >= quality.CUT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id."""
    return _as(docs, jaccard.keep_one(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans are cut out; a document left without a word goes."""
    own = base.free(docs.columns)
    found = decontaminate.remove(docs, base.read_table(spark, sf_dir, "benchmark"), prefix=own)
    hit = F.col(own + "n_cut") > 0
    kept = found.filter(~hit | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    return _as(docs, kept.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, terms that disclose it are generalised or removed."""
    out = pii.sanitise(docs)
    return _as(docs, out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_column(docs, base.tokenizer_path(registry.PIECES), with_ids=True)


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("PII", sanitise),
    ("SentencePiece encoding and decoding", encode),
]

#: Models, hash trees and merge rounds have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = base.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.cut(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
