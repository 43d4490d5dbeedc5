"""A corpus pipeline of five stages over ``documents``; each is one of the operators and returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import langid, mixing, neardup, packing, secrets
from pathloom.llm.shared import materialize, table, temporary, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, or without a letter) go; a missing language is filled in, a given one stays."""
    known, guess = langid.label(docs, langid.fit(docs))
    return known.where(F.col(guess) != "und").withColumn("lang", F.coalesce("lang", guess)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, and of repeated rows of one id one."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return neardup.without(docs, materialize(gone, "gone"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.apply(docs, mixing.mix(docs, table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: its document, place and sequence."""
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Near-duplicates, models and packing are no SQL; tests compare each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):  # the stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
