"""Corpus pipeline: five stages from raw documents to a training mix.

1. toxicity: documents that the classifier rejects go; all others stay as they are.
2. near_duplicates: one document of each SimHash component stays, that of the smallest id.
3. substrings: words in sequences of 35 that also start elsewhere are cut out of the texts;
   ``n_chars`` follows. Texts that lose nothing stay as they are; no document goes.
4. decontaminate: documents with benchmark passages go.
5. mix: how many words of each document the mix takes; documents that give none go.

Every stage reads the whole of what its predecessor kept. All but the last return the columns of
``documents``. Null texts count as empty, and stage 3 makes them so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import debruijn, decontaminate, mixing, simhash, toxicity
from evalspark.llm.common import table
from evalspark.plans.durable import fresh_path
from evalspark.session import configure

ORACLE_SQL = None  # fingerprints, classifiers and draws are beyond SQL; tests hold brute-force versions


def _configured(stage):
    """Stages may be called one by one, in a session somebody else created."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run


def _columns(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.select(*[F.col(f"_row.{c}") for c in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model, *docs.columns)
    return _columns(scored.where(F.col("score") < toxicity.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = debruijn.drop_repeats(docs, *others, as_is=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"_row.{c}") for c in docs.columns])


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), *docs.columns)
    return _columns(decontaminate.contaminated(found).where("not contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_words(docs).where("taken > 0")


STAGES = [
    ("toxicity", _configured(drop_toxic)),
    ("near_duplicates", _configured(drop_near_duplicates)),
    ("substrings", _configured(cut_substrings)),
    ("decontaminate", _configured(decontaminate_texts)),
    ("mix", _configured(mix_sources)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again, so that a lost
    executor costs no earlier stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
