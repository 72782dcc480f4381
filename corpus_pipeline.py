"""From raw documents to a weighted mix: the stages of a training corpus.

Each stage is (name, function of spark, docs and the folder of tables); what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import classifier, decontam, jaccard, linededup, mixing
from loomgraph.llm.common import Stash, read

#: SQL cannot express the classifier's training.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more); trained on the labels of docs' own rows."""
    model = classifier.train(docs, read(spark, sf_dir, "labels"))
    own = [c for c in docs.columns if c != "doc_id"]
    scored = classifier.score_documents(docs, model, keep=tuple(own)).where("predicted = 1")
    return scored.select(*[F.col("doc_id" if c == "doc_id" else f"`__k_{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, but for an edit; those left without a word go."""
    return linededup.remove_lines(docs, short=True)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id. Rows that repeat a doc_id stay or go together."""
    judged = jaccard.near_duplicates(docs)
    stay = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    # columns are packed, so that none of theirs can clash with the key
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"))
    return rows.join(stay.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    own = [c for c in docs.columns if c != "doc_id"]
    judged = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=tuple(own)).where("not contaminated")
    return judged.select(*[F.col("doc_id" if c == "doc_id" else f"`__k_{c}`").alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each document are taken, by source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written, and removed once the next one's are."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        after = Stash(stage(spark, docs, sf_dir), f"stage-{k}")
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
