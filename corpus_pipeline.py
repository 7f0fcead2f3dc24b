"""From raw documents to training tokens: five stages over the operators of haneul.llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame,
which is written as Parquet and read again as the next stage's documents. All but the last
keep the columns of documents.

Nulls and odd rows: a null text is scored as the empty text, has no words and so fails the
rules; a null language or source is a group of its own; a document without an id is never
learnt from and stays in dedup unless its text has another document. Repeated rows are scored,
measured and counted each, and one of them stays after dedup. Very long texts are read whole in
every stage. An empty table passes through all stages as one; a stage whose predecessor kept
nothing returns nothing. Columns of documents beyond those of the table pass through all stages but the
last; ones named quality_measures, base_failed or kept hold the rules' own values after that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haneul.llm import bpe, mixing, nbsvm, probminhash, quality_rules
from haneul.llm.common import materialize
from haneul.llm.queries import table, tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the stage's labelled documents, scores 0.5 or more."""
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model, out="_hn_score").where("_hn_score >= 0.5").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates, once."""
    return probminhash.one_of_each(docs, probminhash.near_duplicates(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated to their source's target."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; no ids for a null text."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-dedup", dedup), ("mixing", mix), ("bpe", encode)]

#: The classifier and the near-duplicate search have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
