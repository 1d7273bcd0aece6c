"""A corpus pipeline: each stage is one operator over all that the stage before kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame.  All but the last return the columns of ``documents``.

Cases: null, empty and blank texts have fewer than 50 words, so the first stage rejects them; a null ``doc_id`` goes through every stage; equal rows are one group of
near-duplicates, of which one row stays; rows that share only their ``doc_id`` stay; a null source is a source of its own; extra columns pass through all
stages but the last, whatever their names; ``n_chars``, if it is there, follows the text; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm import mixing, neardup, quality, sampling, secrets
from snaplake.storage import drop_path, new_path, only_result_stays, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and the lines above limits go from the texts that stay."""
    return measured(quality.cleaned(docs))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``n_chars``, if they have it, follows their texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return neardup.deduplicated(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: what is found is cut from the texts, and their lengths follow."""
    return measured(secrets.redact(docs))


def weigh_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: sampled segmentations of every copy; the copies of a document, which the mix writes one after another, have samples of their own."""
    return sampling.encode(docs, copies=True).select("doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_prob", "perturbed", "inclusion")


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", one_of_each),
    ("secret scans", cut_secrets),
    ("source mixing", weigh_sources),
    ("sentencepiece", encode),
]

#: Near-dedup by trees, a trained network and sampled segmentations have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again; what a stage has read and written on its way goes once it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        with only_result_stays(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
