"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``documents``; the last returns packed pieces. Between stages rows
are written as Parquet to the folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan.llm import languages, lines, mixing, packing, similarity
from auditspan.llm.queries import tokenizer_path
from auditspan.operators.ordered import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least mean posterior of the best language; a text of one language has nearly 1.
MIN_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in which no language leads clearly; fills in
    a missing language."""
    model = languages.learn(docs)
    judged = languages.language_id(docs.select(*COLUMNS), model, keep=COLUMNS[1:])
    ok = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.where(ok).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; a document left without any word goes."""
    out = lines.drop_recurring_lines(docs.select(*COLUMNS))
    return (out.where(F.col("text").rlike(mixing.WORD))
            .withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return similarity.one_per_class(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: whole or partial texts, up to twice each."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = (("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", jaccard_stage),
          ("mixing", mixing_stage), ("packing", packing_stage))

#: Trained models and hash permutations have no SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
