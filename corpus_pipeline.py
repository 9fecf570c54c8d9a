"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all rows its
predecessor kept. All but the last return the columns of ``documents``. ``run`` writes each stage's
result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import jaccard, linededup, mixing, packing, toxicity
from sitelens.llm.common import private, release, row_keys, stored
from sitelens.llm.queries import tokenizer_path

#: The sample that training reads holds this share of the tokens that reach the mixing stage.
MIX_KEEP = 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a toxicity score of 0.5 or more go.

    Null and empty texts score the bias alone; repeated rows go or stay together; without labels all stay.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = private(docs, "score")
    return docs.withColumn(score, toxicity.score_column(model, "text", docs)).where(F.col(score) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go; ``n_chars`` follows the text.

    A document that loses its last line with any visible character is a copy of earlier text and goes; one that had no
    such line before stays, null texts too. Rows equal in id and text are one document, so they stay or go together.
    """
    n_lines, removed = private(docs, "n_lines"), private(docs, "removed")
    out = linededup.deduplicated(docs, n_lines, removed)
    cut = F.size(removed) > 0
    n_chars = F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.where(~(cut & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates stays, that of the least id, ties by the row keys.

    Texts without words, null ones too, are in no group and stay. Rows equal in id and text are one document and stay or go
    together, whatever their other columns hold. A null id comes behind all others; an empty table gives an empty one.
    """
    k1, k2 = private(docs, "k1"), private(docs, "k2")
    keep = stored(jaccard.groups(docs).where("keep").select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "pipeline-keep")
    one, two = row_keys("doc_id", "text")
    return docs.withColumns({k1: one, k2: two}).join(keep, [k1, k2], "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents drawn by their raked and calibrated probabilities.

    A null source or language is a category of its own, a null or empty text has no tokens; rows of equal id are drawn together, those
    of null id too; an empty table gives an empty one.
    """
    return mixing.drawn(docs, keep=MIX_KEEP)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token sequences of at most 1024 ids.

    A null or empty text is its end mark alone; rows that repeat are packed as often as they occur; ties between pieces of one length
    are broken by their ids; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores and edit distances of line groups are beyond SQL. Tests hold the Jaccard stage and exact line copies against brute force, and
#: each other stage against its operator, which has tests of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        # A stage leaves hundreds of finished jobs, shuffles and broadcasts on the driver.
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
