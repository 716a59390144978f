"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again for the next.

Defined results, of each stage and so of all: nulls in any column, rows without an id,
repeated rows and extra columns pass as the stage's operator says; a null or empty text
is scored, linked and counted as an empty one; documents that line dedup empties go;
of the near copies the one with the smallest id stays, and of ties any one; an empty
table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporline.llm import bpe_codec, line_dedup, mixing, near_copies, quality
from vaporline.llm.common import ready, shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.accepted(docs, quality.train(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have in common blocks."""
    return recounted(line_dedup.deduplicated(docs), docs)


def recounted(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars as of the new text, where the documents have that column."""
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_copies.kept_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and their token ids."""
    return bpe_codec.encode_into(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe encoding", token_stage),
]

#: Fingerprints, the fitted classifier and the token merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"corpus-{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
