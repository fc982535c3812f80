"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

    from corpus_pipeline import run
    tokens = run(spark, "/data/corpus")

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and all
but the last return the columns of ``documents``.  Rows with a null id or text
go through every stage: nothing is known against them.  Repeated rows count as
copies and leave one row behind the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bpe, decontaminate, neardup, secrets, toxicity
from tarnwork.llm.common import prepare, shuffles_dropped, table
from tarnwork.session import scratch_path

MARK = "[secret]"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score rejects go.  The score is learned from the training folds of ``labels``."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, out="__score")
    return scored.where("__score < 0.5").select(*(f"`{c}`" for c in docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    prepare(spark)
    return neardup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay, with the length of their new text."""
    prepare(spark)
    redacted = secrets.redact(docs, secrets.fit(docs), MARK)
    if "n_chars" not in redacted.columns:
        return redacted
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian unsigned 32 bits), and whether the ids decode to the text."""
    import public_tokenizers

    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

# A trained score, similarity classes and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        staged = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            staged.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
