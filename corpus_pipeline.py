"""A corpus pipeline: language ID, exact and near dedup, mixing of sources, token encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geostat_spark.llm.bpe import token_digests
from geostat_spark.llm.exact_dedup import drop_exact_duplicates
from geostat_spark.llm.language_id import UNDETERMINED, fit, predict
from geostat_spark.llm.mixing import mixed_documents
from geostat_spark.llm.queries import tokenizer_path
from geostat_spark.llm.simhash import drop_near_duplicates
from geostat_spark.llm.text import hash_part
from geostat_spark.session import cut_and_release, tables_so_far

UNWANTED: tuple[str, ...] = ()  # languages whose documents go


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, hence without a language, go, and those predicted in an ``UNWANTED`` one.

    A doubtful prediction rejects nothing. When nothing is labelled all documents stay."""
    held_out = F.coalesce(hash_part(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs, ~held_out)
    if not model.classes:
        return docs
    return predict(docs, model).where(~F.col("lang_pred").isin(UNDETERMINED, *UNWANTED)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document of smallest id stays."""
    return drop_near_duplicates(docs, shingle=4, max_bits=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of every document."""
    return token_digests(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

# The classifier, the fingerprints, the sample and the encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next. What a stage
    has written on the way, and the stage before it, are deleted once the next reads its result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = tables_so_far()
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_and_release(docs, begun)
    return docs
