"""A corpus pipeline of five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Four return
the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.llm import language_id, line_dedup, ngram_join, packing, quality
from pagespark.llm.queries import sized
from pagespark.llm.store import kept, table

#: The models are trained and packing has many right answers, so SQL cannot say the rows.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty."""
    found = language_id.predict(docs, language_id.fit(docs), "_lang", "_score", "_rejected")
    return found.where("not _rejected").select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    names = ("_content", "_metadata", "_quality", "_kept")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), names)
    return found.where("_kept").select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; a text of which nothing is left goes."""
    found = line_dedup.dedup_lines(docs, "_removed", "_lines")
    found = found.where("_removed = 0 or length(trim(text)) > 0")
    n_chars = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed. One document of each near-duplicate component is left, so none has a cluster."""
    return packing.pack(sized(docs), row="row")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
