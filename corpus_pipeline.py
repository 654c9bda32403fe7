"""A corpus pipeline: language, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's rows to the shared folder and reads them again for the next one. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm.language_crf import UNKNOWN, fit_documents, label_documents
from rowscribe.llm.mixing import mix_documents
from rowscribe.llm.order_minhash import document_mark, near_texts
from rowscribe.llm.pii_crf import fit, redact
from rowscribe.llm.rank_queue_bpe import round_trip
from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

LEAST_SCORE = 0.3  # below it no language holds a document


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or in which none of the
    languages reaches ``LEAST_SCORE``, go. The field learns from the labelled rows."""
    model = fit_documents(docs.select("doc_id", "text", "lang"))
    labelled = label_documents(docs, "text", model)
    if model is None:  # nothing to learn from: all that is known is whether there are letters
        return labelled.filter(F.col("text").rlike("\\p{L}")).select(*docs.columns)
    return labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows
    that repeat an id with another text are documents of their own. Of rows that repeat id
    and text one stays, but rows without a word all do."""
    found = near_texts(docs, "doc_id", "text")
    stays = found.groupBy("mark").agg(F.max("kept").alias("_kept"), F.max("wordless").alias("_wordless")).filter("_kept")
    marked = docs.withColumn("mark", document_mark(F.col("doc_id"), F.col("text")))
    held = marked.join(stays.hint("merge"), "mark")
    once = held.filter("not _wordless").dropDuplicates(["mark"])
    return once.union(held.filter("_wordless")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows."""
    clean = redact(docs, "text", fit(docs, "text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weights choose, each as often as its epochs say."""
    mixed = mix_documents(docs)
    return mixed.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_epochs")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

# A trained field decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
