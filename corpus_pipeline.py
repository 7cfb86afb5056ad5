"""A training corpus in five stages: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of `documents`.

Defined cases, in every stage: an empty table gives no rows; columns other than those of `documents` are not carried; very long texts
are read whole. Null or empty texts and texts without a letter have no language and go in the first stage; rows with a null id stay
in all stages but are not linked to others. Repeated rows (same id and text) become one in the second stage; of rows that share an
id but not their text each is judged by its text. Of linked documents (ties included) the smallest id stays. Null languages are
filled in, null sources are one source of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import harmonic_packing, langid_crf, mixing, ngram_jaccard, pii_semicrf
from deltaweave.llm.common import bounded_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language holds less than this share of its words' posteriors is rejected, as is one without letters.
LEAST_LANGUAGE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; a missing language is filled in."""
    bounded_batches(spark)
    seen = langid_crf.identify(docs, langid_crf.train(docs), keep=COLUMNS[1:])
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one with the smallest id stays."""
    bounded_batches(spark)
    return ngram_jaccard.one_of_each(docs, n=5, num=80, den=100).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    found = pii_semicrf.find(docs, pii_semicrf.train(docs), keep=["lang", "source", "n_chars"], masked=True)
    changed = F.size("spans") > 0
    return found.select("doc_id", F.col("masked_text").alias("text"), "lang", "source", F.when(changed, F.length("masked_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in mixed order."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, cut into pieces with their places in sequences of 2048."""
    return harmonic_packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: Models, hashes and tokenization have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
