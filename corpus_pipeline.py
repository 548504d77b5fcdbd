"""Corpus pipeline: language ID, near-duplicate removal, substring removal, mixing, packing.

Each stage takes what its predecessor kept, as a written and reread table; all but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, near_dups, packing, substring
from graphloom.llm.common import discard, materialize, table

#: A document stays in if its language is known and this corrected share of its n-grams belongs to that language.
#: Clean prose scores above 0.8; junk without a language's n-grams scores near 0.
LEAST_SCORE = 0.25
#: A text of fewer n-grams (some eight words) is not judged by its score, which tells little there.
LEAST_GRAMS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the n-gram filters know; lang becomes the predicted one.

    Defined cases: a text with letters but too few n-grams to tell junk from language stays, with its own lang if its
    score is low; a null or empty text, or one without a letter, goes; texts of any length are judged whole; repeated
    rows are judged alike; a null doc_id teaches and is judged as any other; a null lang teaches nothing; columns pass
    through, whatever their names; an empty table stays empty, and where no row teaches, every row goes.
    """
    filters = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    known = F.col("score") >= LEAST_SCORE
    found = language.annotate(docs, filters).filter((F.col("lang_pred") != language.UNKNOWN) & (known | (F.col("grams") < LEAST_GRAMS)))
    lang = F.when(known, F.col("lang_pred")).otherwise(F.col("gl_row.lang"))
    return found.select(F.col("gl_row").withField("lang", lang).alias("gl_row")).select("gl_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class; see near_dups.one_of_each for the defined cases."""
    return near_dups.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier document holds; those left without a word go.

    Defined cases: see substring.remove_repeats; a text that had no word (null, empty, blank) stays as it is; columns
    pass through, whatever their names.
    """
    out = substring.judged(docs).filter((F.col("gl_removed") == 0) | (F.col("gl_removed") < F.col("gl_words")))
    size = F.length("gl_row.text").cast("long")
    return out.select(F.col("gl_row").withField("n_chars", size).alias("gl_row")).select("gl_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, in shuffled shards; repeats are rows of their own.

    Defined cases: a text without a word (null, empty, blank) has nothing to be taken, and goes; see mixing.draw and
    mixing.mixed_documents for the others.
    """
    size = F.length("gl_row.text").cast("long")
    return mixing.mixed_rows(docs).select(F.col("gl_row").withField("n_chars", size).alias("gl_row")).select("gl_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of bounded length; see packing.pack_documents for the defined cases."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Signatures, a trained classifier and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
        discard(before)  # a stage's table goes when the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
