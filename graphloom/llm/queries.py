"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import importance, language, licenses, mixing, near_dups, packing, quality, substring, token_output, topk, url_rules, vector_codes, warc
from graphloom.llm.common import shared_dir, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.RULES))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/graphloom/token-matrices-{uuid.uuid4().hex}"
    return token_output.digest_rows(token_output.write_matrices(table(spark, sf_dir, "documents"), path))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language, "op2_url_rules": op2_url_rules, "op3_near_duplicates": op3_near_duplicates, "op4_quality": op4_quality, "op5_mixing": op5_mixing, "op6_topk": op6_topk, "op7_substring": op7_substring,
    "op8_packing": op8_packing, "op9_token_output": op9_token_output, "op10_warc": op10_warc, "op11_importance": op11_importance, "op12_vector_codes": op12_vector_codes, "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {"op2_url_rules": url_rules.SQL, "op4_quality": quality.SQL, "op6_topk": topk.SQL, "op7_substring": substring.SQL, "op10_warc": warc.SQL, "op11_importance": importance.SQL, "op12_vector_codes": vector_codes.SQL, "op13_licenses": licenses.SQL}
