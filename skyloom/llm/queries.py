"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.llm import decontam, exact_dedup, langid, licenses, minhash, mixing, quality, secrets, tokens, toxicity
from skyloom.llm.common import load


def op1_token_store(spark, sf_dir):
    return tokens.token_digests(load(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents")).drop("links")


def op5_licenses(spark, sf_dir):
    return licenses.licences(load(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return langid.languages(load(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    m = mixing.mixed(load(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("virtual_finish", 6).alias("virtual_finish"))


def op8_secret_scan(spark, sf_dir):
    return secrets.secrets(load(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_exact_dedup, op3_quality, op4_near_duplicates, op5_licenses, op6_language, op7_mixing, op8_secret_scan, op9_toxicity, op10_decontamination)
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_near_duplicates": minhash.ORACLE_SQL, "op5_licenses": licenses.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op8_secret_scan": secrets.ORACLE_SQL, "op10_decontamination": decontam.ORACLE_SQL}
