"""The operators' queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, hardneg, langid, licenses, maxent, mixing, pieces, pii, quality, secrets_crf, shards, simhash, spelling,
)
from .common import table

PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        return build
    return register


@query("op1_lm_scoring")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(table(spark, folder, "documents"))


@query("op2_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_report(table(spark, folder, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


@query("op4_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_report(table(spark, folder, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, folder, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_crf.secret_report(table(spark, folder, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_report(table(spark, folder, "documents"))


@query("op12_hard_negatives")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return hardneg.hard_negative_report(table(spark, folder, "embeddings"))


ORACLES["op12_hard_negatives"] = hardneg.REPORT_SQL


@query("op13_sentencepiece")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path
    return pieces.encoding_report(table(spark, folder, "documents"), path(PIECES))
