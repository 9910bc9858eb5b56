"""Registered queries of the operators, with SQL where SQL can express them."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerofield.llm import (
    alignment, embeddings, importance, interpolation, langid, mixing, packing, pieces, quality, search, secrets, sharding, simhash)
from aerofield.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pstable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.query(table(spark, sf_dir, "documents"))


def op3_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op5_vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op9_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_string_kernel_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.query(table(spark, sf_dir, "documents"))


def op13_aligned_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pstable_links, op2_deleted_interpolation, op3_kneser_ney_bands, op4_simhash_pigeonring, op5_vector_bins,
    op6_pareto_mix, op7_importance_resampling, op8_secret_crf, op9_packing_dp, op10_string_kernel_lang,
    op11_presence_masks, op12_piece_rounds, op13_aligned_ends)}
SQL: dict[str, str] = {"op6_pareto_mix": mixing.SQL, "op11_presence_masks": search.SQL}
