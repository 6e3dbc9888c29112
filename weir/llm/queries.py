"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, html_extract, licenses, packing, quality, simhash, sql, tiff, token_files, tokens, toxicity, url_filter
from weir.llm.shared import read_table, scratch

SEQUENCE = 2048


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_as_tiff(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlap(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def file_path() -> Column:
    """Documents as files of a tree, as `documents` names none: source/lang/hundred/id, with licence files at three depths.

    Each directory's first document by hundreds is its LICENSE; those of round thousands and ten thousands are the LICENSE-<id>
    of their language and of their source.
    """
    number = F.col("doc_id")
    top, language = F.array(F.col("source")), F.array("source", "lang")
    own = F.array("source", "lang", F.floor(number / 100).cast("string"))
    name = F.concat(F.lit("LICENSE-"), number.cast("string"))
    parts = (
        F.when(number % 10_000 == 0, F.concat(top, F.array(name)))
        .when(number % 1_000 == 0, F.concat(language, F.array(name)))
        .when(number % 100 == 0, F.concat(own, F.array(name)))
        .otherwise(F.concat(own, F.array(number.cast("string"))))
    )
    return F.array_join(parts, "/", "unknown")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "documents").select("doc_id", file_path().alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"), SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(read_table(spark, sf_dir, "documents"), folder, tokens.default_path("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_tiff_media, op3_quality, op4_decontamination, op5_license_scan, op6_simhash, op7_toxicity, op8_best_fit_packing, op9_url_filter, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
