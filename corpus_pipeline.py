"""The corpus pipeline: stages over `documents`, each written as Parquet and read again for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of docs, whatever they are; null texts count as empty, and rows with null or repeated ids are kept
or dropped by their own text. run() applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontaminate, jaccard, packing, quality, tokens, toxicity
from weir.llm.shared import read_table, scratch, written

SEQUENCE = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. The model learns from the labelled documents of sf_dir."""
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: toxicity.scored(d, model).where("score < 0.5"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more. The model learns from the labelled documents of sf_dir."""
    model = quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: quality.scored(d, model).where("score >= 0.7"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return name


def _filtered(docs: DataFrame, judge) -> DataFrame:
    """What `judge` keeps, with docs' own columns: one that is named like the score steps aside meanwhile."""
    aside = {c: _free(docs, "own_score") for c in docs.columns if c.lower() == "score"}
    out = judge(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id (null ids last; of equal ids the first by text's hash).

    Classes are linked by texts whose sets of five-word shingles are at Jaccard similarity 0.8 or more.
    """
    row = _free(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # row numbers hold from here on
    numbers = rows.select(F.col(row).alias("doc_id"), "text")
    classes = jaccard.near_duplicates(numbers).select(F.col("doc_id").alias("n"), F.col("component_id").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("n"))
    firsts = rows.select(order.alias("o"), F.col(row).alias("n")).join(classes, "n").groupBy("class").agg(F.min("o").alias("o")).select(F.col("o.n").alias(row))
    return rows.join(firsts, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold passages of the benchmark."""
    return decontaminate.removed(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as token pieces in sequences of 2048. Executors hold what earlier stages left too, so workers remember a quarter as many words."""
    return packing.pack(packing.token_pieces(docs, tokens.default_path("word_bpe_49k.json"), SEQUENCE, memory=tokens.MEMORY // 4), SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]
#: Classifiers and a tokenizer can't be put in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
