"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and
works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, ngram_join, packing, queries, substring_dedup, toxicity
from framelake.llm.workspace import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic, of whatever grade, than not go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.grade(docs, model).where(~F.col("toxic")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links connect, the one with the smallest id stays (then that of the smallest hash of its text); of rows that repeat, one.

    Rows, not ids, are decided on: where an id repeats with different texts, each
    goes or stays by its own. Null ids count as larger than any. Rows without
    words are linked with nothing and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("own"))
    linked = settle(ngram_join.link_near_duplicates(docs.select(key.alias("row"), "text"), id_col="row"), "linked")
    others = linked.where(F.col("row") != F.col("component_id")).select("row").distinct()
    keyed = docs.withColumn("row_", key)
    kept = keyed.join(others, F.col("row_") == F.col("row"), "left_anti")
    repeated = settle(linked.where("n_shingles > 0").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row"), "repeated")
    if repeated.limit(1).count():
        again = F.col("row_") == F.col("row")
        kept = kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["row_"]))
    return kept.select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows of 35 that occur elsewhere go; n_chars follows the text. No document goes."""
    return substring_dedup.remove_repeated_passages(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    pieces = packing.cut_pieces(docs, queries.tokenizer_path("word_bpe_49k.json"))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, order_by=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
