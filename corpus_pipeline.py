"""Corpus pipeline: filter, deduplicate, decontaminate, mix and tokenise ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's docs.  All stages but the last return the
columns of their input.  Rows with NULL ids or repeated ids are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import text_or_empty, written
from chainlens.llm.decontaminate import benchmark_verdicts
from chainlens.llm.mixing import mix_sources
from chainlens.llm.ngram_join import ngram_jaccard_classes
from chainlens.llm.quality import quality_scores
from chainlens.llm.queries import OUTPUT_END, OUTPUT_TOKENIZER
from chainlens.llm.token_output import token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_scores(docs, carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each n-gram Jaccard class, that with the smallest id; those without words or id stay."""
    classes = ngram_jaccard_classes(docs)
    stay = classes.where("n_shingles = 0 or doc_id is null or doc_id = component_id").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), (F.col("n_shingles") > 0).alias("_one")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"),
                       F.xxhash64(text_or_empty("text")).alias("_h"))
    met = rows.join(stay, rows["_id"].eqNullSafe(stay["_id"]) & (rows["_h"] == stay["_h"])).select(
        "row", rows["_id"], rows["_h"], "_one")
    # rows repeated with one id and text are one group, too: every task passes on one row of each
    alone = F.col("_one") & F.col("_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.lit(0)))
    once = met.where(alone).withColumn("_n", nth).where("_n = 1")
    return met.where(~alone).select("row.*").union(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    verdicts = benchmark_verdicts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(verdicts.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
                   .distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"])
                     & (F.xxhash64(text_or_empty("text")) == gone["_h"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs, carry=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files written from the documents."""
    return token_output(docs, OUTPUT_TOKENIZER, OUTPUT_END)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]

#: SQL can't express the stages; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
