"""A training corpus from documents: quality, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm.dissimilar import keep_dissimilar
from panelflow.llm.mixing import mix_sources
from panelflow.llm.packing import pack_segments
from panelflow.llm.quality import keep_good
from panelflow.llm.queries import remainder
from panelflow.llm.repeats import clean_repeats
from panelflow.session import scratch_path, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the learned quantile; labels come from three quarters of the rows."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    return keep_good(docs, labels, id="doc_id", text="text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by a Jaccard index of 0.8 or more over five-word shingles, the smallest doc_id."""
    tune(spark)
    return keep_dissimilar(docs, id="doc_id", text="text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier document has."""
    tune(spark)
    cleaned = clean_repeats(docs, id="doc_id", text="text")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    tune(spark)
    return mix_sources(docs, id="doc_id", text="text", source="source", keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of all documents in sequences."""
    import public_tokenizers

    tune(spark)
    packed = pack_segments(docs, public_tokenizers.path("word_bpe_49k.json"), id="doc_id", text="text")
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing", mixing), ("packing", packing)]
# Quality, repeated passages and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
