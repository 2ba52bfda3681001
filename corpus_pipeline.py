"""Corpus pipeline over ``documents`` (part of subpackage ``llm``).

Five stages, each one operator: toxic documents go; one document of each near-duplicate class stays; repeated
passages are cut out; sources are mixed to their targets (a document can be taken twice and is then two rows);
the rows are packed into token-budget batches.  Every stage works on all rows of the one before, written as
Parquet and read again.

Defined cases: the operators' own (nulls, empty texts, ties, repeated rows, empty tables); extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.llm import fair_mix, length_buckets, ngram_join, suffix_dedup, toxicity_crf
from clinops.llm.common import keyed, read, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the conditional random field's document score does not call toxic."""
    field = toxicity_crf.train_on(docs, read(spark, sf_dir, "labels"))
    return toxicity_crf.clean_rows(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents linked at Jaccard 0.8 on five-word shingles."""
    rows = keyed(docs, "doc_id")
    first = ngram_join.join(rows).where("is_first").select("__row")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 200-byte string that occurs twice."""
    rows = keyed(docs, "doc_id")
    kept = suffix_dedup.drop_repeats(rows, as_text=True).select("__row", F.col("kept").alias("__kept"))
    out = rows.drop("text", "n_chars").join(kept, "__row")
    out = out.withColumn("text", F.col("__kept")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix takes, as often as it takes them."""
    return fair_mix.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row."""
    import public_tokenizers

    return length_buckets.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json")).drop("__row").withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("fair_mix", mix), ("length_buckets", pack)]

#: The field, the join's classes, byte suffixes and the dynamic programme are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
