"""From raw documents to token ids: five stages, each over all that the one before has kept.

Each stage's rows are written as Parquet and read again, so a stage's work is never done twice and a lost executor costs one
stage's tasks. All stages but the last return the columns of documents, and no others.

In every stage null and empty texts are kept as they are: they have no words, no passages and no tokens. Rows that repeat as a
whole are kept or removed together, ties go by doc_id, a very long text is one row's work, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import stage
from driftmerge.llm.decontaminate import decontaminate
from driftmerge.llm.near_dedup import near_duplicates
from driftmerge.llm.pieces import round_trip
from driftmerge.llm.quality import judged
from driftmerge.llm.suffix_dedup import remove_repeats

#: A passage of over 50 words has so many bytes at least: 50 words of four letters with a space each.
PASSAGE_BYTES = 250
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer doesn't reject; texts without words are kept, as labellers have nothing to judge."""
    return judged(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id; of rows that repeat it, all."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_BYTES or more that occur elsewhere too; a character that a cut went through becomes U+FFFD."""
    rest = remove_repeats(docs, min_len=PASSAGE_BYTES).withColumn("text", F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text")))
    return rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate; a null or empty text is clean."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).where("not contaminated").select(*COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they give the text back."""
    found = round_trip(docs.select("doc_id", "text"))
    restored = F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("restored")
    return found.select("doc_id", "text", F.size("ids").cast("bigint").alias("n_tokens"), "piece_score", "ids", restored)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: SQL can express neither the learnt scorer nor byte-wise removal; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
