"""From raw documents to token pieces: five stages over the whole corpus.

Each stage takes all rows that its predecessor kept, as reread from Parquet, and its decisions take effect: language
ID drops what it can't identify (no letters, or words unlike those of any learned language); line dedup cuts later repeats of runs of lines and drops a document of which
nothing is left; near-dedup keeps the smallest doc_id of each component; decontamination drops contaminated
documents; the last stage encodes with SentencePiece and checks that decoding gives the text back.

Nulls, empty tables, repeated rows: as each operator says; a null doc_id is linked with nothing and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import decontam, langid, line_dedup, minhash, pieces
from coffer.llm.queries import tokenizer_file
from coffer.llm.store import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs, Scratch(spark, "pipeline-langid")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(docs)
    empty = (F.col("__n_removed") > 0) & (F.trim("text") == "")
    out = out.where(~F.coalesce(empty, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Language ID and SentencePiece have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
