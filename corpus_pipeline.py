"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before kept; its result is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import toxicity
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import pack, token_pieces
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.suffix_dedup import cut_repeats
from gridloom.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labelled training rows does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.remainder(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more of these documents share."""
    return dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies; documents without words all stay."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier already."""
    return cut_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack(stored(token_pieces(docs, tokenizer_path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the suffix arrays or the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
