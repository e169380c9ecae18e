"""A training-corpus pipeline of five operators, each stage written as Parquet and read by the next.

toxicity -> SimHash near-dedup -> substring dedup -> benchmark decontamination -> SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, simhash, spm, substring_dedup, toxicity
from keyloom.llm.common import shared_root, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network, learnt from all labels of docs, doesn't call toxic. Null and empty texts stay."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies.

    Null and empty texts have nothing to copy and stay, as do rows with a null
    doc_id; rows that repeat a doc_id stay or go together.
    """
    some = docs.where("doc_id is not null and text is not null and text <> ''")
    gone = simhash.simhash_dedup(some).where("component_id <> doc_id").select("doc_id").distinct()
    gone = stage(gone, "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of windows that an earlier document has.

    Texts that lose nothing stay as they are, white space included; the others
    are their kept words joined by one space, with n_chars anew. A document of
    which no word is kept goes.
    """
    out = substring_dedup.substring_dedup(docs.select(*docs.columns, F.col("text").alias("__whole")), text="__whole").drop("__whole")
    out = out.where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="documents").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, and ids, n_tokens, round_trip of the text."""
    return spm.encode(docs, columns=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: Networks, XXH64 and the search for the best pieces can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's result is a table in the shared folder."""
    shared_root(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
