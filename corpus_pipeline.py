"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import bpe, common, contamination, minhash, suffixes, toxicity
from lantern.llm.queries import BYTE_VOCAB


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    common.prepare(spark)
    chain = toxicity.train(docs, common.table(spark, sf_dir, "labels"), toxicity.CATEGORIES, toxicity.SAMPLE_ROWS)
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of five-word shingles) the document with the smallest doc_id stays.

    Rows count by themselves: of rows with equal or null doc_id each stays or goes by its own text. Documents without words all stay.
    """
    common.prepare(spark)
    return minhash.without_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document holds are cut out; characters cut in two go."""
    common.prepare(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffixes.dedup(docs, carry=others or None)
    text = suffixes.whole_characters(F.col("kept"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(made[c].alias(c) if c in made else F.col(f"carried.{c}").alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.prepare(spark)
    return contamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"), share=0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit integers) and digests of ids and decoded text."""
    common.prepare(spark)
    return bpe.encode_decode(docs, BYTE_VOCAB, keep=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
