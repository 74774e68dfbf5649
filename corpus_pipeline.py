"""From documents to a training mix: toxicity, copies, near-copies, benchmark passages, mixing.

Every stage is one operator of tidemark.llm over all that its predecessor kept, written as
Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import remove_contaminated
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_copies import keep_one
from tidemark.llm.shared import staged, table
from tidemark.llm.toxicity import drop_toxic

#: Near-duplicates: texts whose five-word shingles have a Jaccard index of SIMILARITY or more link; none is missed.
#: Fingerprints within NEAR_BITS of 64 bits are the pairs that are looked at first; each link is checked exactly.
NEAR_BITS, SIMILARITY = 3, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    Null and empty texts have no words and are judged by the models' base rates; long ones count
    whole; rows that repeat are judged alike; without labels all stay; other columns pass through.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, null ids last.

    Null counts as empty; of rows that repeat id and text one stays; other columns pass through.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Texts without words are one group; rows without doc_id all stay; of rows that repeat a
    doc_id those stay whose texts are in no group with a smaller one; other columns pass through.
    """
    return keep_one(docs, words=5, radius=NEAR_BITS, similarity=SIMILARITY, checked=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts stay; other columns pass through."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes words of, with how many; rows without words are never taken."""
    return mix_sources(docs).filter(F.col("taken") > 0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained models, 64-bit fingerprints and seeded hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: every stage over what the one before it kept. An empty table gives an empty mix."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
