"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.

Rows without a key are judged by their own text like all others, as are rows that share a
key. Null and empty texts pass toxicity by the score of an empty window, have no copies and
hold no benchmark item; the mix takes documents without words 0 times, so they end there. Of
rows that repeat wholly near-dedup leaves one. Without labels of both classes nothing is
toxic, without benchmark items nothing is contaminated, and no documents give no rows. Near-dedup
takes five words, as word shingles do where no contract says otherwise; op4's two are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillbank.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from quillbank.llm.common import settle, table

#: Of the labelled rows, those of this remainder of three are never learnt from.
HELD_OUT = 1
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=HELD_OUT)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, checksum, shard and place in it."""
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A network, near duplicates and a draw are more than SQL can express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
