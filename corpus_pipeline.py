"""A training corpus from raw documents: filter, de-duplicate, decontaminate, mix, write token shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last return the columns of
``docs``.  Between stages the documents are Parquet on shared storage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundelta.llm import decontaminate, mixing, neardup, sstable, toxicity
from rundelta.llm.common import materialize, quoted

#: Five-word shingles at a similarity of 0.8 or more.
SIMILARITY_PERCENT = 80
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of smallest identifier, null after all others; rows without words stay."""
    return neardup.keep_one_of_each(docs, percent=SIMILARITY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to shards and shuffled there."""
    packed = docs.select("doc_id", "source", "text", F.struct(*quoted(docs.columns)).alias("whole"))
    shards = mixing.shard_count(docs)
    mixed = mixing.mix(packed, n_shards=shards, keep=["whole"])
    return mixing.shuffled(mixed, ["whole"], shards).select("whole.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in identifier order; a document taken twice is written twice."""
    manifest = sstable.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return sstable.read_digests(spark, manifest)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token shards", write_tokens),
]

#: Scores of a fitted classifier, latent cosines and token identifiers are not SQL, so the whole is not.
#: Near duplicates and the mix by themselves have SQL beside their queries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
