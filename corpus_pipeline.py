"""From raw documents to shuffled training shards: five stages, each written and read again by the next.

A stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Labels and benchmark items come from the tables beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import packed, unpacked
from gridloom.llm.decontam import drop_contaminated
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.near_dups import drop_near_duplicates
from gridloom.llm.quality import quality_rules
from gridloom.llm.sharding import shuffle_shards
from gridloom.session import cut_lineage
from gridloom.tables import table

#: The stages have no SQL form (hashed models, signatures, alignment); tests compare them with plain Python.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio fitted on this input."""
    judged = quality_rules(packed(docs), table(spark, sf_dir, "labels"))
    return unpacked(judged.filter("kept"), docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return unpacked(drop_near_duplicates(packed(docs)), docs.columns)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, verbatim or edited."""
    return unpacked(drop_contaminated(packed(docs), table(spark, sf_dir, "benchmark")), docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's word budget takes it."""
    need = ("doc_id", "text", "source")
    return unpacked(mixed_documents(packed(docs, need)), docs.columns, need)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order: the documents' columns, shard, slot and the shard if there were one more."""
    return unpacked(shuffle_shards(packed(docs)), docs.columns, more=("shard", "slot", "grown_shard"))


STAGES = [
    ("quality rules", reject_low_quality),
    ("near duplicates", keep_one_of_each_class),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_to_targets),
    ("sharding", shuffle_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
