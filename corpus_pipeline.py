"""The corpus pipeline: documents pass the stages below, each written as Parquet and read again.

1. quality classifier: documents that it rejects go
2. near-duplicates: one document of each group stays, the one of least id
3. benchmark decontamination: contaminated documents go; from the others, matches of a window or more are cut
4. mixing sources: documents are sampled to the raked weights
5. sharding: every document left gets its shard and slot

Every stage but the last returns the columns of documents.  Stages 1, 3 and 4
decide row by row; stage 3 counts ``n_chars`` anew where it cuts a text.  Stage 2
joins its decision back by ``doc_id`` (null equals null), so rows that share an id
share the decision, and of rows of equal id and text it keeps one.  Extra columns
of any name pass all stages but the last.  Very long texts are read whole.  An
empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.common import stage, table
from subledger.llm.decontam import keep_uncontaminated
from subledger.llm.mix import KEEP, sample_documents
from subledger.llm.nbsvm import keep_good
from subledger.llm.neardup import link_documents
from subledger.llm.shard import assign_shards


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in ``ids`` (null equals null)."""
    ids = ids.select("doc_id").distinct().hint("shuffle_hash").alias("ids")
    return docs.alias("docs").join(ids, F.col("docs.doc_id").eqNullSafe(F.col("ids.doc_id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group; documents linked with nothing stay."""
    linked = stage(link_documents(docs).select("doc_id", "kept"), "pipeline-linked")
    kept = _keep(docs, linked.filter("kept"))
    # equal rows are copies too; a second shuffle of the texts is only needed where an id repeats
    if linked.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, without matches of a window or more."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), length=length)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the raked mixture samples, ``KEEP`` of all tokens expected."""
    return sample_documents(docs, keep=KEEP)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, frac of every document left."""
    return assign_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The fitted classifier and the near-duplicate components have no SQL form; tests use a brute-force version.
ORACLE_SQL = None
