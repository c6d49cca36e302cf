"""Sharding by proportional stratified interleaving (native DataFrame operations).

Rows of each source are ranked in a seeded shuffle; the fractional rank
``(2 * rank + 1) / (2 * rows of the source)`` spreads every source evenly over
(0, 1).  Sorting all rows by fractional rank and cutting into equal pieces gives
shards whose row counts differ by at most one and that all carry the mixture.

Ranks never need one task per source: rows fall into ``buckets`` slices of the
hash range, a prefix sum over the (source, slice) counts gives each slice its
first rank, and only a slice is sorted.  The same is done for the global order.
A source with a third of all rows is spread over all its slices.

Defined results: a null text has size 1 and CRC 0; a null source is a stratum
of its own; repeated rows (equal id, size, CRC) are interchangeable and each
gets its own slot; an empty table gives an empty result; other columns of the
input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage

SHARDS = 16
SEED = 20240611
#: Slices of the hash range per source and of the fractional ranks overall.
BUCKETS = 4096


def assign_shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, frac."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    u = F.xxhash64(F.lit(seed), F.col(id_col))
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            # a null source must not equal a source that is spelled like its stand-in
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("stratum"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            u.alias("u"),
            F.pmod(u, F.lit(buckets)).cast("int").alias("slice"),
        ),
        "shard-rows",
    )
    first = W.partitionBy("stratum").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        slim.groupBy("stratum", "slice")
        .count()
        .select(
            "stratum",
            "slice",
            F.coalesce(F.sum("count").over(first), F.lit(0)).alias("start"),
            F.sum("count").over(W.partitionBy("stratum")).alias("n_source"),
        )
    )
    in_slice = W.partitionBy("stratum", "slice").orderBy("u", "doc_id", "size", "text_crc32")
    ranked = slim.join(starts, ["stratum", "slice"]).withColumn("rank", F.col("start") + F.row_number().over(in_slice) - 1)
    ranked = ranked.withColumn("frac", (2 * F.col("rank") + 1).cast("double") / (2 * F.col("n_source")).cast("double"))
    ranked = stage(
        ranked.select(
            "doc_id", "source", "stratum", "size", "text_crc32", "frac", F.floor(F.col("frac") * buckets).cast("int").alias("cell")
        ),
        "shard-ranks",
    )
    # at most `buckets` rows: their running sum in one task is bounded
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy("cell")
        .count()
        .select(
            "cell",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"),
            F.sum("count").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
        )
    )
    in_cell = W.partitionBy("cell").orderBy("frac", "stratum")
    placed = ranked.join(offsets, "cell").withColumn("pos", F.col("start") + F.row_number().over(in_cell) - 1)
    return placed.withColumn("shard", F.expr(f"pos * {n_shards} div n")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        # the first position of shard s is ceil(s * n / shards)
        (F.col("pos") - F.expr(f"(shard * n + {n_shards - 1}) div {n_shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "frac",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, rows_per_file: int = 100_000, id_col: str = "doc_id", **options) -> None:
    """Write ``docs`` to ``path/shard=s`` in slot order, ``rows_per_file`` rows a file; ids must be unique."""
    where = assign_shards(docs, n_shards, id_col=id_col, **options).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.drop("shard", "slot").join(where, docs[id_col] == where["_id"]).drop("_id")
    piece = F.floor(F.col("slot") / rows_per_file)
    rows.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_stratified_shards(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return assign_shards(table(spark, sf_dir, "documents"))
