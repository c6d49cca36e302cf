"""Helpers shared by the operators: table access, staging, hashing of byte strings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from subledger.session import checkpoint_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Separators of words in the quality, dedup and mixing operators (space, tab to CR).
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _staging(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{_staging(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` whose Python workers look for this package where the driver found it."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return df.mapInArrow(run, schema)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later frame reads (only what :func:`stage` wrote)."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            if "/llm/" in folder:
                _delete(df.sparkSession, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete every table that this application has staged; for use when all results are written."""
    _delete(spark, _staging(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(seed: str, *cols: Column) -> Column:
    """A uniform double in [0, 1) from the first 32 bits of md5(seed:value:...)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0)."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    edge = lambda p: (p == "").cast("int")
    n = F.size(parts) - edge(F.element_at(parts, 1)) - F.when(F.size(parts) > 1, edge(F.element_at(parts, -1))).otherwise(0)
    return n.cast("long")
