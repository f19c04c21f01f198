"""Readers of the Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory; the schema is the file's own, never inferred from values."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connect(spark: SparkSession, folder: str, required: Sequence[str]) -> dict[str, DataFrame]:
    """The required tables of an existing folder; a folder or table that is absent fails at once, none is made."""
    found, missing = {}, []
    for name in required:
        try:
            found[name] = table(spark, folder, name)
        except AnalysisException:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return found


def foreign_key_violations(rows: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """``reference, n_rows``: values of a reference, null excepted, that no target row has."""
    known = targets.select(F.col(target).alias("q_known")).distinct()
    bad = rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("q_known"), "left_anti")
    return bad.groupBy(F.col(reference).cast("string").alias("reference")).agg(F.count("*").alias("n_rows"))
