"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder, so a lost executor costs one read, not a recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder serves on a local master
    (tests); on a cluster, whose machines share no such folder, it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return without_estimates(df.checkpoint(eager=True))


def without_estimates(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, without the size that its plan was estimated to have.

    A checkpoint keeps that estimate, and a join's is the product of its sides': over rounds of joins the number of its
    digits doubles, until the planner does nothing but multiply.
    """
    frame = df._jdf
    plain = frame.sparkSession().internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False)
    return DataFrame(plain, df.sparkSession)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers: to those of a cluster always, to local ones where they would not find it themselves."""
    root = Path(__file__).resolve().parent.parent
    named = [Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    context = spark.sparkContext
    if (root not in named or not is_local(spark)) and not any(str(f).endswith("/quire.zip") for f in context.listFiles):
        folder = tempfile.mkdtemp(prefix="quire-package-")  # code on the driver, which serves it to the executors
        context.addPyFile(shutil.make_archive(f"{folder}/quire", "zip", root, "quire"))


def shipped(df: DataFrame) -> DataFrame:
    """``df`` itself, for a Python stage to follow: the workers have the package from here on."""
    ship_package(df.sparkSession)
    return df


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
