"""Files as tables: JSON, JSON lines, CSV, folders of artifacts, filled-in forms, and write-once sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.exprs import natural_key
from quire.operators.reconcile import group_fingerprint


#: Segments of a JPEG that are looked through for its frame header.
MOST_SEGMENTS = 64


def read_json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files of one JSON object each; anything else at the root, or a value that doesn't fit the schema, fails the read."""
    roots = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\s﻿]+", "")), 1, 1).alias("first"))
    if roots.where("first <> '{'").limit(1).count():
        raise ValueError(f"a file of {path} holds no JSON object at its root")
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under an explicit schema; a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, nulls left out; the path must be new."""
    df.write.mode("errorifexists").json(path)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, every column a string; the header must name the columns in their order."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST", multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the path must be new."""
    df.write.mode("errorifexists").csv(path, header=True, escape='"')


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, byte_size, modified_at, sha256, natural_order_key`` of the files below a folder; contents are hashed where they are read. Files of no bytes are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), natural_key(path).alias("natural_order_key"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One fingerprint of an inventory's paths and hashes, to compare a folder before and after."""
    return group_fingerprint(files.withColumn("tree", F.lit("tree")), ["tree"], F.concat_ws("=", "path", "sha256")).select("fingerprint")


def checked_artifacts(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``path, status`` of recorded artifacts (path, sha256) against an inventory: valid, hash_mismatch or missing; files that nobody recorded are ``unrecorded``."""
    a = recorded.select(F.col("path").alias("recorded_path"), F.col("sha256").alias("recorded_hash"))
    b = found.select(F.col("path").alias("found_path"), F.col("sha256").alias("found_hash"))
    status = F.when(F.col("recorded_path").isNull(), "unrecorded").when(F.col("found_path").isNull(), "missing").when(F.col("recorded_hash").eqNullSafe(F.col("found_hash")), "valid").otherwise("hash_mismatch")
    return a.join(b, F.col("recorded_path") == F.col("found_path"), "full_outer").select(F.coalesce("recorded_path", "found_path").alias("path"), status.alias("status"))


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's output without overwriting, then give the metadata of the files written."""
    df.write.mode("errorifexists").parquet(path)
    return inventory(df.sparkSession, path, "*.parquet")


def write_atomic(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside the path and rename, so that readers see the whole output or none; the path must be new.

    What a failed write left beside the path is replaced by the next one.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.format(kind).mode("overwrite").save(beside.toString())
    if not fs.rename(beside, target):
        raise FileExistsError(path)


def image_sizes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, kind, width, height`` of the files below a folder from their first bytes: png, gif, jpeg; others have null measures, files of no bytes are not listed.

    A JPEG's frame header is the first segment C0 to CF that is no table, found by the lengths of the segments before it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    code = F.hex("content")
    number = lambda c: F.conv(c, 16, 10).cast("int")
    at = lambda first, n: F.substr(code, F.lit(2 * first + 1) if isinstance(first, int) else 2 * first + 1, F.lit(2 * n))
    little = lambda first: number(F.concat(at(first + 1, 1), at(first, 1)))
    kind = F.when(code.startswith("89504E470D0A1A0A"), "png").when(code.startswith("474946383"), "gif").when(code.startswith("FFD8FF"), "jpeg")
    # Segments from byte 2: marker FF xx and a length; the fold stays at the first frame header.
    is_frame = lambda p: at(p + 1, 1).rlike("^C[012356799ABDEF]$")
    frame = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), F.lit(2), lambda p, _: F.when(is_frame(p) | (p + 4 > F.length("content")), p).otherwise(p + 2 + F.coalesce(number(at(p + 2, 2)), F.lit(0))))
    held = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", kind.alias("kind")).withColumn("frame", F.when(kind == "jpeg", frame))
    found = held.withColumn("framed", is_frame(F.col("frame")))
    width = F.when(F.col("kind") == "png", number(at(16, 4))).when(F.col("kind") == "gif", little(6)).when(F.col("framed"), number(at(F.col("frame") + 7, 2)))
    height = F.when(F.col("kind") == "png", number(at(20, 4))).when(F.col("kind") == "gif", little(8)).when(F.col("framed"), number(at(F.col("frame") + 5, 2)))
    return found.select("path", "kind", width.alias("width"), height.alias("height"))


def parse_form(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, field, value`` of filled-in Markdown forms: ``## section`` heads and ``- field: value`` lines.

    Lines before the first head have a null section; a null or empty text gives no rows.
    """
    head, line = r"^##\s+(.+?)\s*$", r"^[-*]\s*(?:\[[ xX]\]\s*)?([^:：]{1,80}?)\s*[:：]\s*(.*?)\s*$"
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: x.rlike(head) | x.rlike(line))
    # The fold carries the section in force, so the lines of a document never leave their row.
    start = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<struct<section:string,field:string,value:string>>").alias("rows"))

    def step(acc, x):  # noqa: ANN001, ANN202
        entry = F.array(F.struct(acc["section"].alias("section"), F.regexp_extract(x, line, 1).alias("field"), F.regexp_extract(x, line, 2).alias("value")))
        is_head = x.rlike(head)
        return F.struct(F.when(is_head, F.regexp_extract(x, head, 1)).otherwise(acc["section"]).alias("section"), F.when(is_head, acc["rows"]).otherwise(F.concat(acc["rows"], entry)).alias("rows"))

    return documents.select(key, F.explode(F.aggregate(lines, start, step, lambda acc: acc["rows"])).alias("r")).select(key, "r.section", "r.field", "r.value")


def missing_columns(df: DataFrame, required: StructType) -> list[str]:
    """Names of required columns that are missing or of another type: the schema contract of a table."""
    held = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in required.fields if held.get(f.name) != f.dataType]
