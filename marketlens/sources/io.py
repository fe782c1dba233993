"""Scans, snapshot resolution and sinks (SRC-01..SRC-12).

Scratch output goes under the session's shared checkpoint folder (the
cluster's ``spark.checkpoint.dir``), never a machine-local temp folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def _to_text(df: DataFrame) -> DataFrame:
    """Complex columns (struct/array/map) as JSON text for row-oriented sinks."""
    cx = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, cx)
                       else F.col(f.name) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-01: CSV with header; quoted fields may hold newlines (multiLine)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SRC-05: CSV sink with header (complex columns as JSON text)."""
    _to_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SRC-06 / SRC-09: Parquet sink, optionally partitioned (e.g. country, ingest_ts)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """SRC-07: JSON lines, NULL fields kept (like ``orient='records'``)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_with_errors(df: DataFrame, valid: "F.Column", path: str, error_path: str) -> bool:
    """SRC-08: valid rows to ``path``; invalid rows to ``error_path`` only when any.

    The input is persisted once so the two writes and the emptiness check
    scan it a single time. Returns whether an error file was written.
    """
    cached = df.withColumn("_valid", F.coalesce(valid, F.lit(False))) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cached.where("_valid").drop("_valid").write.mode("overwrite").parquet(path)
        bad = cached.where(~F.col("_valid")).drop("_valid")
        has_errors = bad.limit(1).count() > 0
        if has_errors:
            bad.write.mode("overwrite").parquet(error_path)
        return has_errors
    finally:
        cached.unpersist()


def with_file_metadata(df: DataFrame) -> DataFrame:
    """Source file name and modification time of every row (hidden _metadata)."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_modification_time").alias("file_time"))


# Preferred snapshot name fragment and excluded fragments.
PREFERRED_FRAGMENT = "amazon_products_viz"
EXCLUDED_FRAGMENTS = ["modeling", "train", "test", "val", "pipeline"]


def newest_snapshot(spark: SparkSession, folder: str, preferred: str = PREFERRED_FRAGMENT,
                    excluded: Sequence[str] = EXCLUDED_FRAGMENTS) -> tuple[str, str, int]:
    """SRC-02: path, name and time (seconds since 1970) of the newest snapshot (a file or a folder of
    part files) in a folder, from the file system's listing: no snapshot is read to choose one.

    Preference: names containing ``preferred`` and none of ``excluded``;
    else any name without the excluded words; else any. Chosen by the
    newest modification time (ties by name).
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    ranked = []
    for f in found:
        name = f.getPath().getName()
        clean = not any(x in name.lower() for x in excluded)
        tier = 2 if clean and preferred in name.lower() else 1 if clean else 0
        ranked.append((tier, f.getModificationTime() // 1000, name, f.getPath().toString()))
    if not ranked:
        raise FileNotFoundError(f"no snapshot in {folder}")
    _, seconds, name, path = max(ranked)
    return path, name, seconds


def set_time(spark: SparkSession, path: str, seconds: int) -> None:
    """Stamp a snapshot with a modification time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(at, seconds * 1000, -1)


def with_snapshot(df: DataFrame, name: str, seconds: int) -> DataFrame:
    """SRC-03: the snapshot's date (first 8 digits of its name) and its file time as text (UTC)."""
    named = df.withColumn("_name", F.lit(name))
    text = F.date_format(F.timestamp_seconds(F.lit(seconds)), "dd/MM/yyyy HH:mm")
    return named.withColumns({"snapshot_date": snapshot_date("_name"), "file_time": text}).drop("_name")


def snapshot_date(file_name) -> "F.Column":
    """SRC-03: first 8-digit run of the file name as a date (NULL if none or invalid)."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    digits = F.nullif(F.regexp_extract(c, "([0-9]{8})", 1), F.lit(""))
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def landed_search_items(pages: DataFrame) -> DataFrame:
    """SRC-04: landed search pages ``{category, query, page, results: [...]}`` ->
    one row per item tagged with its seed category and query."""
    return pages.select(F.col("category").alias("_seed_category"),
                        F.col("query").alias("_seed_query"), "page",
                        F.explode("results").alias("item")).select(
        "_seed_category", "_seed_query", "page", "item.*")


def cached(df: DataFrame) -> DataFrame:
    """SRC-11: keep a table in memory (spilling to disk) across questions."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def export_records(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SRC-12: pruned projection, one JSON record per row (no collect)."""
    return df.select(F.to_json(F.struct(*cols)).alias("record"))


def read_split(spark: SparkSession, path: str, name: str, target: str, key: str = "asin") -> tuple[DataFrame, DataFrame]:
    """SRC-10: one stored split as features and target (both with the key and the split's name);
    only its partition is read."""
    rows = spark.read.parquet(path).where(F.col("split") == name)
    return rows.drop(target), rows.select(key, "split", target)
