"""Small helpers shared by the operators: columns, folds, table access, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir

#: Java pattern of one word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: About so many rows share a bucket of a distributed rank or running sum.
BUCKET_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hash_share(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder.

    Unlike a checkpoint, the table read again has sizes of its own: a checkpoint keeps the planner's
    estimates, which multiply from round to round of a loop until planning itself is slow.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Add a rank from 0 within ``keys``, without sorting a whole key in one task.

    Rows of a key go to buckets by a hash of ``order``; a rank is the rows in earlier buckets plus
    the place in its own. ``rows`` is the number of rows, which sets the number of buckets, so that
    a key that holds any share of the rows spreads over tasks. Rows equal in ``order`` are ranked
    in any order.
    """
    n_buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(n_buckets)))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (df.withColumn("_place", place).join(starts, [*keys, "_bucket"])
            .withColumn(name, F.col("_ahead") + F.col("_place") - 1).drop("_bucket", "_place", "_ahead"))


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers outlive tasks, and what the
    allocators of Arrow and C keep would add up over the stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shipped(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcast an object of a bounded size; in a task the result gives the object.

    It is pickled by value, classes included, so executors need no copy of the package."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(data.value)
