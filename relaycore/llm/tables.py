"""Reading the input tables and cutting lineage in the shared folder."""

import gc
import pickle
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows of an Arrow batch at most: a batch of long texts is held several times on either side of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to `BATCH_ROWS`, so memory does not follow the length of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local session, as in tests, gets one of its own where that is unset: on a
    cluster executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="relaycore-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever it is stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(columns, *wanted: str) -> list[str]:
    """Names for internal columns that clash with none of `columns`, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go.

    Spark deletes them when the driver's objects that name them are collected, here
    and in the JVM; by itself that may be half an hour later, and steps pile up.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A table of `df` in the shared folder, and its path for `remove`; unlike a checkpoint it is read by columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def share(spark: SparkSession, value):
    """A broadcast of any object, as a function that returns it on an executor.

    Classes travel by value, so executors need no copy of the package.
    """
    small_batches(spark)
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def bucket_count(spark: SparkSession, factor: int = 4, least: int = 16) -> int:
    """A power of two that follows the cluster's shuffle parallelism."""
    small_batches(spark)
    wanted = max(least, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()


def crc_mod(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
