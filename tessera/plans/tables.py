"""Tables written once in the folder that all executors share, to cut lineage and to reuse work."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster session is
    refused, as its executors could not see such a folder.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with its own schema."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Remove the files behind a table of :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect garbage at the driver, upon which Spark removes the shuffle files and broadcasts that no
    table refers to any more: else a long job keeps them until the driver happens to run short of memory.
    """
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than the session shuffles to, over all of them.

    Costly work on a small table would else run in the few tasks that its files make. Tables that are
    estimated to fill that many tasks by themselves stay as they are, and nothing is shuffled.
    """
    spark = df.sparkSession
    parts, size = shuffle_partitions(spark), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(parts) if size < parts * per_task else df
