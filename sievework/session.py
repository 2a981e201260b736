"""SparkSession with the settings the engine counts on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A union that claims its children's partitioning, while runtime re-planning changes theirs, makes later joins and
#: aggregations miss rows (seen in Spark 4.1.2), so every session of the engine has it off.
UNION = ("spark.sql.unionOutputPartitioning", "false")

#: Rows of an Arrow batch: the JVM, the stream between and each Python worker hold one at a time, so a worker's memory doesn't
#: grow with the rows of a partition.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

#: Fixed settings: UTC times, runtime re-planning, skewed joins split, Arrow batches of bounded rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    UNION[0]: UNION[1],
    BATCH[0]: BATCH[1],
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one in local mode alone (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: no folder that all executors see")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="sievework-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: written as Parquet below the shared folder and read again.

    A table that is read again, unlike a checkpointed one, claims no partitioning that runtime re-planning may have changed.
    """
    spark = df.sparkSession
    spark.conf.set(*UNION)
    spark.conf.set(*BATCH)
    path = f"{shared_dir(spark)}/sievework-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: the join shuffles and sorts, Spark never broadcasts it.

    Spark estimates a table by its compressed files and a generator by its child, so without this a table of a few MB that is
    exploded to twenty times its rows is built whole on the driver.
    """
    return df.hint("merge")


def local_session(name: str = "sievework", cores: int | None = None, shuffle_partitions: int | None = None, memory: str = "6g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, set SETTINGS at submission instead."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions or cores)}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
