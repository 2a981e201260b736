"""Shared helpers of the training-data operators: tables, the shared folder, salted joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of the small side, and parts of a hot key on the large side, in salted joins.
SALTS = 16


#: Rows of an Arrow batch: the JVM, the stream between and the Python worker each hold one at a time.
ARROW_ROWS = "1000"


def settled(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, and union partitioning off: a union that claims its children's partitioning,
    while runtime re-planning changes theirs, makes later joins and aggregations miss rows (seen in 4.1.2)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that any file system Spark knows can serve."""
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir; a temporary one in local mode alone (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = getattr(spark.sparkContext, "_sievework_shared", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: no folder that all executors see")
        held = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext._sievework_shared = held
        spark.sparkContext.setCheckpointDir(held)
    return held


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/sievework-{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again."""
    path = work_dir(settled(df.sparkSession), what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the used columns it has, and all others in one struct, so that no working column can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*(c for c in docs.columns if c in used), F.struct(*rest or [F.lit(None).alias("none")]).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """rows that came from packed(docs, *used), with docs' columns in docs' order."""
    return rows.select(*(F.col(c) if c in used else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one (a stage's intermediate that nothing reads any more)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: the join shuffles and sorts, Spark never builds df on the driver.

    Spark goes by a table's compressed files, and by a generator's child, so what it holds for small may be large.
    """
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, keys: Iterable[str], how: str, by: Column, salts: int = SALTS, grows: bool = True) -> DataFrame:
    """Equi-join where one key may hold a third of big's rows; small has at most one row a key.

    big's rows of a key are dealt over `salts` parts by the expression `by`, small is repeated once a part.
    grows=False: small is bounded however large the input is, so it may be broadcast.
    """
    keys = list(keys)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(merged(right) if grows else right, [*keys, "_salt"], how).drop("_salt")


def running(rows: DataFrame, order: list[Column], what: str, **sums: str) -> DataFrame:
    """rows with seq (from 0, in a global order) and, for each name=column of sums, the column's sum over all rows before.

    Range partitioning deals the rows out by their order, so a group that holds a third of them lies in many partitions;
    each partition is numbered for itself and shifted by the totals of those before, one row a partition. Rows that tie in
    `order` get consecutive numbers in some order, so `order` must tell apart all rows that differ in what matters.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)), F.monotonically_increasing_id().alias("_tie"))
    parts = written(keyed.repartitionByRange(*names, "_tie").withColumn("_part", F.spark_partition_id()), what)
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), *(F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums))
    within = Window.partitionBy("_part").orderBy(*names, "_tie")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", (F.row_number().over(within) - 1).alias("_row"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{k}") for k, c in sums.items()))
    out = out.join(F.broadcast(starts), "_part")
    return out.select(*rows.columns, (F.col("_start") + F.col("_row")).alias("seq"), *((F.col(f"_s_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums))
