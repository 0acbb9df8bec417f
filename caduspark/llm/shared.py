"""Helpers that all operators of this subpackage share: session settings, shared tables, hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; bounds the worker's memory whatever the text length.
ARROW_BYTES = 4 << 20
#: A key is hot beyond this many rows and beyond a share of 1 / HOT_KEYS of all rows, so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 4_096, 10_000


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts can't fill a Python worker; a smaller bound of the caller stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(min(ARROW_BYTES, int(spark.conf.get(name).rstrip("bB")))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir or the checkpoint dir that is set.

    In local mode, where driver and executors are one machine, a folder of our own stands in; on a cluster a missing one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="caduspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let the executors delete the shuffle files of queries that have ended.

    Spark deletes them once the driver's garbage collector finds that no plan needs them, which with an idle
    driver may be never; asked for after each large step, the local disks hold one step's shuffles only.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table that no later plan reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def reads(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """Note the tables of write_table that a lazy result still reads; see release."""
    result._reads = [*getattr(result, "_reads", []), *tables]
    return result


def release(result: DataFrame) -> None:
    """Delete the tables noted by reads, once the result has been written."""
    for table in getattr(result, "_reads", []):
        drop_table(table)


def with_added(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df plus column `name`; a column of df with that name goes on as <name>_in."""
    return df.select(*[F.col(f"`{c}`").alias(f"{c}_in") if c.lower() == name.lower() else F.col(f"`{c}`") for c in df.columns], value.alias(name))


def skew_join(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with facts, which holds one row a key with `n`, how many of the `total` rows have that key.

    The rows of a hot key never meet in one task: the facts of hot keys are broadcast, at most HOT_KEYS of
    them, whatever the size of the data; all other keys shuffle.
    """
    cut = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col("n") > cut))
    cold = rows.join(hot.select(*on), on, "left_anti").join(facts.where(F.col("n") <= cut).hint("merge"), on)
    return rows.join(hot, on).unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: edges (a, b: long) -> (node, component), component = smallest node.

    Each round takes the smallest label among a node and its neighbours, then jumps to that label's own
    label; rounds are written to the shared folder.  Hubs and giant components go through skew_join, so
    a hot node only meets partial minima, never a list.  Empty edges give no rows; self loops and repeated edges are harmless.
    """
    both = edges.select("a", "b").where("a <> b")
    both = write_table(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = write_table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("component"), "n"),
        "labels",
    )
    nodes = labels.count()
    while True:
        near = skew_join(both, labels.withColumnRenamed("node", "b"), ["b"], total).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"), F.col("n").alias("degree"))
        step = write_table(step, "step")
        jump = step.groupBy("c").agg(F.count("*").alias("n")).join(step.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c")
        new = write_table(
            skew_join(step, jump, ["c"], nodes).select("node", F.least("c", "cc").alias("component"), "old", F.col("degree").alias("n")),
            "labels",
        )
        moved = new.where("component <> old").limit(1).count()
        drop_table(step)
        drop_table(labels)
        labels = new
        if not moved:
            drop_table(both)
            return reads(labels.select("node", "component"), labels)
