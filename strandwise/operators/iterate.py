"""Loops over plans: lineage is cut in the shared folder each round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df in the given total order with places from 1, numbered without one task that holds all.

    Rows are sorted by range; a row's place is its number in its part plus the
    sizes of the parts before, of which there are no more than partitions.
    """
    placed = settle(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_part")
    return numbered.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_part", "_at", "_before")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names.

    Where that is unset, a local session gets a temporary folder, and a
    cluster, whose executors wouldn't see it, an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    Its lineage is cut there, and a loop's next plan starts from the table's
    real size: a checkpoint keeps the estimate of the plan behind it, which
    every join multiplies, until its digits alone take minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve_chains(pointers: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """(keys, carried): for each row, the carried values of the end of its chain. A row's `to` is a struct like keys, or null at an end.

    Each round lets every row point to where its target points, and settles in
    the shared folder; chains of any length end after as many rounds as the
    logarithm of the longest. A target without a row ends its chain, too. A
    row whose chain runs into a circle has no end and is left out.
    """
    now = settle(pointers.select(*keys, "to", *carried))
    for _ in range(now.count().bit_length() + 1):
        moving = now.where("to is not null")
        if moving.isEmpty():
            break
        target = now.select(F.struct(*keys).alias("to"), F.col("to").alias("further"), *[F.col(c).alias(f"_{c}") for c in carried])
        moved = moving.join(target, "to", "left").select(*keys, F.col("further").alias("to"), *[F.coalesce(f"_{c}", c).alias(c) for c in carried])
        now = settle(now.where("to is null").unionByName(moved))
    return now.where("to is null").drop("to")
