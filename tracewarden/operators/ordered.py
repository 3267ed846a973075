"""Totals in a global order without bringing all rows into one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Give checkpoint() the cluster's folder, or with a local master (as in tests) one of our own.

    A cluster that names none is an error, since a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewarden-"))


def _laid_out(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted, with the partition (_p) and the place in it (_i), and cut off from their lineage."""
    shared_folder(df.sparkSession)
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """``df`` with 1, 2, ... in ``order``, which must tell all rows apart. Only a count for each partition is ordered in one task."""
    laid = _laid_out(df, order)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = laid.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_o"))
    return laid.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def running_max(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, by name, the largest of each value of all earlier rows, null before the first one. Of structs that begin with the
    order it is the latest. A partition is walked in order, and one row of each partition tells the others what came before."""
    names = list(values)
    laid = _laid_out(df.select("*", *(v.alias(f"_v{k}") for k, v in enumerate(values.values()))), order)
    carried = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    above = laid.groupBy("_p").agg(*(F.max(f"_v{k}").alias(f"_m{k}") for k in range(len(names)))).select("_p", *(F.max(f"_m{k}").over(carried).alias(f"_o{k}") for k in range(len(names))))
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.select("*", *(F.max(f"_v{k}").over(inside).alias(f"_w{k}") for k in range(len(names)))).join(F.broadcast(above), "_p")
    return rows.select(*df.columns, *(F.greatest(f"_w{k}", f"_o{k}").alias(name) for k, name in enumerate(names)))


def fresh(df: DataFrame, arrival: list[Column], seq: str = "seq") -> DataFrame:
    """``df`` with ``duplicate``: a positive ``seq`` that isn't over all that arrived before. Null and 0 always apply."""
    found = running_max(df, arrival, {"_top": F.when(F.col(seq) > 0, F.col(seq))})
    return found.withColumn("duplicate", (F.col(seq) > 0) & (F.col(seq) <= F.coalesce("_top", F.lit(0)))).withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("_top")


def newest(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The last ``most`` rows of each key; Spark limits groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
