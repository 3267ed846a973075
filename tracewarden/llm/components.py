"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's own, or with a local master (as in tests) a temporary one.

    A cluster that names none is an error, since a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewarden-"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round over edges (a, b) with b < a: neighbours move to the smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b) of longs; the component is its smallest node.

    Alternating large and small stars until nothing moves. Minima are pre-aggregated and joined back, so
    that a node with very many edges is split like any skewed join. Loops and repeated edges do no harm, edges with a null
    are left out, and no edges give no rows. Each round is cut off by checkpoint().
    """
    shared_folder(edges.sparkSession)
    kept = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    state = _state(kept)
    while state[0]:
        kept = _stars(_stars(kept, True), False).checkpoint()
        following = _state(kept)
        if following == state:
            break
        state = following
    found = kept.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after components ``found`` are joined by links (a, b) between components; checkpointed."""
    more = components(links).select(F.col("node").alias("component"), F.col("component").alias("merged")).checkpoint()
    moved = found.join(more, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    alone = more.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("merged").alias("component"))
    return moved.unionByName(alone).checkpoint()
