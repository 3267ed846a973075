"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Blocks of vectors keep an inverted file:
for each pivot the weight of every vector that has it in its prefix, which falls with its place. The
footrule distance of two prefixes is a constant less twice the sum, over shared pivots, of the lesser
weight; so a query adds up the posting lists of its own pivots, and the nearest part of a block is
ranked anew by exact inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .components import shared_folder

#: Pivots, pivots in a prefix, and the part of a block's vectors that are ranked anew.
PIVOTS, PREFIX, PART = 256, 64, 0.2
#: The grid: blocks of vectors (as many at least, so that tasks share the work) by chunks of queries.
LEAST_BLOCKS, BLOCK_ROWS, CHUNK_ROWS = 12, 65_536, 16_384


def prefixes(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first. ``lift`` is the added coordinate that makes all vectors equally long."""
    near = x @ pivots.T + np.outer(lift, pivot_lift)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Block:
    """Vectors of a block and their inverted file: ``lists[p, v]`` is the weight of pivot p for vector v, or 0."""

    def __init__(self, x: np.ndarray, norm: float, pivots: np.ndarray, prefix: int = PREFIX) -> None:
        self.x, self.norm, self.pivots = x, norm, pivots
        self.prefix = min(prefix, len(pivots), 255)
        self.pivot_lift = self._lift(pivots)
        near = prefixes(x, self._lift(x), pivots, self.pivot_lift, self.prefix)
        self.weights = np.arange(self.prefix, 0, -1, dtype=np.uint8)
        lists = np.zeros((len(x), len(pivots)), np.uint8)
        np.put_along_axis(lists, near, np.broadcast_to(self.weights, near.shape), axis=1)
        self.lists = np.ascontiguousarray(lists.T)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0))

    def search(self, queries: np.ndarray, k: int, part: float = PART) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query up to ``k`` places in the block and their inner products, largest first."""
        near = prefixes(queries, np.zeros(len(queries)), self.pivots, self.pivot_lift, self.prefix)
        n = len(self.x)
        most = min(n, max(k, int(np.ceil(part * n))))
        out = []
        for q, mine in zip(queries, near, strict=True):
            if most < n:
                shared = np.zeros(n, np.uint16)
                for p, w in zip(mine, self.weights, strict=True):
                    shared += np.minimum(self.lists[p], w)
                # All that are as near as the last one to be ranked: no cut through equal distances.
                chosen = np.flatnonzero(shared >= np.partition(shared, n - most)[n - most])
            else:
                chosen = np.arange(n)
            score = (self.x[chosen] * q).sum(axis=1)  # the same for equal vectors, wherever they stand
            # All scores that reach the k-th, then by score and place, which is that of the id.
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
            best = np.flatnonzero(score >= least)
            best = best[np.lexsort((chosen[best], -score[best]))][:k]
            out.append((chosen[best], score[best]))
        return out


def distinct_vectors(df: DataFrame, vector: str, key: str, keep: int) -> DataFrame:
    """vid (smallest id), vector (doubles) and the ``keep`` smallest ids of each distinct usable vector.

    Null, empty and zero vectors, those with null or non-finite components, those whose length is not the
    table's most common one (the greater of equals), and null ids take no part.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("vector")).where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (sizes["n"] if sizes else 0))
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= keep)
    return rows.groupBy("vector").agg(F.min("vec_id").alias("vid"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def nearest(df: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id", pivots: int = PIVOTS, prefix: int = PREFIX, part: float = PART) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each id divisible by ``every``.

    Equal vectors are searched once, as query and as candidate, and keep their k + 1 smallest ids; so a
    vector that very many rows share costs as much as another. Rows are hashed to blocks, queries to
    chunks, and each pair of these is a task of bounded memory. A repeated row is one
    row; ties in footrule distance are all ranked anew, ties in score among what is ranked go to the smaller id. An id with several vectors is as many candidates and queries, and may stand there more than once. Unusable vectors (see ``distinct_vectors``) give no rows, nor does an
    empty table; fewer candidates than k give them all. Other columns of ``df`` are left out.
    """
    shared_folder(df.sparkSession)
    base = distinct_vectors(df, vector, key, k + 1).checkpoint()
    counted = base.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c)).alias("norm")).first()
    norm = float(np.sqrt(counted["norm"] or 0.0)) * (1 + 1e-12)
    chosen = base.orderBy(F.xxhash64("vid"), "vid").limit(pivots).select("vector").collect()  # of fixed number
    x = df.sparkSession.sparkContext.broadcast(np.array([r["vector"] for r in chosen], float))
    asked = df.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).where((F.col(key) % every == 0) & F.col(vector).isNotNull())
    asked = asked.join(base.select("vector", "vid"), "vector").select("query_id", "vid").distinct().checkpoint()
    queries = asked.select("vid").distinct().join(base, "vid").select(F.col("vid").alias("asked"), F.col("vector").alias("wanted"))
    blocks = max(LEAST_BLOCKS, -(-counted["n"] // BLOCK_ROWS))
    lots = max(1, -(-asked.count() // CHUNK_ROWS))

    def grid(rows: DataFrame, by: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        return rows.withColumn(mine, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = grid(queries, "asked", "lot", lots, "block", blocks).groupBy("block", "lot")
    right = grid(base.select("vid", "vector"), "vid", "block", blocks, "lot", lots).groupBy("block", "lot")

    def run(asked_: pa.Table, held: pa.Table) -> pa.Table:
        kinds = {"vid": pa.int64(), "found": pa.int64(), "score": pa.float64()}
        if not asked_.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        matrix = lambda t, name: np.asarray(t.column(name).combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids = np.asarray(held.column("vid"))
        order = np.argsort(ids)
        block = Block(np.ascontiguousarray(matrix(held, "vector")[order]), norm, x.value, prefix)
        results = block.search(matrix(asked_, "wanted"), k + 1, part)
        vid = np.repeat(np.asarray(asked_.column("asked")), [len(r[0]) for r in results])
        found = ids[order][np.concatenate([r[0] for r in results])]
        return pa.table({"vid": pa.array(vid), "found": pa.array(found), "score": pa.array(np.concatenate([r[1] for r in results]))})

    hits = left.cogroup(right).applyInArrow(run, "vid long, found long, score double")
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("score"), "found"))).where(F.col("place") <= k + 1)
    listed = best.join(base.select(F.col("vid").alias("found"), "ids"), "found").select("vid", "score", F.explode("ids").alias("vec_id"))
    listed = listed.groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, 2 * (k + 1)).alias("near"))
    rows = asked.join(listed, "vid").select("query_id", F.posexplode(F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)).alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vec_id of ``embeddings`` that is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
