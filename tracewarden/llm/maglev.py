"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. Shards take turns,
each claiming the first slot of its order that is still free, until the table is full. A key is hashed
to a slot and the broadcast table names its shard; when a shard leaves, few other keys move.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 65_537
SHARDS = 64


def preferences(name: str, slots: int) -> np.ndarray:
    """A shard's order of all slots: from a place of its own in steps of its own."""
    digest = hashlib.sha256(name.encode()).digest()
    begin = int.from_bytes(digest[:8], "big") % slots
    step = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    return (begin + step * np.arange(slots, dtype=np.int64)) % slots


def lookup_table(shards: dict[str, float], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard (in the order of names) of each slot. ``slots`` must be prime and over the number of shards.

    In each round a shard gains its weight over the largest weight, and claims a slot for each whole one gained.
    Shards of weight 0 claim nothing; equal shares differ by one slot at most.
    """
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    names = sorted(shards)
    weights = np.array([shards[n] for n in names], float)
    if not len(names) or len(names) >= slots or (weights < 0).any() or not weights.max() > 0:
        raise ValueError("there must be shards with a weight, and fewer than slots")
    orders = [preferences(n, slots).tolist() for n in names]
    out, places, gained, left = [-1] * slots, [0] * len(names), np.zeros(len(names)), slots
    turn = weights / weights.max()
    while left:
        gained += turn
        for k in np.flatnonzero(gained >= 1 - 1e-9).tolist():
            gained[k] -= 1
            order, at = orders[k], places[k]
            while out[order[at]] >= 0:
                at += 1
            out[order[at]] = k
            places[k] = at + 1
            left -= 1
            if not left:
                break
    return np.array(out, np.int32)


def slot_of(keys: list[Column], slots: int) -> Column:
    """The slot of a row. Null keys hash as Spark hashes them: to one slot if all are null."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: list[str], shards: dict[str, float], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (its name). Rows stay one for one; equal keys, repeated rows
    and null keys have equal shards; columns of these names are replaced. The table that is broadcast has
    ``slots`` rows whatever the data."""
    names = sorted(shards)
    rows = [(i, names[k]) for i, k in enumerate(lookup_table(shards, slots).tolist())]
    held = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    given = df.drop(*(c for c in ("slot", "shard") if c not in keys)).withColumn("slot", slot_of([F.col(k) for k in keys], slots))
    return given.join(F.broadcast(held), "slot")


def op9_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every one of ``documents`` by its id, and the bytes that it brings there."""
    names = {f"shard-{k:03}": 1.0 for k in range(SHARDS)}
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"))
    return place(documents, ["doc_id"], names).select("doc_id", "slot", "shard", F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"))
