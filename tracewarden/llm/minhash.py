"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters a document's shingles
over a circle, the second is read from there on, one step further for each coordinate. So a
coordinate is the minimum over a shingle's neighbours on the circle, and all coordinates are the
minimum of a few contiguous slices.

Buckets are never expanded into pairs. Texts that may be linked are dealt to groups of bounded size in
which a few are held in one inverted list of shingles and the others stream past it, so that one look-up of a
text's shingles gives its exact intersections with all that are held.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, released, table, utf8
from .components import components, joined, shared_folder

SHINGLE, BANDS, ROWS = 5, 40, 5
COORDINATES = BANDS * ROWS
CIRCLE = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1) for k in range(SHINGLE)]
_windows: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles of a UTF-8 text; empty without words.

    A-Z is lower-cased, words stand between ASCII white space, and fewer words than a shingle
    has make one shingle of their own kind.
    """
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        out = np.array([n], np.uint64)
        for x in h:
            out = mix(out * _STEP[1] + x)
        return out
    out = h[: n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out += h[k : n - SHINGLE + 1 + k] * _STEP[k]
    return np.unique(mix(out))


def _circle() -> np.ndarray:
    """Row p: the second permutation read from place p on, one value for each coordinate."""
    if not _windows:
        order = np.random.default_rng(20240613).permutation(CIRCLE).astype(np.uint32)
        _windows.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:COORDINATES]]), COORDINATES))
    return _windows[0]


def signature(s: np.ndarray) -> np.ndarray:
    """Coordinates (32-bit) of a set that isn't empty."""
    at = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    windows = _circle()
    out = windows[at[:512]].min(axis=0)
    for k in range(512, len(at), 512):
        np.minimum(out, windows[at[k : k + 512]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature; the band's number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        out = mix(out + rows[:, k] * _STEP[1])
    return out.view(np.int64)


#: Bounds of a group: texts and shingles held in it, and texts that stream past those.
HELD_TEXTS, HELD_SHINGLES, PASSING = 256, 1_000_000, 2048
#: Texts that stream past one leader in a group.
FOLLOWERS = 256


class Held:
    """Sets of a group with their components, as one inverted list of shingles."""

    def __init__(self) -> None:
        self.components: list[int] = []
        self.sets: list[np.ndarray] = []
        self.lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.up: dict[int, int] = {}

    def hold(self, component: int, s: np.ndarray) -> None:
        self.components.append(component)
        self.sets.append(s)

    def _root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            x = up
        return x

    def intersections(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``s`` with each held set."""
        if self.lists is None:
            sizes = np.array([len(x) for x in self.sets], np.int64)
            every = np.concatenate([np.zeros(0, np.uint64), *self.sets])
            order = np.argsort(every, kind="stable")
            self.lists = every[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
            self.sets = []
        hashes, owner, sizes = self.lists
        low = np.searchsorted(hashes, s, "left")
        n = np.searchsorted(hashes, s, "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(sizes))

    def links(self, component: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Held components that ``s`` is linked with, each with its own: 100 * intersection >= 75 * union. Those that have met in
        this group are left out."""
        both = self.intersections(s)
        sizes = self.lists[2]
        out = []
        for k in np.flatnonzero((both > 0) & (100 * both >= 75 * (sizes + len(s) - both))):
            a, b = self._root(component), self._root(self.components[k])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((self.components[k], component))
        return out


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, and for texts with words: set_key (128-bit hash of the set) and bands, of rows (doc_id, text, mark)."""

    def run(batches):
        for batch in chunks(batches, 1):
            n, keys, bands = [], [], []
            for t in utf8(batch.column(1)):
                s = shingles(t)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "set_key", "bands"])
        released(_windows)

    return df.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, n_shingles long, set_key binary, bands array<long>")


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) between components of rows (one, other, passing, component, text), by their full sets.

    A group is (one, other): its rows that don't pass are held, and the others are compared with all of them as
    they stream by. A group that a batch cuts goes on in the next one.
    """

    def run(batches):
        group, held = None, Held()
        for batch in chunks(batches, 4):
            found = []
            ones, others, passing, components_ = (batch.column(k).to_pylist() for k in range(4))
            for key, streams, component, text in zip(zip(ones, others, strict=True), passing, components_, utf8(batch.column(4)), strict=True):
                if key != group:
                    group, held = key, Held()
                if streams:
                    found += held.links(component, shingles(text))
                else:
                    held.hold(component, shingles(text))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select("one", "other", "passing", "component", "text")
    return rows.repartition("one", "other").sortWithinPartitions("one", "other", "passing").mapInArrow(run, "a long, b long")


def _spread(upto) -> F.Column:
    """0 to ``upto``, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long")))


def _led(pairs: DataFrame) -> DataFrame:
    """(one, other, passing, node) for pairs (a, b): a is held by groups of its own, among which its partners are dealt."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("salts"))
    held = many.select(F.col("a").alias("one"), _spread(F.col("salts") - 1).alias("other"), F.lit(False).alias("passing"), F.col("a").alias("node"))
    passing = pairs.join(many, "a").select(F.col("a").alias("one"), F.pmod(F.xxhash64("b"), "salts").alias("other"), F.lit(True).alias("passing"), F.col("b").alias("node"))
    return held.unionByName(passing)


def _tiled(placed: DataFrame) -> DataFrame:
    """(one, other, passing, node) for rows (bucket, node, component, n_shingles) of buckets with several components.

    The members outside a bucket's largest component are dealt to blocks that hold them; all members stream past
    the blocks, those outside past blocks up to their own. So every pair across components meets, and a bucket that has
    almost come together costs little.
    """
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    of = parts.groupBy("bucket").agg(F.sum("n").alias("members"), F.sum("held").alias("held"), F.max(F.struct("n", "held", "component")).alias("largest"), F.count("*").alias("several")).where("several > 1")
    blocks = F.greatest(F.ceil((F.col("members") - F.col("largest.n")) / HELD_TEXTS), F.ceil((F.col("held") - F.col("largest.held")) / HELD_SHINGLES))
    of = of.select("bucket", F.col("largest.component").alias("largest"), blocks.alias("blocks"), F.ceil(F.col("members") / PASSING).alias("salts"))
    open_ = placed.select("bucket", "node", "component").join(of, "bucket")
    open_ = open_.withColumn("own", F.when(F.col("component") != F.col("largest"), F.pmod(F.xxhash64("node", "bucket"), "blocks")))
    held = open_.where(F.col("own").isNotNull()).select(F.col("bucket").alias("one"), F.col("own").alias("block"), _spread(F.col("salts") - 1).alias("salt"), F.lit(False).alias("passing"), "node")
    passing = open_.select(F.col("bucket").alias("one"), _spread(F.coalesce("own", F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.lit(True).alias("passing"), "node")
    return held.unionByName(passing).select("one", (F.col("block") * F.lit(1 << 24) + F.col("salt")).alias("other"), "passing", "node")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df``.

    Texts with equal sets are one node. Nodes that share a band meet in buckets. Each bucket is led by the member
    that shares most places with others, in a group of copies most often the text that they come from. Each node is
    first verified against its weightiest leader, which joins most copies. Buckets that still hold several components are
    then searched for every pair across them.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. A
    repeated row is the same document; rows with one id and several texts are one document with the
    links of them all. A row without an id has no component and is kept. An empty table gives no
    rows. Other columns of ``df`` are left out.
    """
    shared_folder(df.sparkSession)
    documents = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = sketches(documents).checkpoint()
    known = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    first = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "bands")))
    nodes = first.select(F.monotonically_increasing_id().alias("node"), "set_key", "least.doc_id", "least.mark", "n_shingles", "bands").checkpoint()
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = banded.join(shared, "bucket").checkpoint()
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    needed = weights.join(nodes.select("node", "doc_id", "mark"), "node")
    texts_ = documents.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))  # repeated rows meet before the shuffle
    whole = texts_.join(needed, ["doc_id", "mark"]).select("node", "text").checkpoint()
    of_row = rows.select("doc_id", "n_shingles", "set_key").join(nodes.select("set_key", "node"), "set_key", "left").select("doc_id", "n_shingles", "node").checkpoint()
    ids = of_row.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    one_id = ids.join(several, "doc_id").select("a", F.col("node").alias("b"))

    leaders = members.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("leader"))
    pairs = members.join(leaders, "bucket").where("leader.node <> node").select("leader", F.col("node").alias("b"))
    best = pairs.groupBy("b").agg(F.max("leader").alias("leader")).select(F.col("leader.node").alias("a"), "b").checkpoint()
    found = _rooted(compared(_led(best).join(whole, "node").withColumn("component", F.col("node"))))
    placed = _component(members.select("bucket", "node", "n_shingles"), found, "node", "component").checkpoint()
    more = compared(_component(_tiled(placed).join(whole, "node"), found, "node", "component"))
    one_id = _component(_component(one_id, found, "a", "x"), found, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = joined(found, more.unionByName(one_id))

    named = _component(nodes.select("node", "doc_id"), found, "node", "component")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    out = of_row.join(named, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rooted(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) that give each b one a and form no ring: b takes the a of its a until it is a root."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct().checkpoint()
    while True:
        further = up.select(F.col("node").alias("component"), F.col("component").alias("root"))
        up = up.join(further, "component", "left").select("node", F.coalesce("root", "component").alias("component"), F.col("root").isNotNull().alias("moved")).checkpoint()
        if up.where("moved").isEmpty():
            return up.select("node", "component").unionByName(up.select(F.col("component").alias("node"), "component").distinct())
        up = up.select("node", "component")


def _component(rows: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of ``node`` as ``name``; a node that isn't in ``found`` is its own."""
    known = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
