"""Merkle fixity audit of WARC replicas.

Records are hashed with the offset range that they take in their file; nodes hash up to sixteen
children in order, up to a single root. Two replicas are compared from the roots down, and only
children of nodes that differ are looked at, until the damaged records are found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .components import shared_folder

#: Ids of pages in a file, records in a part of a file, children of a node.
FILE_IDS, PART_RECORDS, FANOUT = 1024, 4096, 16


def record(url: Column, html: Column) -> Column:
    """A page as the text of a WARC resource record; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, key (of the url), length, sha256, copies and file of each distinct record of a replica.

    A file holds the records of ``FILE_IDS`` successive ids. Exact repeats are stored once and counted in
    ``copies``. Rows without an id go to a file whose number is null. Only hashes and lengths are shuffled.
    """
    key = F.xxhash64(F.coalesce("url", F.lit(""))).alias("key")
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), key, record(F.col("url"), F.col("html")).alias("r"))
    one = one.select("page_id", "key", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("sha256"))
    return one.groupBy("page_id", "key", "length", "sha256").agg(F.count("*").alias("copies")).withColumn("file", F.floor(F.col("page_id") / FILE_IDS))


def cuts(replicas: list[DataFrame]) -> DataFrame:
    """file and parts: into how many parts a file is cut, by the replica that holds most records of it."""
    counted = [r.groupBy("file").agg(F.count("*").alias("n")) for r in replicas]
    return reduce(DataFrame.unionByName, counted).groupBy("file").agg(F.ceil(F.max("n") / PART_RECORDS).alias("parts"))


def records(hashed_: DataFrame, cuts_: DataFrame) -> DataFrame:
    """file, part, idx, page_id, key, offset, length, copies and sha256 of each record of a replica.

    Records of a file are in order of (page_id, sha256), with offsets from 0. A file with very many records
    under its ids is cut into parts by hash, each with offsets of its own.
    """
    one = hashed_.join(cuts_, hashed_["file"].eqNullSafe(cuts_["file"])).drop(cuts_["file"]).withColumn("part", F.pmod(F.xxhash64("sha256"), F.col("parts")))
    inside = Window.partitionBy("file", "part").orderBy("page_id", "sha256")
    end = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return one.select("file", "part", (F.row_number().over(inside) - 1).cast("long").alias("idx"), "page_id", "key", (end - F.col("length")).alias("offset"), "length", "copies", "sha256")


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ";"), 256)


def _above(hashes: Column) -> Column:
    """Hashes of each sixteen neighbours of an array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FANOUT).cast("int")), lambda i: _joined(F.slice(hashes, i * FANOUT + 1, FANOUT)))


def parts(records_: DataFrame, low: int) -> DataFrame:
    """The tree of each part in one row: file (counted from ``low``, 0 without an id), part, leaves, their hashes l0, l1
    and l2 above them, and the root. A part has about ``PART_RECORDS`` leaves, so a row is bounded, and records that
    are already together by part are not shuffled again."""
    leaf = F.struct("idx", "page_id", "key", "offset", "length", "copies", "sha256")
    rows = records_.groupBy("file", "part").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    place = lambda x: F.sha2(F.concat_ws(":", *(x[c].cast("string") for c in ("page_id", "offset", "length", "copies", "sha256"))), 256)
    rows = rows.withColumn("file", F.coalesce(F.col("file") - low + 1, F.lit(0))).withColumn("l0", F.transform("leaves", place))
    return rows.withColumn("l1", _above(F.col("l0"))).withColumn("l2", _above(F.col("l1"))).withColumn("root", _joined(F.col("l2")))


def tops(parts_: DataFrame, span: int) -> list[DataFrame]:
    """Levels (node, hash) over the files, from the files to one root; ``span`` is how many file numbers there are."""
    spelt = lambda k, h: F.concat_ws(":", F.col(k).cast("string"), F.col(h))
    gathered = lambda c: _joined(F.array_sort(F.collect_list(c))).alias("hash")
    level = parts_.groupBy(F.col("file").alias("node")).agg(gathered(spelt("part", "root"))).checkpoint()
    levels = [level]
    while span > 1:
        level = level.groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(gathered(spelt("node", "hash"))).withColumnRenamed("up", "node").checkpoint()
        levels.append(level)
        span = -(-span // FANOUT)
    return levels


def _differing(x: DataFrame, y: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that only one side has."""
    both = x.join(y.withColumnRenamed("hash", "other"), "node", "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two sets of pages: file, part, idx, page_id, offset, length, status, and both sha256.

    The trees are compared by place, to find the leaves that can differ. Those are then matched over the whole file, whatever
    their parts: records of one page_id that are equal on both sides are intact, also where others moved them; what
    remains of a page_id and url is paired in order of its hashes, so that only damaged records show. ``status`` is ``changed``, ``missing`` (from the replica) or ``extra``; page_id, offset and length
    are the primary's where it has the record. Equal replicas, and two empty ones, give no rows. Columns
    other than page_id, url and html are left out.
    """
    shared_folder(primary.sparkSession)
    held = [hashed(x).checkpoint() for x in (primary, replica)]
    known = [records(x, cuts(held)) for x in held]
    ends = cuts(held).agg(F.min("file"), F.max("file")).first()
    low, high = (0, 0) if ends[0] is None else ends
    a, b = (parts(r, low).checkpoint() for r in known)
    one, other = tops(a, high - low + 2), tops(b, high - low + 2)
    found = _differing(one[-1], other[-1])
    for x, y in zip(one[-2::-1], other[-2::-1], strict=True):
        above = found.select(F.col("node").alias("up"))
        below = [t.withColumn("up", F.floor(F.col("node") / FANOUT)).join(above, "up", "left_semi").drop("up") for t in (x, y)]
        found = _differing(*below)
    found = found.select(F.col("node").alias("file"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(found, "file", "left_semi")
        return rows.select("file", "part", *(F.col(c).alias(f"{name}_{c}") for c in ("leaves", "l0", "l1", "l2", "root")))

    both = side(a, "a").join(side(b, "b"), ["file", "part"], "full").where(~F.col("a_root").eqNullSafe(F.col("b_root")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    differs = lambda level: lambda i: ~F.get(f"a_{level}", i).eqNullSafe(F.get(f"b_{level}", i))
    children = lambda c: F.flatten(F.transform(c, lambda i: F.sequence(i * FANOUT, i * FANOUT + (FANOUT - 1))))
    both = both.withColumn("d", F.filter(F.sequence(F.lit(0), F.greatest(count("a_l2"), count("b_l2"), F.lit(1)) - 1), differs("l2")))
    for level in ("l1", "l0"):
        both = both.withColumn("d", F.filter(children("d"), differs(level)))
    leaves = lambda side: F.transform("d", lambda i: F.struct(F.lit(side).alias("side"), F.get(f"{side}_leaves", i).alias("leaf")))
    rows = both.select("file", "part", F.explode(F.concat(leaves("a"), leaves("b"))).alias("x")).where("x.leaf IS NOT NULL")
    rows = rows.select("x.side", "x.leaf.page_id", "x.leaf.key", "x.leaf.sha256", F.struct("file", "part", "x.leaf.idx", "x.leaf.page_id", "x.leaf.offset", "x.leaf.length", "x.leaf.copies", "x.leaf.sha256").alias("leaf"))
    sides = [F.max(F.when(F.col("side") == c, F.col("leaf"))).alias(c) for c in ("a", "b")]
    odd = rows.groupBy("page_id", "key", "sha256").agg(*sides).where(~F.col("a.copies").eqNullSafe(F.col("b.copies")))
    alone = F.col("a").isNull() | F.col("b").isNull()
    turn = F.row_number().over(Window.partitionBy("page_id", "key", F.col("a").isNull(), F.col("b").isNull()).orderBy("sha256"))
    rows = odd.withColumn("alone", alone).withColumn("turn", turn).groupBy("page_id", "key", "alone", "turn").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    at = F.coalesce("a", "b")
    file = F.when(at["file"] > 0, at["file"] + (low - 1)).alias("file")
    return rows.select(file, *(at[c].alias(c) for c in ("part", "idx", "page_id", "offset", "length")), status.alias("status"), F.col("a.sha256").alias("primary_sha256"), F.col("b.sha256").alias("replica_sha256"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for trials: where the id has the remainder 13 by 97, the first letter of html differs."""
    hit = (F.pmod(F.col("page_id"), F.lit(97)) == 13) & (F.octet_length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def op3_merkle_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``pages`` that a replica with deterministic damage holds otherwise."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages)).select("file", "part", "idx", "page_id", "offset", "length", "status", "primary_sha256", "replica_sha256")
