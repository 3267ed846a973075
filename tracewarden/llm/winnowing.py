"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Of every ten consecutive words the smallest hash of their six 5-grams is a fingerprint. A passage of ten words or more that a
document shares with a benchmark item has therefore a fingerprint in common with it, wherever it stands. Fingerprints
of both sides are joined; where they meet, a hit is extended to the windows around it, which are compared as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .components import shared_folder

#: Words of a window and of a gram; a window holds SPAN - GRAM + 1 grams.
SPAN, GRAM = 10, 5
#: Bytes of the item side up to which it is broadcast; beyond them the same joins shuffle.
BROADCAST_BYTES = 64 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _made(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with a column that is made once a row. A plain projection would be merged into what reads it, and an
    array would then be made anew for each of its elements."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def lowered(text: Column) -> Column:
    """A text with A-Z lowered, and no other letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered: runs of digits, letters and all beyond ASCII. Null has none."""
    return F.coalesce(F.array_remove(F.split(lowered(text), _BETWEEN), ""), F.array().cast("array<string>"))


def _text(w: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(w, at, size), " ")


def _positions(df: DataFrame, text: str) -> DataFrame:
    """The columns of ``df`` but the text, with w (words), n, g and a row for each place ``at`` of a word, from 1, after one
    at 0 that stands for the whole text. ``g`` holds the hashes of the grams at their places."""
    rows = _made(df, "w", words(F.col(text))).drop(text)
    rows = _made(rows, "h", F.transform("w", lambda x: F.xxhash64(x)))
    rows = _made(rows, "g", F.concat(F.array(F.lit(0).cast("long")), F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, GRAM)))))).drop("h")
    return rows.withColumn("n", F.size("w")).select("*", F.posexplode("g").alias("at", "_x")).drop("_x")


def _print(at: Column) -> tuple[Column, Column]:
    """The smallest hash of the grams of the window at a place, and of the window before."""
    shared = [F.get("g", at + k) for k in range(SPAN - GRAM)]
    return F.least(*shared, F.get("g", at + (SPAN - GRAM))), F.least(*shared, F.get("g", at - 1))


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, window (its words with blanks between), size (words) and print of every window of the items, each once.

    An item of fewer words than a window is one window, and its print is the hash of all its words. Items without words have none.
    """
    at, n, w = F.col("at"), F.col("n"), F.col("w")
    rows = _positions(items.select(F.col(item).alias("item"), F.col(text).alias("_t")), "_t").where((at >= 1) & ((at == 1) | (at <= n - (SPAN - 1))))
    size = F.least(n, F.lit(SPAN))
    return rows.select("item", _text(w, at, size).alias("window"), size.alias("size"), F.when(n < SPAN, F.xxhash64("w")).otherwise(_print(at)[0]).alias("print")).distinct()


def _fingerprints(rows: DataFrame, shorter: list[int]) -> DataFrame:
    """``rows`` of ``_positions`` with size and print: those at 0, and those where a window's fingerprint is another than
    that of the window before. One that stays the same is named at every sixth place again, so that each name stands
    for six windows at most. For items of fewer words than a window, every gram of as many words is named."""
    at, n = F.col("at"), F.col("n")
    held = SPAN - GRAM + 1
    now, before = _print(at)
    rows = rows.select("*", F.inline(F.array(F.struct(now.alias("_now"), before.alias("_before")))))
    print_ = F.when((at >= 1) & (at <= n - (SPAN - 1)) & ((at == 1) | (F.col("_now") != F.col("_before")) | (at % held == 0)), F.col("_now"))
    made = [F.struct(F.when(at == 0, 0).otherwise(SPAN).alias("size"), F.when(at == 0, F.col("_id")).otherwise(print_).alias("print"))]
    made += [F.struct(F.lit(k).alias("size"), F.when((at >= 1) & (at <= n - (k - 1)), F.xxhash64(F.slice("w", at, k))).alias("print")) for k in shorter]
    if not shorter:
        return rows.select("*", made[0].alias("_p")).select("*", "_p.*").drop("_p").where("print IS NOT NULL")
    return rows.select("*", F.inline(F.array(*made))).where("print IS NOT NULL")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with n_words, n_hit (words inside an occurrence of a window of an
    item), items (distinct ids of such items as strings, sorted) and spans (begin and end of each hit stretch, in words from 0).

    Every row stays, repeated ones too; null and empty texts have no words and no hits. Items with one id are one item;
    items without an id hit, but are in no list. No items: no hits. Columns of ``docs`` that aren't kept may have any name.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    found = item_windows(items, item, text="text").checkpoint()
    # A window's items by a signature of their set: windows of one passage share it, and a document meets each set once.
    ids = F.coalesce(F.col("item").cast("string"), F.lit(""))
    sets = found.groupBy("window", "size", "print").agg(F.count("item").alias("_n"), F.bit_xor(F.xxhash64(ids)).alias("_x"), F.bit_xor(F.xxhash64(ids, F.lit(1))).alias("_y"))
    sets = sets.withColumn("set", F.struct("_n", "_x", "_y")).select("window", "size", "print", "set").checkpoint()
    # Every window of a set has the same items, so that the smallest one stands for it.
    shown = sets.groupBy("set").agg(F.min("window").alias("window"))
    members = shown.join(found.where("item IS NOT NULL"), "window").select("set", F.col("item").cast("string").alias("item")).distinct().checkpoint()
    size = sets.agg(F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0))).first()[0] + members.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()[0]
    small = F.broadcast if size <= broadcast_bytes else lambda df: df
    shorter = [r["size"] for r in sets.where(F.col("size") < SPAN).select("size").distinct().collect()]  # nine at most

    at, size = F.col("at"), F.col("size")
    rows = _positions(docs.select(F.struct(*keep).alias("_kept"), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_id")), "_t")
    rows = _fingerprints(rows, sorted(shorter))
    # What travels with a fingerprint: the words of the windows that it may stand for.
    most = F.when(size == SPAN, 2 * SPAN - GRAM).otherwise(size)
    piece = F.when(at > 0, F.slice("w", F.greatest(at, F.lit(1)), most))
    rows = rows.select("_id", "n", F.when(at == 0, F.col("_kept")).alias("_kept"), "at", "size", "print", piece.alias("piece"))
    known = sets.select("print").distinct().withColumn("_hit", F.lit(True))
    rows = _made(rows.join(small(known), "print", "left").where("at = 0 OR _hit").drop("_hit", "print"), "_p", F.col("piece")).drop("piece").withColumnRenamed("_p", "piece")
    last = F.size("piece") - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct((at + i - 2).cast("int").alias("begin"), _text(F.col("piece"), i, F.col("size")).alias("window")))
    rows = rows.select("_id", "_kept", "n", "size", F.explode_outer(F.when(at > 0, windows)).alias("v")).select("_id", "_kept", "n", "size", "v.*")
    # What matches nothing gets a key of its own, so that such rows don't meet in one task.
    alone = F.concat(F.lit("\n"), F.col("_id").cast("string"))
    rows = rows.withColumn("window", F.coalesce("window", alone)).join(small(sets.select("window", "set")), "window", "left").where("begin IS NULL OR set IS NOT NULL")
    span = F.when(F.col("set").isNotNull(), F.struct("begin", (F.col("begin") + F.col("size")).alias("end")))
    rows = rows.groupBy("_id").agg(F.any_value("_kept", True).alias("_kept"), F.max("n").alias("n"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("set").alias("sets"))
    rows = rows.withColumn("spans", merged(F.col("spans"))).withColumn("set", F.explode_outer("sets")).withColumn("set", F.coalesce("set", F.struct(F.lit(-1).cast("long").alias("_n"), F.col("_id").alias("_x"), F.lit(0).cast("long").alias("_y"))))
    rows = rows.join(small(members), "set", "left")
    rows = rows.groupBy("_id").agg(F.any_value("_kept").alias("_kept"), F.max("n").alias("n"), F.any_value("spans").alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return rows.select("_kept.*", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "items", "spans")


def merged(spans: Column) -> Column:
    """Sorted spans (begin, end) without overlaps: a stretch that others touch or cover is one with them."""
    kind = "struct<begin:int,end:int>"
    top = F.aggregate(
        spans,
        F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open")),
        lambda s, x: F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open")))
        .when(x["begin"] <= s["open"]["end"], F.struct(s["done"].alias("done"), F.struct(s["open"]["begin"].alias("begin"), F.greatest(s["open"]["end"], x["end"]).alias("end")).alias("open")))
        .otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), x.alias("open"))),
        lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])),
    )
    return top


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
