"""Spans, trust and taint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trust_of(role: Column) -> Column:
    """System and developer are the system, user and assistant the user; everything else is data."""
    return F.when(role.isin("system", "developer"), "system").when(role.isin("user", "assistant"), "user").otherwise("data")


def valid_spans(spans: DataFrame) -> DataFrame:
    """Spans with a known trust; data needs an origin (channel), and only data keeps one."""
    data = F.col("trust") == "data"
    sound = F.col("trust").isin("system", "user") | (data & F.col("channel").isNotNull())
    return spans.where(sound).withColumn("channel", F.when(data, F.col("channel"))).withColumn("ref", F.when(data, F.col("ref")))


def tainted(rows: DataFrame, spans: DataFrame, inclusive: bool = True) -> DataFrame:
    """``rows`` (session, ord) with ``tainted``: a data span of the session stands there or before.

    Taint never decays, so its first place is enough: a small aggregate instead of a window over whole sessions.
    """
    first = spans.where(F.col("trust") == "data").groupBy("session").agg(F.min("ord").alias("_first"))
    since = F.col("ord") >= F.col("_first") if inclusive else F.col("ord") > F.col("_first")
    return rows.join(first, "session", "left").withColumn("tainted", F.coalesce(since, F.lit(False))).drop("_first")


def taint_origins(spans: DataFrame) -> DataFrame:
    """Sessions with data spans: their number, and the origins in order."""
    return taint_summary(spans.withColumn("shaped", F.lit(False))).where("data_spans > 0").select("session", "data_spans", "origins")


def taint_summary(spans: DataFrame) -> DataFrame:
    """Every session: its spans, its data spans, their origins in order, and whether one is ``shaped``.

    One aggregate, pre-aggregated before its shuffle. The list of origins is what is asked for; it holds no text.
    """
    data = F.col("trust") == "data"
    origin = F.when(data, F.struct("ord", "channel", "ref"))
    rows = spans.groupBy("session").agg(F.count("*").alias("spans"), F.count_if(data).alias("data_spans"), F.array_sort(F.collect_set(origin)).alias("o"), F.bool_or(data & F.col("shaped")).alias("shaped"))
    listed = F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["channel"], x["ref"])), ",")
    return rows.select("session", "spans", "data_spans", listed.alias("origins"), "shaped")


def fenced(spans: DataFrame, nonce: Column, capacity: int | None = None) -> DataFrame:
    """session, prompt and truncated: spans in order, data between fences that carry the session's nonce.

    With a capacity in bytes the prompt ends before the first span that doesn't fit.
    """
    origin = F.concat(F.coalesce("channel", F.lit("unknown")), F.lit(":"), F.coalesce("ref", F.lit("unknown")))
    body = F.when(F.col("trust") == "data", F.concat(F.lit("<<<UNTRUSTED-"), nonce, F.lit(" origin="), origin, F.lit(">>>\n"), F.col("text"), F.lit("\n<<<END-"), nonce, F.lit(">>>\n"))).otherwise(F.concat("text", F.lit("\n")))
    rows = spans.withColumn("_body", body)
    if capacity is None:
        rows = rows.withColumn("_fits", F.lit(True))
    else:
        from pyspark.sql import Window

        so_far = F.sum(F.octet_length("_body")).over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_fits", so_far < capacity)
    parts = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("ord", "_body"))))
    return rows.groupBy("session").agg(F.array_join(F.transform(parts, lambda x: x["_body"]), "").alias("prompt"), F.bool_or(~F.col("_fits")).alias("truncated"))
