"""The stream of a run, and the tables that its lines fold into.

Lines are rows with t, seq and session and the fields of their type; every table is an aggregate over accepted lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import decide
from ..operators.ordered import numbered, shared_folder
from ..operators.sessions import tainted

#: Order of a session's lines: opened, then spans and events as they come, findings, decision, closed.
CLASSES = {"session_open": 0, "span": 1, "event": 2, "finding": 3, "decision": 4, "session_close": 5}


def lines(spans: DataFrame, events: DataFrame, findings: DataFrame, threshold: str = "high") -> DataFrame:
    """All lines of all sessions with their place (session, class, ord, idx, rule); fields that a type lacks are null.

    Findings are counted, decided on and listed, so they are made once and kept.
    """
    shared_folder(findings.sparkSession)
    findings = findings.checkpoint()
    of = lambda df, t: df.withColumn("t", F.lit(t)).withColumn("class", F.lit(CLASSES[t]))
    marked = tainted(events, spans)
    known = spans.select("session").unionByName(events.select("session")).unionByName(findings.select("session")).where("session IS NOT NULL").distinct()
    taint = spans.where("trust = 'data'").select("session").distinct().withColumn("tainted", F.lit(True))
    counts = known.join(events.groupBy("session").agg(F.count("*").alias("events")), "session", "left").join(findings.groupBy("session").agg(F.count("*").alias("findings")), "session", "left").na.fill(0)
    decided = known.join(decide(findings, threshold).select("session", "decision"), "session", "left").select("session", F.coalesce("decision", F.lit("allow")).alias("decision"))
    parts = [
        of(known, "session_open"),
        of(spans.select("session", "ord", "trust", F.when(F.col("trust") == "data", F.col("channel")).alias("channel"), F.octet_length("text").cast("long").alias("text_len")), "span"),
        of(marked.select("session", "ord", "kind", "ts", "pid", "ppid", "comm", "tainted"), "event"),
        of(findings.join(taint, "session", "left").withColumn("tainted", F.coalesce("tainted", F.lit(False))), "finding"),
        of(decided, "decision"),
        of(counts, "session_close"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("ord", F.coalesce("ord", F.lit(0).cast("long"))).withColumn("idx", F.coalesce("idx", F.lit(0)))


def emitted(rows: DataFrame) -> DataFrame:
    """Lines numbered from 1 in emission order."""
    order = [F.col(c) for c in ("session", "class", "ord", "idx")] + [F.coalesce("layer", F.lit("")), F.coalesce("rule", F.lit("")), F.coalesce("evidence_digest", F.lit("")), F.coalesce("pid", F.lit(0))]
    return numbered(rows, order).drop("class")


def as_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON text for each line, null fields left out."""
    return rows.select("seq", F.to_json(F.struct("t", "seq", "session", *fields)).alias("line"))


def write_lines(rows: DataFrame, folder: str, fields: list[str]) -> DataFrame:
    """Write numbered lines as text files that hold the stream when they are read in the order of their names.

    Lines are dealt by ranges of ``seq``, so that no task holds more than its range. Returns the manifest, a row for each file:
    file, lines, first_seq, last_seq. Control characters, quotes and backslashes are escaped, all else is written as it is. No rows
    give no lines; a folder that exists is an error.
    """
    laid = as_json(rows, fields).repartitionByRange("seq").sortWithinPartitions("seq")
    laid.select("line").write.text(folder)
    seq = F.get_json_object("value", "$.seq").cast("long")
    back = rows.sparkSession.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), seq.alias("seq"))
    return back.groupBy("file").agg(F.count("*").alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def session_fold(rows: DataFrame) -> DataFrame:
    """A row for each session from numbered lines."""
    is_ = lambda t: F.col("t") == t
    return rows.groupBy("session").agg(
        F.count_if(is_("span")).alias("spans"),
        F.count_if(is_("event")).alias("events"),
        F.count_if(is_("finding")).alias("findings"),
        F.count_if(is_("finding") & F.col("invariant")).alias("invariant"),
        F.coalesce(F.bool_or(is_("span") & (F.col("trust") == "data")), F.lit(False)).alias("tainted"),
        F.max_by("decision", F.when(is_("decision"), F.col("seq"))).alias("decision"),
        (F.max_by("t", F.when(F.col("t").isin("session_open", "session_close"), F.col("seq"))) == "session_open").alias("open"),
    )


def stats(rows: DataFrame) -> DataFrame:
    """The eight numbers at the head of a report."""
    folded = session_fold(rows)
    per = folded.agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.count_if("tainted"), F.lit(0)).alias("tainted_sessions"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("invariant"), F.lit(0)).alias("invariant"),
        F.coalesce(F.count_if(F.col("decision") == "block"), F.lit(0)).alias("blocks"),
    )
    more = rows.agg(F.count_if((F.col("t") == "event") & F.col("tainted")).alias("tainted_events"), F.countDistinct(F.when(F.col("t") == "event", F.col("pid"))).alias("processes"))
    return per.crossJoin(more)  # one row by one row


def blocked_by(rows: DataFrame) -> DataFrame:
    """Invariant findings that a later block decision of their session rests on."""
    last = rows.where("t = 'decision' AND decision = 'block'").groupBy("session").agg(F.max("seq").alias("_last"))
    found = rows.where("t = 'finding' AND invariant").join(last, "session")
    return found.where("seq < _last").select("session", "seq", "layer", "rule")


def provenance_split(findings: DataFrame) -> DataFrame:
    """Findings by provenance (``declared`` or ``inferred``), layer and severity; never added up over provenance."""
    return findings.groupBy("provenance", "layer", "severity").agg(F.count("*").alias("n"))


def drops(closed: DataFrame, unowned: int | None = None) -> DataFrame:
    """The worst drop counters of all sessions, and whether anything was lost."""
    worst = closed.agg(F.coalesce(F.max("drop_total"), F.lit(0)).alias("d"), F.coalesce(F.max("upd_fail_total"), F.lit(0)).alias("u"))
    total = F.greatest("d", F.lit(unowned or 0))
    return worst.select(total.cast("long").alias("drop_total"), F.col("u").cast("long").alias("upd_fail_total"), ((total > 0) | (F.col("u") > 0)).alias("lossy"))


def protocol(rows: DataFrame) -> DataFrame:
    """Errors, duplicates and the highest accepted number of a stream with ``duplicate`` and ``error``."""
    return rows.agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("duplicate").alias("duplicates"), F.coalesce(F.max(F.when(~F.col("duplicate"), F.col("seq"))), F.lit(0)).alias("last_seq"))


def last_errors(rows: DataFrame, order: str = "seq", most: int = 5) -> DataFrame:
    """The latest errors of a stream: ``order`` and error."""
    return rows.where("error IS NOT NULL").select(order, "error").orderBy(F.desc(order)).limit(most)


def run_summary(rows: DataFrame) -> DataFrame:
    is_ = lambda t: F.col("t") == t
    return rows.agg(
        F.count_if(is_("event")).alias("events"),
        F.countDistinct(F.when(is_("span") & (F.col("trust") == "data"), F.col("session"))).alias("tainted_sessions"),
        F.count_if(is_("finding") & F.col("invariant")).alias("invariant"),
        F.count_if(is_("finding") & ~F.col("invariant")).alias("scored"),
        F.count_if(is_("decision") & (F.col("decision") == "block")).alias("blocks"),
    )
