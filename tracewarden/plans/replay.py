"""A recorded run from its lines to its stream: attribution, taint, findings, decisions and numbered lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import closure
from ..functions import text as t
from ..operators import findings as fi
from ..operators import process, tools
from ..operators.ordered import numbered, running_max, shared_folder
from ..operators.sessions import tainted, valid_spans
from ..policy import LAYERS, Policy, row_rules, rules

#: Where sessions that nothing closes are inspected: after every line.
END = 1 << 62
INBOUND, OUTBOUND = LAYERS[:3], LAYERS[3:]
#: What a run's texts and arguments say where their session's nonce is meant.
NONCE = "{{nonce}}"


_LISTS = ("canaries", "allowed_hosts", "forbidden_effects")


def policy_at(points: DataFrame, lines: DataFrame, default: Policy) -> DataFrame:
    """(ord, policy) of each place ``ord`` of ``points``: the default, changed by the policy lines before it.

    A line changes what it names, so each field is that of the latest line that names it: a running value over places and
    lines in one order, which is laid out in ranges however many lines there are.
    """
    fields = ("block_threshold", "strict_data", *_LISTS)
    given = lines.where("t = 'policy'").select("ord", *fields)
    rows = points.select("ord").distinct().withColumn("_at", F.lit(True)).unionByName(given, allowMissingColumns=True)
    rows = running_max(rows, [F.col("ord")], {f"_{c}": F.when(F.col(c).isNotNull(), F.struct("ord", c)) for c in fields}).where("_at")
    initial = dict(zip(("block_threshold", "strict_data", *_LISTS), (x for x in (rules(default).threshold, rules(default).strict, *rules(default)[2:])), strict=True))
    return rows.select("ord", F.struct(*(F.coalesce(F.col(f"_{c}.{c}"), initial[c]).alias(c) for c in fields)).alias("policy"))


def nonces(lines: DataFrame, seed: str) -> DataFrame:
    """A nonce for each session, from the seed, so that a replay can be repeated."""
    known = lines.where("session IS NOT NULL").select("session").distinct()
    return known.select("session", t.digest(F.concat(F.lit(seed), "session")).alias("nonce"))


_CALL = ("name", "known", "user_confirmed", "args", "permitted", "required", "allow", "effects", "guards")


def _calls(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Tool calls of lines of their own and inside replies, with the session's nonce in place of ``{{nonce}}`` in arguments.

    Calls of one reply keep their place in it (``call``)."""
    own = lines.where("t = 'tool_call'").select("session", "ord", F.lit(0).alias("call"), *_CALL)
    inner = lines.where("t = 'reply'").select("session", "ord", F.posexplode("tool_calls").alias("call", "c")).select("session", "ord", "call", *(F.col(f"c.{c}").alias(c) for c in _CALL))
    rows = own.unionByName(inner).join(names, "session")
    args = F.transform("args", lambda a: F.struct(a["k"].alias("k"), F.replace(a["v"], F.lit(NONCE), F.col("nonce")).alias("v")))
    return rows.withColumn("args", args).drop("nonce")


def replay(lines: DataFrame, seed: str = "", policy: Policy | None = None, needle: str = "", default: Policy | None = None, see=closure.look) -> dict[str, DataFrame]:
    """Tables of a run: spans, events, drops, findings (with ``inspection``: the place of the line that was inspected),
    decisions for each inspection, and sessions. ``ord`` is everywhere the place of a line in the whole run.

    ``lines`` are good lines as ``sources.lines.read_lines`` gives them, in order of (ord, file, lineno). A closing line
    inspects all spans of its session, sessions that are never closed are inspected at the end. Each inspection goes by the
    policy that holds at its place: ``default`` and what policy lines before it change; with ``policy`` all go by that one.
    Sessions without a root process begin at those whose name begins with ``needle``. Texts are looked at once, by ``see``.
    """
    shared_folder(lines.sparkSession)
    base = policy or default or Policy()
    placed = numbered(lines.where("error IS NULL"), [F.col(c) for c in ("ord", "file", "lineno")], "at")
    lines = placed.drop("ord").withColumnRenamed("at", "ord").checkpoint()
    names = nonces(lines, seed).checkpoint()
    told = lambda c: F.replace(c, F.lit(NONCE), F.col("nonce"))
    spans = valid_spans(lines.where("t = 'span'")).join(names, "session").withColumn("text", told("text")).select("session", "ord", "trust", "role", "channel", "ref", "text", "nonce")
    spans = numbered(spans, [F.col("session"), F.col("ord")], "_n")
    begun = spans.groupBy("session").agg(F.min("_n").alias("_b"))
    spans = spans.join(begun, "session").withColumn("span_index", (F.col("_n") - F.col("_b")).cast("int")).drop("_n", "_b").checkpoint()
    closed = lines.where("t = 'session_close'").groupBy("session").agg(F.max("ord").alias("closed"))
    opened = lines.where("t <> 'policy' AND session IS NOT NULL").groupBy("session").agg(F.min("ord").alias("opened"), F.coalesce(F.max("root_pid"), F.lit(0).cast("long")).alias("root"), F.max(F.when(F.col("t") == "session_open", F.col("harness"))).alias("harness"))
    opened = opened.join(closed, "session", "left").checkpoint()
    raw = lines.where("t = 'event'").select("session", "ord", "kind", "ts", "pid", "ppid", "comm", "cmdline", "filename", "flags", "dirfd", "port", "addr")
    owned = process.attributed(raw, opened.select("session", "opened", "closed", "root"), needle).checkpoint()
    drops = owned.where("owner IS NULL").drop("owner")
    events = tainted(owned.where("owner IS NOT NULL").drop("session").withColumnRenamed("owner", "session"), spans, inclusive=False)
    events = events.join(process.durations(events).select("ord", "duration"), "ord", "left")

    closing = names.select("session").join(closed, "session", "left").select("session", F.coalesce("closed", F.lit(END)).alias("inspection"))
    replies = lines.where("t = 'reply'").join(names, "session").select("session", "ord", told("text").alias("text"))
    calls = tainted(_calls(lines, names), spans, inclusive=False).checkpoint()
    leaving = lines.where("t IN ('reply', 'tool_call')").select("session", F.col("ord").alias("inspection"))
    inspections = leaving.unionByName(closing).distinct().checkpoint()
    if policy:
        one = rules(policy)
        held = inspections.select(F.col("inspection").alias("ord")).distinct().withColumn("policy", F.struct(one.threshold.alias("block_threshold"), one.strict.alias("strict_data"), *(c.alias(n) for c, n in zip(one[2:], _LISTS, strict=True))))
    else:
        held = policy_at(inspections.select(F.col("inspection").alias("ord")), lines, base)
    held = held.withColumnRenamed("ord", "inspection").checkpoint()
    by = row_rules()
    outgoing = replies.unionByName(calls.select("session", "ord", F.explode("args").alias("a")).select("session", "ord", F.col("a.v").alias("text")))
    at_place = lambda df: df.withColumn("inspection", F.col("ord")).join(held, "inspection")
    inbound = tuple(x for x in INBOUND if x in base.layers)
    said = spans.join(closing, "session").join(held, "inspection")
    inward = fi.inbound_findings(said, by, inbound, see).join(spans.select("session", "ord", "span_index"), ["session", "ord"]).join(closing, "session")
    outward = []
    if "toolauth" in base.layers:
        outward.append(tools.authorise(at_place(calls), by))
    if "egress" in base.layers:
        sent = at_place(outgoing).checkpoint()
        outward += [fi.canary_findings(sent, by), fi.url_egress(sent, by)]
    noted = [fi.disabled(which.withColumn("ord", F.col("inspection")), base, layers) for which, layers in ((closing, INBOUND), (leaving, OUTBOUND))]
    outer = fi.union([*outward, *noted]).withColumn("span_index", F.lit(-1)).withColumn("inspection", F.col("ord"))
    found = inward.unionByName(outer).join(held, "inspection")
    found = fi.escalated(found, by.strict).checkpoint()
    decided = fi.decide(found.withColumn("key", F.struct("session", "inspection")), by.threshold, "key")
    marks = spans.where("trust = 'data'").groupBy("session").agg(F.min("ord").alias("_first"))
    found = found.drop("policy").join(marks, "session", "left").withColumn("tainted", F.coalesce(F.col("_first") < F.col("inspection"), F.lit(False))).drop("_first").withColumn("provenance", F.lit("declared"))
    decisions = inspections.join(decided.select("key.session", "key.inspection", "decision", "invariant_n", "scored_n"), ["session", "inspection"], "left").select("session", "inspection", F.coalesce("decision", F.lit("allow")).alias("decision"), F.coalesce("invariant_n", F.lit(0)).alias("invariant_n"), F.coalesce("scored_n", F.lit(0)).alias("scored_n"))
    count = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    folded = opened.select("session", "opened", F.col("root").alias("root_pid"), F.coalesce("harness", F.lit("replay")).alias("harness")).join(closing, "session").join(marks.select("session", F.lit(True).alias("tainted")), "session", "left")
    for df, name in ((events, "events"), (found, "findings"), (decisions.where("decision = 'block'"), "blocks")):
        folded = folded.join(count(df, name), "session", "left")
    return {"spans": spans, "events": events, "drops": drops, "findings": found, "decisions": decisions, "sessions": folded.na.fill({"events": 0, "findings": 0, "blocks": 0, "tainted": False})}


def emitted(tables: dict[str, DataFrame], ring: int = 4096) -> DataFrame:
    """The stream of a replayed run: t, seq from 1 and session of each line, with the fields of its type (others are null).

    Lines stand in the order of the run: a session opens before its first line, an inspection's findings come by layer
    and span, then its decision and, at a close, the counts. Each event that no session owns is a warning with the number so far.
    """
    s, inf = tables["sessions"], F.lit(END)
    layer = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    at = lambda df, t_, place, sub: df.withColumn("t", F.lit(t_)).withColumn("_at", place).withColumn("_sub", F.lit(sub))
    scrubbed = [t.scrub(F.col(c)).alias(c) for c in ("comm", "cmdline", "filename", "addr")]
    spans, events = tables["spans"], tables["events"]
    lost = numbered(tables["drops"].select("ord"), [F.col("ord")], "drop_total")
    over = F.greatest(F.col("events") - ring, F.lit(0))
    parts = [
        at(s.select("session", "harness", "root_pid", "opened"), "session_open", F.col("opened"), 0).drop("opened"),
        at(spans.select("session", "ord", "trust", "channel", "ref", "role", F.octet_length("text").cast("long").alias("text_len")), "span", F.col("ord"), 1),
        at(events.select("session", "ord", "kind", "ts", "pid", "ppid", "flags", "dirfd", "port", "tainted", *scrubbed), "event", F.col("ord"), 1),
        at(lost.select("ord", F.lit("events-dropped").alias("code"), "drop_total"), "warning", F.col("ord"), 1),
        at(tables["findings"].withColumn("_layer", layer), "finding", F.col("inspection"), 2).drop("inspection"),
        at(tables["decisions"].select("session", "inspection", "decision"), "decision", F.col("inspection"), 3).drop("inspection"),
        at(s.select("session", "inspection", "events", "findings", over.alias("drop_total"), F.lit(0).cast("long").alias("upd_fail_total")), "session_close", F.col("inspection"), 4).drop("inspection"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.join(s.select("session", "opened"), "session", "left")
    late = F.when(F.col("_at") == inf, F.col("opened")).otherwise(0)
    order = [F.col("_at"), late, F.col("_sub"), *(F.coalesce(c, F.lit(0)) for c in ("_layer", "ord", "idx")), *(F.coalesce(c, F.lit("")) for c in ("rule", "evidence_digest"))]
    return numbered(rows, order).drop("_at", "_sub", "_layer", "opened", "ord", "idx")
