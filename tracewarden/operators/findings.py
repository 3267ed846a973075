"""Inspection layers: spans, replies and tool calls in, findings out; and what findings decide.

A finding is (session, ord, idx, layer, rule, severity, invariant, evidence_digest). The inbound layers look at each text
once, in Arrow batches (``functions.closure.look``); everything after that is native.
"""

from __future__ import annotations

import codecs
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import closure
from ..functions import text as t
from ..policy import DECODE_DEPTH, SEVERITIES, TEXT_BYTES, Policy, Rules, rules

#: Markers of chat templates.
MARKERS = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</system>", "</s>")
#: Words that address the reader.
SECOND_PERSON = ("you must ", "you will ", "you should ", "you shall ", "you are to ", "you need to ", "you can ", "you may ", "you are now ", "your instructions", "your system prompt")
#: Words that command.
IMPERATIVES = ("ignore ", "disregard ", "forget ", "override ", "act as ", "behave as ", "answer ", "respond ", "reply ", "obey ", "comply ", "reveal ", "disclose ", "print ", "output ", "repeat ", "show ", "leak ", "dump ", "send ")
#: What commands are after.
TARGETS = ("system prompt", "initial prompt", "your instructions", "the secret", "api key", "credential", "configuration", "password", "token", "instructions", "previous", "prior")
#: Rules that a strict policy makes invariant.
STRICT_RULES = ("data-imperative", "chat-template-marker")
COLUMNS = ("session", "ord", "idx", "layer", "rule", "severity", "invariant", "evidence_digest")


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def finding(rows: DataFrame, layer: str, rule: str, severity: str, invariant: bool | Column, evidence: Column, idx: Column | int = 0) -> DataFrame:
    """One finding for each row."""
    invariant = F.lit(invariant) if isinstance(invariant, bool) else invariant
    idx = F.lit(idx) if isinstance(idx, int) else idx
    return rows.select("session", "ord", idx.cast("int").alias("idx"), F.lit(layer).alias("layer"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), invariant.alias("invariant"), t.digest(evidence).alias("evidence_digest"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def instruction_shaped(lowered: list[Column] | Column, own: Column) -> Column:
    """Whether a reading addresses or commands the reader; a text about its own author needs a reading that addresses.

    ``lowered`` is an array of lowered readings, or one of them; ``own`` the text itself, lowered.
    """
    person = lambda c: t.contains_any(c, SECOND_PERSON)
    command = lambda c: t.contains_any(c, IMPERATIVES) & t.contains_any(c, TARGETS)
    addressed, commanded = (person(lowered), command(lowered)) if isinstance(lowered, Column) else (F.exists(lowered[0], person), F.exists(lowered[0], command))
    return addressed | (commanded & ~t.contains_any(own, ("my ", "our ")))


def with_readings(spans: DataFrame, text: str = "text") -> DataFrame:
    """``spans`` with ``readings`` (bytes) of each text. What reads them more than once makes them more than once: layers look by ``closure.look``."""
    return spans.withColumn("readings", closure.closure_readings(F.coalesce(F.col(text), F.lit(""))))


def raw_findings(spans: DataFrame, policy: Policy) -> DataFrame:
    """Findings that show on texts as they stand, all native: the fast first pass over a corpus.

    ``spans``: session, ord, trust, text. Layers ingress (data only), normalize and egress. What rules share is made once
    for each text, and its findings are one array, so that a corpus is read and exploded once.
    """
    seen, low = t.strip_invisibles(F.col("text")), t.lower_ascii(F.col("text"))
    rows = spans.select("session", "ord", "text", (F.col("trust") == "data").alias("data"), (F.octet_length("text") > TEXT_BYTES).alias("large"), seen.alias("seen"), low.alias("low"), t.lower_ascii(t.strip_noise(F.col("text"))).alias("plain"), t.links(F.col("text")).alias("links"))
    item = lambda idx, layer, rule, severity, invariant, evidence: F.struct(idx.cast("int").alias("idx"), F.lit(layer).alias("layer"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(invariant).alias("invariant"), evidence.alias("e"))
    # A text shows a needle turned or reversed where it contains the needle turned or reversed.
    shown = lambda n: t.contains_any(F.col("plain"), tuple(x[::way] for x in (n, codecs.encode(n, "rot13")) for way in (1, -1)))
    zero, strict, low = F.lit(0), policy.strict_data, F.col("low")
    once = [
        (F.col("large"), item(zero, "normalize", "input-too-large", "high", False, F.lit("input exceeds normalize budget"))),
        (~F.col("large") & (F.col("seen") != F.col("text")), item(zero, "normalize", "unicode-transform", "medium", False, F.col("seen"))),
        (F.col("data") & instruction_shaped(low, low), item(zero, "ingress", "data-imperative", "medium", strict, F.col("text"))),
        *((F.col("data") & F.contains(low, F.lit(m.lower())), item(zero, "ingress", "chat-template-marker", "high", strict, F.lit(m))) for m in MARKERS),
        *((shown(closure.needle(c).decode()), item(zero, "egress", "canary-leak", "critical", True, F.lit(c))) for c in policy.canaries),
    ]
    found = F.filter(F.array(*(F.when(test, made) for test, made in once)), lambda f: f.isNotNull())
    hosts = F.filter(F.transform("links", lambda link, i: F.struct(i.alias("i"), t.link_host(link).alias("host"))), lambda x: (x["host"] != "") & ~t.host_allowed(x["host"], policy.allowed_hosts))
    out = F.transform(F.when(F.col("large"), F.array().cast("array<struct<i:int,host:string>>")).otherwise(hosts), lambda x: item(x["i"], "egress", "url-egress", "critical", True, x["host"]))
    rows = rows.select("session", "ord", F.explode(F.concat(found, out)).alias("f"))
    return rows.select("session", "ord", "f.idx", "f.layer", "f.rule", "f.severity", "f.invariant", t.digest(F.col("f.e")).alias("evidence_digest"))


def url_hosts(rows: DataFrame) -> DataFrame:
    """A row for each link of ``text``: its place (idx) and host."""
    return rows.select("*", F.posexplode(t.links(F.col("text"))).alias("idx", "link")).withColumn("host", t.link_host(F.col("link"))).drop("link").where("host <> ''")


def url_egress(rows: DataFrame, policy: Policy | Rules) -> DataFrame:
    """Links to hosts that the policy doesn't list, in texts within the budget; a larger one is a finding of its own."""
    hosts = url_hosts(rows.where(F.octet_length("text") <= TEXT_BYTES)).where(~t.host_allowed(F.col("host"), policy.allowed_hosts))
    return finding(hosts, "egress", "url-egress", "critical", True, F.col("host"), F.col("idx"))


_WORDS = tuple(tuple(x.encode() for x in words) for words in (MARKERS, SECOND_PERSON, IMPERATIVES, TARGETS, ("my ", "our ")))


def inbound_findings(spans: DataFrame, policy: Policy | Rules, layers: tuple[str, ...] = ("normalize", "ingress", "provenance"), see=closure.look) -> DataFrame:
    """Findings of the inbound layers, from one look at each text: one Arrow pass, one explode.

    ``spans``: session, ord, trust, text and, for provenance, nonce. A marker is found once in each reading. A layer that
    raises on a text gives a critical finding that blocks that text's session, and no other.
    """
    seen = closure.looked(layers, _WORDS, see)(F.coalesce("text", F.lit("")), F.coalesce(F.col("trust") == "data", F.lit(False)), F.col("nonce") if "nonce" in spans.columns else F.lit(None).cast("string"))
    strict = rules(policy).strict
    rows = spans.withColumn("_s", seen)
    zero = F.lit(0)
    item = lambda layer, rule, severity, invariant, e, idx=zero: F.struct(idx.cast("int").alias("idx"), (F.lit(layer) if isinstance(layer, str) else layer).alias("layer"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), invariant.alias("invariant"), e.alias("evidence_digest"))
    yes, no = F.lit(True), F.lit(False)
    s = lambda name: F.col(f"_s.{name}")
    once = [
        (s("large") & F.lit("normalize" in layers), item("normalize", "input-too-large", "high", no, t.digest(F.lit("input exceeds normalize budget")))),
        (s("plain").isNotNull(), item("normalize", "unicode-transform", "medium", no, s("plain"))),
        (s("depth").between(1, DECODE_DEPTH - 1), item("normalize", "transport-encoded", "medium", no, s("coded"))),
        (s("depth") >= DECODE_DEPTH, item("normalize", "decode-budget", "high", no, s("coded"))),
        (s("embedded").isNotNull(), item("normalize", "embedded-encoded", "medium", no, s("embedded"))),
        (s("shaped"), item("ingress", "data-imperative", "medium", strict, t.digest(F.col("text")))),
        (s("forged"), item("provenance", "nonce-forgery", "critical", yes, t.digest(F.col("nonce")) if "nonce" in spans.columns else F.lit(""))),
    ]
    found = F.filter(F.array(*(F.when(test, made) for test, made in once)), lambda f: f.isNotNull())
    marked = F.transform(s("markers"), lambda m, i: item("ingress", "chat-template-marker", "high", strict, t.digest(m), i))
    failed = F.transform(s("errors"), lambda x: item(x, "layer-error", "critical", yes, t.digest(F.lit("layer returned non-zero"))))
    none = F.array().cast("array<struct<idx:int,layer:string,rule:string,severity:string,invariant:boolean,evidence_digest:string>>")
    rows = rows.select("session", "ord", F.explode(F.concat(found, F.coalesce(marked, none), F.coalesce(failed, none))).alias("f"))
    return rows.select("session", "ord", "f.*")


def normalize_findings(spans: DataFrame) -> DataFrame:
    """Disguises of a text, whatever it says: too large, invisible or look-alike characters, codings."""
    return inbound_findings(spans, Policy(), ("normalize",))


def ingress_findings(spans: DataFrame, policy: Policy | Rules) -> DataFrame:
    """Instructions and chat markers in any reading of data."""
    return inbound_findings(spans, policy, ("ingress",))


def nonce_findings(spans: DataFrame) -> DataFrame:
    """Data that shows the session's own ``nonce`` in some reading; silent without one."""
    return inbound_findings(spans, Policy(), ("provenance",))


def canary_findings(rows: DataFrame, policy: Policy | Rules) -> DataFrame:
    """Canaries in any reading of outgoing texts, in one pass; too large a text is a finding of its own, and so is a failing search."""
    large = F.octet_length("text") > TEXT_BYTES
    rows = closure.with_canaries(rows.withColumn("_t", F.when(large, "").otherwise(F.col("text"))).withColumn("_large", large), policy.canaries, "_t")
    kind = "array<struct<rule:string,idx:int,e:string>>"
    item = lambda rule, e, idx=F.lit(0): F.struct(F.lit(rule).alias("rule"), idx.cast("int").alias("idx"), e.alias("e"))  # noqa: E731, B008
    told = F.when(F.col("_large"), F.array(item("output-too-large", F.lit("output exceeds egress budget")))).when(F.col("hits").isNull(), F.array(item("layer-error", F.lit("layer returned non-zero")))).otherwise(F.transform("hits", lambda c, i: item("canary-leak", c, i)).cast(kind))
    found = rows.select("session", "ord", F.explode(told).alias("f"))
    return found.select("session", "ord", "f.idx", F.lit("egress").alias("layer"), "f.rule", F.lit("critical").alias("severity"), F.lit(True).alias("invariant"), t.digest(F.col("f.e")).alias("evidence_digest"))


def disabled(inspections: DataFrame, policy: Policy, layers: tuple[str, ...]) -> DataFrame:
    """A note for each inspection and layer that the policy switches off."""
    off = F.array(*(F.lit(x) for x in layers if x not in policy.layers)).cast("array<string>")
    rows = inspections.withColumn("_layer", F.explode(off))
    return rows.select("session", "ord", F.lit(0).alias("idx"), F.col("_layer").alias("layer"), F.lit("layer-disabled").alias("rule"), F.lit("info").alias("severity"), F.lit(False).alias("invariant"), t.digest(F.lit("layer disabled by policy")).alias("evidence_digest"))


def inferred(findings: DataFrame) -> DataFrame:
    """Findings of a side that sees no sessions, only requests: all their provenance is inferred."""
    return findings.withColumn("provenance", F.lit("inferred"))


def verdict(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """session and payload: decision and findings in order as one JSON text for each session with a finding."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "idx", "layer", "rule", "severity", "invariant", "evidence_digest")))
    rows = findings.groupBy("session").agg(listed.alias("f")).join(decide(findings, threshold).select("session", "decision"), "session")
    shown = F.transform("f", lambda x: F.struct(*(x[c].alias(c) for c in ("layer", "rule", "severity", "invariant", "evidence_digest"))))
    return rows.select("session", F.to_json(F.struct("decision", shown.alias("findings"))).alias("payload"))


def escalated(findings: DataFrame, strict: bool | Column) -> DataFrame:
    """Under a strict policy what commands from inside data is invariant."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    return findings.withColumn("invariant", F.col("invariant") | (F.col("rule").isin(*STRICT_RULES) & strict))


def decide(findings: DataFrame, threshold: str | Column = "high", by: str = "session") -> DataFrame:
    """``by``, decision and the counts behind it: an invariant finding blocks, and so does a severity from the threshold on."""
    counts = F.col("severity") != "info"
    reached = rank(F.col("severity")) >= (SEVERITIES.index(threshold) if isinstance(threshold, str) else rank(threshold))
    block = F.bool_or(F.col("invariant") | (counts & reached))
    folded = findings.groupBy(by).agg(F.count_if("invariant").alias("invariant_n"), F.count_if(~F.col("invariant")).alias("scored_n"), block.alias("_block"))
    return folded.select(by, F.when(F.col("_block"), "block").otherwise("allow").alias("decision"), "invariant_n", "scored_n")


def deciding(findings: DataFrame, by: str = "session") -> DataFrame:
    """The finding that a refusal names: invariant before scored, then the most severe, then the earliest."""
    order = F.struct("invariant", rank(F.col("severity")).alias("r"), (-F.col("ord")).alias("o"), (-F.col("idx")).alias("i"), "layer", "rule")
    best = F.max_by(F.struct("layer", "rule", "severity", "evidence_digest"), order)
    return findings.groupBy(by).agg(best.alias("f")).select(by, "f.layer", "f.rule", "f.severity", "f.evidence_digest")


def refusals(findings: DataFrame, threshold: str = "high") -> DataFrame:
    """session and reason of each blocked session: rule and digest, never the text."""
    blocked = decide(findings, threshold).where("decision = 'block'").select("session")
    reason = F.concat("layer", F.lit("/"), "rule", F.lit(" ["), "evidence_digest", F.lit("]"))
    return deciding(findings).join(blocked, "session", "left_semi").select("session", reason.alias("reason"))
