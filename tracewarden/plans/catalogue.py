"""Every operator as a query over plain tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import closure
from ..functions import text as t
from ..operators import findings as fi
from ..operators import ordered, process, sessions, tools
from ..policy import RING, VIEW_EVENTS, VIEW_FINDINGS, Policy
from ..sources import lines
from . import inputs, replay, stream

UP, LOW = t.UPPER, t.LOWER
NONCE = "00112233aabbccdd"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n.lower())})" for n in needles) + ")"


def _low(column: str) -> str:
    return f"translate({column}, '{UP}', '{LOW}')"


def _chars(codes) -> str:
    return "".join(chr(c) if c > 32 else " " if c == 32 else "" for c in codes)


_SEPARATORS = "regexp_replace({c}, '[ \\t\\n\\r\\-._|,:;*~''\"`]', '', 'g')"
_NOISE = "regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')"
_INVISIBLE = "regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}\\x{{2066}}-\\x{{2069}}\\x{{E0000}}-\\x{{E007F}}]', '', 'g')"
_ROT = f"'{UP + LOW}', '{UP[13:] + UP[:13] + LOW[13:] + LOW[:13]}'"

SPANS = """v_spans AS (
  SELECT 'c' || conv_id AS session, CAST(turn AS BIGINT) * 2000000 AS ord, role,
    CASE WHEN role IN ('system', 'developer') THEN 'system' WHEN role IN ('user', 'assistant') THEN 'user' ELSE 'data' END AS trust,
    '' AS channel, '' AS ref, text FROM conversations
  UNION ALL
  SELECT 'c' || (doc_id % 211), (doc_id % 8) * 2000000 + 1000000 + doc_id, 'tool', 'data', source, CAST(doc_id AS VARCHAR), text FROM documents)"""
ATTACKS = f"""v_attacks AS (
  SELECT 'a' || (doc_id % 97) AS session, doc_id AS ord, 'data' AS trust, source,
    text || CASE doc_id % 12 {" ".join(f"WHEN {k} THEN {_q(v)}" for k, v in inputs.ATTACKS.items())} ELSE '' END AS text
  FROM documents WHERE text IS NOT NULL)"""
KEV = """v_kev AS (
  SELECT event_id AS ord, CASE WHEN event_id % 3 <> 0 THEN 's' || (user_id % 4) END AS session,
    CASE WHEN event_type IN ('click', 'signup') THEN 'exec' WHEN event_type = 'error' THEN 'exit' WHEN event_type = 'view' THEN 'open' ELSE 'net' END AS kind,
    event_id * 7 AS ts, CAST(user_id + 1 AS BIGINT) AS pid, CAST(floor(user_id / 4) AS BIGINT) AS ppid,
    'p' || (user_id % 9) AS comm, CAST(event_id % 1024 AS BIGINT) AS flags FROM events)"""
CALLS = """v_calls AS (
  SELECT event_id AS call_id, 'c' || user_id AS session, event_id AS ord,
    ['send_email', 'Read', 'WebFetch', 'post_note', 'buy', 'ghost'][event_id % 6 + 1] AS name,
    event_id % 6 <> 5 AS known, event_id % 2 = 0 AS user_confirmed, event_id % 3 = 0 AS tainted, user_id, event_type FROM events),
args AS (
  SELECT call_id, 0 AS pos, 'to' AS k, 'u' || user_id AS v FROM v_calls WHERE call_id % 4 <> 0
  UNION ALL SELECT call_id, 1, 'body', event_type FROM v_calls WHERE call_id % 5 <> 0
  UNION ALL SELECT call_id, 2, 'extra', 'x' FROM v_calls WHERE call_id % 7 = 0)"""
_HOST = "regexp_replace(regexp_extract(link, '^(?:https:|http:)?//([^/?# )\\]>\"'']*)', 1), '^[^@]*@', '')"
HOSTS = f"""links AS (
  SELECT session, ord, small, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS idx
  FROM (SELECT session, ord, strlen(text) <= 65536 AS small, regexp_extract_all(text, '(?:https:|http:)?//[^\\s)\\]>\"''`]*') AS l FROM v_attacks)),
hosts AS (
  SELECT session, ord, small, CAST(idx AS INTEGER) AS idx, {_low("CASE WHEN h LIKE '[%' THEN h ELSE split_part(h, ':', 1) END")} AS host
  FROM (SELECT session, ord, small, idx, {_HOST} AS h FROM links)),
outside AS (
  SELECT * FROM hosts WHERE host <> '' AND small AND NOT (host = 'api.example' OR host = 'corp.example' OR host LIKE '%.corp.example'))"""
_CANARY = closure.needle(inputs.CANARY).decode()
_PLAIN = f"{_low(_NOISE.format(c='text'))}"
_IMPERATIVE = f"(({_any('l', fi.SECOND_PERSON)}) OR ({_any('l', fi.IMPERATIVES)} AND {_any('l', fi.TARGETS)} AND NOT {_any('l', ('my ', 'our '))}))"
FINDINGS = f"""{ATTACKS}, {HOSTS},
low AS (SELECT *, {_low('text')} AS l, {_PLAIN} AS p, {_INVISIBLE.format(c='text')} AS seen FROM v_attacks),
raw AS (
  SELECT session, ord, 0 AS idx, 'normalize' AS layer, 'input-too-large' AS rule, 'high' AS severity, false AS invariant, 'input exceeds normalize budget' AS e FROM low WHERE strlen(text) > 65536
  UNION ALL SELECT session, ord, 0, 'normalize', 'unicode-transform', 'medium', false, seen FROM low WHERE strlen(text) <= 65536 AND seen <> text
  UNION ALL SELECT session, ord, 0, 'ingress', 'chat-template-marker', 'high', true, m FROM low, unnest([{", ".join(map(_q, fi.MARKERS))}]) AS x(m) WHERE contains(l, {_low('m')})
  UNION ALL SELECT session, ord, 0, 'ingress', 'data-imperative', 'medium', true, text FROM low WHERE {_IMPERATIVE}
  UNION ALL SELECT session, ord, idx, 'egress', 'url-egress', 'critical', true, host FROM outside
  UNION ALL SELECT session, ord, 0, 'egress', 'canary-leak', 'critical', true, {_q(inputs.CANARY)} FROM low
    WHERE contains(p, '{_CANARY}') OR contains(translate(p, {_ROT}), '{_CANARY}') OR contains(reverse(p), '{_CANARY}') OR contains(reverse(translate(p, {_ROT})), '{_CANARY}')),
findings AS (SELECT session, ord, CAST(idx AS INTEGER) AS idx, layer, rule, severity, invariant, substr(sha256(e), 1, 16) AS evidence_digest FROM raw)"""
_RANK = "(list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1)"
DECIDED = f"""decided AS (
  SELECT session, CASE WHEN count(*) FILTER (invariant) > 0 OR coalesce(max({_RANK}) FILTER (NOT invariant AND severity <> 'info'), -1) >= {{threshold}} THEN 'block' ELSE 'allow' END AS decision,
    count(*) FILTER (invariant) AS invariant_n, count(*) FILTER (NOT invariant) AS scored_n FROM findings GROUP BY session)"""
LINES = f"""{KEV}, {FINDINGS}, ev AS (SELECT * FROM v_kev WHERE session IS NOT NULL),
{DECIDED.format(threshold=3)},
known AS (SELECT DISTINCT session FROM v_attacks UNION SELECT DISTINCT session FROM ev),
unnumbered AS (
  SELECT session, 0 AS class, 'session_open' AS t, CAST(0 AS BIGINT) AS ord, 0 AS idx, '' AS layer, '' AS rule, '' AS dg, CAST(0 AS BIGINT) AS pid, NULL AS decision, NULL AS invariant, NULL AS trust, NULL AS tainted FROM known
  UNION ALL SELECT session, 1, 'span', ord, 0, '', '', '', 0, NULL, NULL, trust, NULL FROM v_attacks
  UNION ALL SELECT session, 2, 'event', ord, 0, '', '', '', pid, NULL, NULL, NULL, false FROM ev
  UNION ALL SELECT session, 3, 'finding', ord, idx, layer, rule, evidence_digest, 0, NULL, invariant, NULL, true FROM findings
  UNION ALL SELECT session, 4, 'decision', 0, 0, '', '', '', 0, coalesce(decision, 'allow'), NULL, NULL, NULL FROM known LEFT JOIN decided USING (session)
  UNION ALL SELECT session, 5, 'session_close', 0, 0, '', '', '', 0, NULL, NULL, NULL, NULL FROM known),
lines AS (SELECT row_number() OVER (ORDER BY session, class, ord, idx, layer, rule, dg, pid) AS seq, * FROM unnumbered)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs: str = ""):
    """Register a function (spark, sf_dir) by its name, with its oracle and the CTEs that this needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {needs} {sql}" if needs else sql
        return f

    return add


def _attack_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.attacks(spark, sf_dir)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.raw_findings(inputs.attacks(spark, sf_dir), inputs.POLICY)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.attacks(spark, sf_dir).withColumn("channel", F.col("source"))
    ev = inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL")
    return stream.emitted(stream.lines(a, ev, _findings(spark, sf_dir)))


@query("""SELECT v.session, count(*) AS spans, count(*) FILTER (trust = 'data') AS data_spans, f.origins, coalesce(d.decision, 'allow') AS decision
FROM v_spans v JOIN (SELECT session, string_agg(channel || ':' || ref, ',' ORDER BY ord, channel, ref) AS origins FROM (SELECT DISTINCT session, ord, channel, ref FROM v_spans WHERE trust = 'data') GROUP BY session) f USING (session)
LEFT JOIN (SELECT session, 'block' AS decision FROM (SELECT session, """ + _low("text") + """ AS l FROM v_spans WHERE trust = 'data') WHERE """ + _IMPERATIVE + """ GROUP BY session) d USING (session)
GROUP BY v.session, f.origins, d.decision""", SPANS)
def tainted_sessions(spark, sf_dir):
    """One pass over the texts gives each span what it adds to its session; everything else is one small aggregate."""
    rows = inputs.spans(spark, sf_dir)
    data = F.col("trust") == "data"
    rows = rows.select("session", "ord", "trust", "channel", "ref", F.explode(F.array(t.lower_ascii(F.when(data, F.col("text"))))).alias("low"))
    shaped = F.coalesce(fi.instruction_shaped(F.col("low"), F.col("low")), F.lit(False))
    return sessions.taint_summary(rows.withColumn("shaped", shaped)).where("data_spans > 0").select("session", "spans", "data_spans", "origins", F.when(F.col("shaped"), "block").otherwise("allow").alias("decision"))


@query("SELECT session, ord, role, trust FROM v_spans", SPANS)
def span_role_trust(spark, sf_dir):
    return inputs.spans(spark, sf_dir).select("session", "ord", "role", "trust")


@query("SELECT session, ord, coalesce(bool_or(trust = 'data') OVER (PARTITION BY session ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS tainted FROM v_spans", SPANS)
def running_taint(spark, sf_dir):
    rows = inputs.spans(spark, sf_dir)
    return sessions.tainted(rows.select("session", "ord"), rows)


@query("SELECT ord, substr(sha256(text), 1, 16) AS digest FROM v_attacks", ATTACKS)
def evidence_digest(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.digest(F.col("text")).alias("digest"))


@query(f"SELECT ord, {_NOISE.format(c='text')} AS plain FROM v_attacks", ATTACKS)
def strip_noise(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.strip_noise(F.col("text")).alias("plain"))


@query(f"SELECT ord, {_SEPARATORS.format(c='text')} AS joined FROM v_attacks", ATTACKS)
def strip_separators(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.strip_separators(F.col("text")).alias("joined"))


@query(f"SELECT ord, translate(text, {_ROT}) AS turned FROM v_attacks", ATTACKS)
def rot13(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.rot13(F.col("text")).alias("turned"))


@query(f"SELECT ord, {_INVISIBLE.format(c='text')} AS seen, strlen(text) - strlen({_INVISIBLE.format(c='text')}) AS dropped_bytes FROM v_attacks", ATTACKS)
def strip_invisibles(spark, sf_dir):
    seen = t.strip_invisibles(F.col("text"))
    return _attack_spans(spark, sf_dir).select("ord", seen.alias("seen"), (F.octet_length("text") - F.octet_length(seen)).cast("long").alias("dropped_bytes"))


def _spelt(column: str) -> str:
    return reduce(lambda x, b: f"replace({x}, chr({b}), '\\x{b:02x}')", [b for b in t.UNPRINTABLE if b], column)


@query(f"SELECT ord, {_spelt(chr(116) + 'ext || chr(27) || chr(7) || chr(133)')} AS clean FROM v_attacks", ATTACKS)
def scrub(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.scrub(F.concat("text", F.lit("\x1b\x07\x85"))).alias("clean"))


@query(f"SELECT ord, replace(replace(replace(replace(replace({_spelt('text')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM v_attacks", ATTACKS)
def html_safe(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("ord", t.html_safe(F.col("text")).alias("html"))


@query("SELECT session, ord, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=%]{8,}')) AS run FROM v_attacks", ATTACKS)
def embedded_runs(spark, sf_dir):
    return _attack_spans(spark, sf_dir).select("session", "ord", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/=%]{8,})"), 1)).alias("run"))


_CODED = """SELECT doc_id, sha256(substr(text, 1, 1 << 30)) AS plain, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS depth FROM documents
WHERE strlen(text) BETWEEN 8 AND 16384 AND NOT contains(text, '%') AND NOT contains(text, '=') AND NOT regexp_full_match(text, '[A-Za-z0-9+/=]*') AND strlen(text) = length(text)"""


def _coded(spark, sf_dir, code):
    """Whole texts of ASCII alone that are no code themselves, coded once or, each third one, twice."""
    text = F.col("text")
    rows = inputs.read(spark, sf_dir, "documents").where(F.octet_length(text).between(8, 16384) & ~F.contains(text, F.lit("%")) & ~F.contains(text, F.lit("=")) & ~text.rlike("^[A-Za-z0-9+/=]*$") & (F.octet_length(text) == F.length(text)))
    once = code(F.encode(text, "UTF-8"))
    rows = rows.select("doc_id", closure.unwrapped(F.when(F.col("doc_id") % 3 == 0, code(F.encode(once, "UTF-8"))).otherwise(once)).alias("u"))
    return rows.select("doc_id", F.sha2("u.text", 256).alias("plain"), F.col("u.depth").alias("depth"))


@query(_CODED)
def peel_base64_wellformed(spark, sf_dir):
    return _coded(spark, sf_dir, lambda c: F.replace(F.base64(c), F.lit("\r\n"), F.lit("")))


@query(_CODED)
def peel_hex_wellformed(spark, sf_dir):
    return _coded(spark, sf_dir, F.hex)


@query(f"SELECT ord, {_IMPERATIVE} AS shaped FROM (SELECT ord, {_low('text')} AS l FROM v_attacks)", ATTACKS)
def ingress_raw(spark, sf_dir):
    rows = _attack_spans(spark, sf_dir).select("ord", F.explode(F.array(t.lower_ascii(F.col("text")))).alias("low"))
    return rows.select("ord", fi.instruction_shaped(F.col("low"), F.col("low")).alias("shaped"))


@query("SELECT ord, evidence_digest FROM findings WHERE rule = 'chat-template-marker'", FINDINGS)
def markers_raw(spark, sf_dir):
    return _findings(spark, sf_dir).where("rule = 'chat-template-marker'").select("ord", "evidence_digest")


@query("SELECT ord, rule FROM findings WHERE rule = 'canary-leak'", FINDINGS)
def canary_four_views(spark, sf_dir):
    return _findings(spark, sf_dir).where("rule = 'canary-leak'").select("ord", "rule")


@query("SELECT session, ord, idx, host FROM hosts WHERE host <> ''", f"{ATTACKS}, {HOSTS}")
def url_hosts(spark, sf_dir):
    return fi.url_hosts(_attack_spans(spark, sf_dir)).select("session", "ord", "idx", "host")


@query("SELECT session, ord, idx, substr(sha256(host), 1, 16) AS evidence_digest FROM outside", f"{ATTACKS}, {HOSTS}")
def url_egress_allowlist(spark, sf_dir):
    return fi.url_egress(_attack_spans(spark, sf_dir), inputs.POLICY).select("session", "ord", "idx", "evidence_digest")


@query("SELECT session, ord, idx, layer, rule, severity, invariant, evidence_digest FROM findings", FINDINGS)
def raw_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query(f"SELECT * FROM decided", f"{FINDINGS}, {DECIDED.format(threshold=3)}")
def decide_by_session(spark, sf_dir):
    return fi.decide(_findings(spark, sf_dir))


@query(f"""SELECT session, layer, rule, severity, evidence_digest FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY invariant DESC, {_RANK} DESC, ord, idx, layer DESC, rule DESC) AS n FROM findings) WHERE n = 1""", FINDINGS)
def deciding_finding(spark, sf_dir):
    return fi.deciding(_findings(spark, sf_dir))


@query(f"""SELECT threshold, count(*) FILTER (decision = 'block') AS blocks FROM (
  SELECT session, threshold, CASE WHEN coalesce(max({_RANK}), -1) >= threshold THEN 'block' ELSE 'allow' END AS decision
  FROM findings, (SELECT CAST(range AS INTEGER) AS threshold FROM range(1, 5)) GROUP BY session, threshold) GROUP BY threshold""", FINDINGS)
def policy_threshold_sweep(spark, sf_dir):
    scored = _findings(spark, sf_dir).groupBy("session").agg(F.max(fi.rank(F.col("severity"))).alias("top"))
    return scored.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("threshold"), "top").groupBy("threshold").agg(F.count_if(F.col("top") >= F.col("threshold")).alias("blocks"))


@query(f"SELECT session, layer || '/' || rule || ' [' || evidence_digest || ']' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY invariant DESC, {_RANK} DESC, ord, idx, layer DESC, rule DESC) AS n FROM findings) JOIN decided USING (session) WHERE n = 1 AND decision = 'block'", f"{FINDINGS}, {DECIDED.format(threshold=3)}")
def refusals(spark, sf_dir):
    return fi.refusals(_findings(spark, sf_dir))


@query(f"SELECT call_id, name, ({_low('name')} IN ({', '.join(map(_q, tools.EGRESS_TOOLS))}) OR {' OR '.join(f'starts_with({_low('name')}, {_q(p)})' for p in tools.EGRESS_PREFIXES)} OR {_any(_low('name'), tools.EGRESS_PARTS)}) AS egress FROM v_calls", CALLS)
def tool_classify(spark, sf_dir):
    return inputs.calls(spark, sf_dir).select("call_id", "name", tools.is_egress(F.col("name")).alias("egress"))


@query("SELECT call_id, r AS missing FROM v_calls, unnest(['to', 'body']) AS x(r) WHERE NOT EXISTS (SELECT 1 FROM args a WHERE a.call_id = v_calls.call_id AND a.k = r)", CALLS)
def required_missing(spark, sf_dir):
    return inputs.calls(spark, sf_dir).select("call_id", F.explode(tools.missing(F.col("args"), F.col("required"))).alias("missing"))


@query("SELECT call_id, k AS unexpected FROM args WHERE k NOT IN ('to', 'body')", CALLS)
def unexpected_args(spark, sf_dir):
    return inputs.calls(spark, sf_dir).select("call_id", F.explode(tools.unexpected(F.col("args"), F.col("permitted"))).alias("unexpected"))


@query("SELECT call_id, 'PAY' AS effect FROM v_calls WHERE name = 'buy'", CALLS)
def forbidden_effects(spark, sf_dir):
    return inputs.calls(spark, sf_dir).select("call_id", F.explode(F.array_intersect("effects", F.array(*map(F.lit, inputs.POLICY.forbidden_effects)))).alias("effect"))


@query("SELECT c.call_id, 'body:click' AS entry FROM v_calls c LEFT JOIN args a ON a.call_id = c.call_id AND a.k = 'body' WHERE a.v IS NULL OR a.v <> 'click'", CALLS)
def args_allowlist(spark, sf_dir):
    return inputs.calls(spark, sf_dir).select("call_id", F.explode(tools.not_listed(F.col("args"), F.col("allow"))).alias("entry"))


@query("""SELECT call_id, 'tainted-action' AS rule FROM v_calls WHERE known AND name = 'send_email' AND tainted
UNION ALL SELECT call_id, 'tool-unconfirmed' FROM v_calls WHERE known AND NOT user_confirmed""", CALLS)
def guards(spark, sf_dir):
    found = tools.authorise(inputs.calls(spark, sf_dir), inputs.POLICY)
    return found.where(F.col("rule").isin("tainted-action", "tool-unconfirmed")).select(F.col("ord").alias("call_id"), "rule")


@query("""SELECT rule, count(*) AS n FROM (
  SELECT 'tool-unknown' AS rule FROM v_calls WHERE NOT known
  UNION ALL SELECT 'tool-effect-forbidden' FROM v_calls WHERE known AND name = 'buy'
  UNION ALL SELECT 'tool-args-invalid' FROM v_calls, unnest(['to', 'body']) AS x(r) WHERE known AND NOT EXISTS (SELECT 1 FROM args a WHERE a.call_id = v_calls.call_id AND a.k = r)
  UNION ALL SELECT 'tool-args-unexpected' FROM v_calls JOIN args USING (call_id) WHERE known AND k NOT IN ('to', 'body')
  UNION ALL SELECT 'tainted-action' FROM v_calls WHERE known AND name = 'send_email' AND tainted
  UNION ALL SELECT 'tool-unconfirmed' FROM v_calls WHERE known AND NOT user_confirmed
  UNION ALL SELECT 'tool-args-not-allowlisted' FROM v_calls c LEFT JOIN args a ON a.call_id = c.call_id AND a.k = 'body' WHERE known AND (a.v IS NULL OR a.v <> 'click')) GROUP BY rule""", CALLS)
def tool_authoriser(spark, sf_dir):
    return tools.authorise(inputs.calls(spark, sf_dir), inputs.POLICY).groupBy("rule").agg(F.count("*").alias("n"))


_EDGES = "edges AS (SELECT pid, arg_max(ppid, ord) AS ppid FROM v_kev WHERE kind = 'exec' AND ppid <> 0 GROUP BY pid)"
_TREE = """down AS (
  SELECT pid AS root, pid, 0 AS depth FROM seeds
  UNION ALL SELECT root, e.pid, depth + 1 FROM down JOIN edges e ON e.ppid = down.pid AND e.pid <> e.ppid WHERE depth < 64)"""


@query("SELECT root, pid, min(depth) AS depth FROM down GROUP BY root, pid", f"{KEV}, {_EDGES}, seeds AS (SELECT CAST(range AS BIGINT) AS pid FROM range(1, 5)), {_TREE}")
def proc_descendants(spark, sf_dir):
    seeds = spark.range(1, 5).withColumnRenamed("id", "root")
    return process.descendants(process.edges(inputs.kernel_events(spark, sf_dir)), seeds)


@query("SELECT pid, ppid FROM nodes WHERE ppid NOT IN (SELECT pid FROM nodes) OR pid = ppid", f"{KEV}, nodes AS (SELECT pid, arg_max(ppid, ord) AS ppid FROM v_kev GROUP BY pid)")
def proc_roots(spark, sf_dir):
    nodes = inputs.kernel_events(spark, sf_dir).groupBy("pid").agg(F.max_by("ppid", "ord").alias("ppid"))
    return process.roots(nodes)


@query("SELECT pid, root, min(depth) AS depth FROM down GROUP BY pid, root", f"{KEV}, edges AS (SELECT pid, arg_max(ppid, ord) AS ppid FROM v_kev GROUP BY pid), seeds AS (SELECT pid FROM edges WHERE ppid NOT IN (SELECT pid FROM edges) OR pid = ppid), {_TREE}")
def proc_forest(spark, sf_dir):
    nodes = inputs.kernel_events(spark, sf_dir).groupBy("pid").agg(F.max_by("ppid", "ord").alias("ppid"))
    return process.forest(nodes)


@query("""SELECT ord, pid, CAST(greatest(coalesce(ts - start, 0), 0) AS BIGINT) AS duration FROM (
  SELECT *, last_value(CASE WHEN kind = 'exec' THEN ts END IGNORE NULLS) OVER (PARTITION BY pid, life ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM (
    SELECT *, coalesce(sum(CASE WHEN kind = 'exit' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM v_kev WHERE kind IN ('exec', 'exit'))) WHERE kind = 'exit'""", KEV)
def exec_exit_duration(spark, sf_dir):
    return process.durations(inputs.kernel_events(spark, sf_dir)).select("ord", "pid", "duration")


def _attributed(spark, sf_dir):
    """Four sessions with a root each; the first one of them ends amid the events."""
    events = inputs.kernel_events(spark, sf_dir)
    roots = spark.range(1, 5).select(F.concat(F.lit("s"), (F.col("id") - 1).cast("string")).alias("session"), F.col("id").alias("root"), (F.col("id") - 9).alias("opened"), F.when(F.col("id") == 1, 700).cast("long").alias("closed"))
    return process.attributed(events, roots)


_OWNED = f"""{KEV}, {_EDGES},
n AS (SELECT row_number() OVER (ORDER BY ord) AS i, * FROM v_kev),
pids AS (SELECT CAST(unnest(range(1, (SELECT max(greatest(pid, ppid)) + 1 FROM v_kev))) AS BIGINT) AS pid),
given AS (SELECT p.pid, CASE WHEN count(k.ord) = 0 THEN -1 ELSE coalesce(arg_max(k.ppid, k.ord) FILTER (k.ppid <> 0), 0) END AS up FROM pids p LEFT JOIN v_kev k ON k.pid = p.pid AND k.kind = 'exec' GROUP BY p.pid),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list(CAST(up AS BIGINT) ORDER BY pid) FROM given) AS p, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS VARCHAR) AS owner
  UNION ALL
  SELECT i, CASE WHEN owner IS NULL OR kind NOT IN ('exec', 'exit') THEN p
      ELSE list_concat(p[:pid - 1], [CASE WHEN kind = 'exit' THEN -1 WHEN ppid <> 0 THEN ppid ELSE greatest(p[pid], 0) END], p[pid + 1:]) END, ord, pid, owner
  FROM (
    SELECT n.i, p, n.ord, n.pid, n.ppid, n.kind, coalesce(n.session, CASE WHEN c[2] < 99 THEN 's' || (c[2] - 1) END) AS owner
    FROM (
      SELECT n.*, walk.p, list_reduce(range(0, 40), lambda a, x: [
          CASE WHEN coalesce(walk.p[a[1]], -1) <= 0 OR walk.p[a[1]] = a[1] THEN 0 ELSE walk.p[a[1]] END,
          least(a[2], CASE WHEN walk.p[a[1]] BETWEEN (CASE WHEN n.ord <= 700 THEN 1 ELSE 2 END) AND 4 THEN walk.p[a[1]] ELSE 99 END)],
        [n.pid, CASE WHEN n.pid BETWEEN (CASE WHEN n.ord <= 700 THEN 1 ELSE 2 END) AND 4 THEN n.pid ELSE 99 END]) AS c
      FROM walk JOIN n ON n.i = walk.i + 1) n)),
owned AS (SELECT ord, pid, owner FROM walk WHERE i > 0)"""


@query("SELECT * FROM owned WHERE owner IS NOT NULL", _OWNED)
def event_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).where("owner IS NOT NULL").select("ord", "pid", "owner")


@query("SELECT pid, count(*) AS drops FROM owned WHERE owner IS NULL GROUP BY pid", _OWNED)
def unowned_drops(spark, sf_dir):
    return _attributed(spark, sf_dir).where("owner IS NULL").groupBy("pid").agg(F.count("*").alias("drops"))


_RUN = f"""{CALLS},
said AS (
  SELECT event_id * 4 + 1 AS ord, 'tool_call' AS t, 'c' || user_id AS session, event_id, CAST(NULL AS VARCHAR[]) AS forbidden FROM events
  UNION ALL SELECT event_id * 4, 'policy', NULL, event_id, CASE WHEN event_id % 40 = 0 THEN ['PAY'] WHEN event_id % 60 = 0 THEN ['READ', 'PAY'] END FROM events WHERE event_id % 20 = 0
  UNION ALL SELECT event_id * 4 + 2, 'span', 'c' || user_id, event_id, NULL FROM events WHERE event_id % 37 = 0),
run AS (SELECT row_number() OVER (ORDER BY ord) AS place, * FROM said),
tainting AS (SELECT session, min(place) AS first FROM run WHERE t = 'span' GROUP BY session),
called AS (
  SELECT r.session, r.place, c.*, coalesce(x.first < r.place, false) AS influenced, coalesce(p.forbidden, []) AS forbidden
  FROM run r JOIN v_calls c ON c.call_id = r.event_id LEFT JOIN tainting x ON x.session = r.session
  ASOF LEFT JOIN (SELECT place, forbidden FROM run WHERE forbidden IS NOT NULL) p ON p.place < r.place WHERE r.t = 'tool_call'),
judged AS (
  SELECT session, place AS inspection, CASE WHEN NOT known THEN 1 ELSE
    len(list_filter(CASE WHEN name = 'buy' THEN ['PAY', 'READ'] ELSE ['READ'] END, lambda f: list_contains(forbidden, f)))
    + CAST(call_id % 4 = 0 AS BIGINT) + CAST(call_id % 5 = 0 AS BIGINT) + CAST(call_id % 7 = 0 AS BIGINT)
    + CAST(name = 'send_email' AND influenced AS BIGINT) + CAST(NOT user_confirmed AS BIGINT)
    + CAST(call_id % 5 = 0 OR event_type <> 'click' AS BIGINT) END AS invariant_n FROM called)"""


@query("""SELECT session, inspection, CASE WHEN invariant_n > 0 THEN 'block' ELSE 'allow' END AS decision, CAST(invariant_n AS BIGINT) AS invariant_n, CAST(1 AS BIGINT) AS scored_n FROM judged
UNION ALL SELECT DISTINCT session, CAST(1 AS BIGINT) << 62, 'allow', CAST(0 AS BIGINT), CAST(3 AS BIGINT) FROM run WHERE session IS NOT NULL""", _RUN)
def replay_decisions(spark, sf_dir):
    """A whole run with policies that change on its way, under the tool layer alone: its other layers are notes."""
    run = replay.replay(inputs.program(spark, sf_dir), default=Policy(layers=frozenset({"toolauth"})))
    return run["decisions"]


@query("SELECT pid, coalesce(arg_max(ppid, ord) FILTER (ppid <> 0), 0) AS ppid, arg_max(comm, ord) FILTER (comm <> '') AS comm, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, arg_max(kind, ord) <> 'exit' AS alive FROM v_kev GROUP BY pid", KEV)
def proc_nodes(spark, sf_dir):
    return process.nodes(inputs.kernel_events(spark, sf_dir))


@query("SELECT ord, pid FROM v_kev WHERE starts_with(translate(comm, 'P', 'p'), 'p1')", KEV)
def name_match(spark, sf_dir):
    return inputs.kernel_events(spark, sf_dir).where(process.name_matches(F.col("comm"), F.concat(F.lit("/bin/x"), "comm", F.lit(" --run")), "P1")).select("ord", "pid")


@query("SELECT ord, (ord >> 8) & 255 AS code, ord & 127 AS signal FROM v_kev", KEV)
def exit_status(spark, sf_dir):
    code, signal = process.exit_status(F.col("ord"))
    return inputs.kernel_events(spark, sf_dir).select("ord", code.alias("code"), signal.alias("signal"))


@query(f"SELECT session, count(*) AS events, least(count(*), {RING}) AS held, greatest(count(*) - {RING}, 0) AS drop_total FROM v_kev WHERE session IS NOT NULL GROUP BY session", KEV)
def ring_counts(spark, sf_dir):
    return process.rings(inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL"), RING)


@query(f"SELECT session, ord FROM (SELECT session, ord, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS n FROM v_kev WHERE session IS NOT NULL) WHERE n <= {RING}", KEV)
def ring_last_n(spark, sf_dir):
    rows = inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL").select("session", "ord")
    return ordered.newest(rows, ["session"], [F.col("ord")], RING)


@query(f"SELECT ord, kind, pid FROM v_kev ORDER BY ord DESC LIMIT {VIEW_EVENTS}", KEV)
def view_last_n(spark, sf_dir):
    return inputs.kernel_events(spark, sf_dir).select("ord", "kind", "pid").orderBy(F.desc("ord")).limit(VIEW_EVENTS)


_ARRIVED = """arrived AS (SELECT event_id AS arrival, CASE WHEN event_id % 11 = 0 THEN event_id - 7 WHEN event_id % 13 = 0 THEN 0 ELSE event_id END AS seq FROM events),
marked AS (SELECT *, coalesce(seq > 0 AND seq <= coalesce(max(CASE WHEN seq > 0 THEN seq END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), false) AS duplicate FROM arrived)"""


def _arrived(spark, sf_dir):
    e = F.col("event_id")
    rows = inputs.read(spark, sf_dir, "events").select(e.alias("arrival"), F.when(e % 11 == 0, e - 7).when(e % 13 == 0, 0).otherwise(e).alias("seq"))
    return ordered.fresh(rows, [F.col("arrival")])


@query("SELECT arrival, seq, duplicate FROM marked", _ARRIVED)
def seq_dedup(spark, sf_dir):
    return _arrived(spark, sf_dir)


def _fault():
    return F.when(F.col("arrival") % 29 == 3, F.concat(F.lit("no such line: "), F.col("arrival").cast("string")))


@query("SELECT count(*) FILTER (arrival % 29 = 3) AS errors, count(*) FILTER (duplicate) AS duplicates, max(seq) FILTER (NOT duplicate) AS last_seq FROM marked", _ARRIVED)
def protocol_state(spark, sf_dir):
    return stream.protocol(_arrived(spark, sf_dir).withColumn("error", _fault()))


@query("SELECT arrival, 'no such line: ' || arrival AS error FROM arrived WHERE arrival % 29 = 3 ORDER BY arrival DESC LIMIT 5", _ARRIVED)
def last_errors(spark, sf_dir):
    return stream.last_errors(_arrived(spark, sf_dir).withColumn("error", _fault()), "arrival")


_MODE = "CASE flags & 3 WHEN 1 THEN 'w' WHEN 2 THEN 'rw' ELSE 'r' END || CASE WHEN flags & 64 <> 0 THEN '+' ELSE '' END"


@query(f"SELECT ord, {_MODE} AS mode FROM v_kev", KEV)
def open_mode(spark, sf_dir):
    return inputs.kernel_events(spark, sf_dir).select("ord", t.open_mode(F.col("flags")).alias("mode"))


@query(f"SELECT ord, CASE kind WHEN 'exec' THEN comm || ' --run' WHEN 'exit' THEN comm || ' exited' WHEN 'open' THEN '(' || {_MODE} || ') /tmp/' || pid ELSE comm || ' → 10.0.0.1:' || flags END AS detail FROM v_kev", KEV)
def event_detail(spark, sf_dir):
    rows = inputs.kernel_events(spark, sf_dir)
    detail = t.event_detail(F.col("kind"), F.col("comm"), F.concat(F.lit(" "), "comm", F.lit(" --run")), F.concat(F.lit("/tmp/"), F.col("pid").cast("string")), F.col("flags"), F.lit("10.0.0.1"), F.col("flags"))
    return rows.select("ord", detail.alias("detail"))


@query("SELECT seq, t, session FROM lines", LINES)
def stream_emit(spark, sf_dir):
    return _lines(spark, sf_dir).select("seq", "t", "session")


@query("""SELECT session, count(*) FILTER (t = 'span') AS spans, count(*) FILTER (t = 'event') AS events, count(*) FILTER (t = 'finding') AS findings,
  count(*) FILTER (t = 'finding' AND invariant) AS invariant, count(*) FILTER (t = 'span' AND trust = 'data') > 0 AS tainted, max(decision) AS decision, false AS open FROM lines GROUP BY session""", LINES)
def session_fold(spark, sf_dir):
    return stream.session_fold(_lines(spark, sf_dir))


@query("""SELECT count(DISTINCT session) AS sessions, count(DISTINCT session) FILTER (t = 'span') AS tainted_sessions, count(*) FILTER (t = 'event') AS events, count(*) FILTER (t = 'finding') AS findings,
  count(*) FILTER (invariant) AS invariant, count(*) FILTER (decision = 'block') AS blocks, count(*) FILTER (t = 'event' AND tainted) AS tainted_events, count(DISTINCT pid) FILTER (t = 'event') AS processes FROM lines""", LINES)
def stats_strip(spark, sf_dir):
    return stream.stats(_lines(spark, sf_dir))


@query("SELECT f.session, f.seq, f.layer, f.rule FROM lines f JOIN lines d ON d.session = f.session AND d.decision = 'block' AND d.seq > f.seq WHERE f.t = 'finding' AND f.invariant", LINES)
def blocked_by(spark, sf_dir):
    return stream.blocked_by(_lines(spark, sf_dir))


@query("SELECT count(*) FILTER (t = 'event') AS events, count(DISTINCT session) FILTER (t = 'span' AND trust = 'data') AS tainted_sessions, count(*) FILTER (invariant) AS invariant, count(*) FILTER (t = 'finding' AND NOT invariant) AS scored, count(*) FILTER (decision = 'block') AS blocks FROM lines", LINES)
def run_summary(spark, sf_dir):
    return stream.run_summary(_lines(spark, sf_dir))


@query("SELECT CASE WHEN ord % 2 = 0 THEN 'declared' ELSE 'inferred' END AS provenance, layer, severity, count(*) AS n FROM findings GROUP BY ALL", FINDINGS)
def provenance_split(spark, sf_dir):
    marked = _findings(spark, sf_dir).withColumn("provenance", F.when(F.col("ord") % 2 == 0, "declared").otherwise("inferred"))
    return stream.provenance_split(marked)


@query(f"SELECT CAST(max(d) AS BIGINT) AS drop_total, CAST(0 AS BIGINT) AS upd_fail_total, max(d) > 0 AS lossy FROM (SELECT greatest(count(*) - {RING}, 0) AS d FROM v_kev WHERE session IS NOT NULL GROUP BY session UNION ALL SELECT 3)", KEV)
def drop_merge(spark, sf_dir):
    closed = process.rings(inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL"), RING).withColumn("upd_fail_total", F.lit(0).cast("long"))
    return stream.drops(closed, 3)


@query(f"""SELECT session, string_agg(CASE WHEN trust = 'data' THEN '<<<UNTRUSTED-{NONCE} origin=' || channel || ':' || ref || '>>>' || chr(10) || text || chr(10) || '<<<END-{NONCE}>>>' || chr(10) ELSE text || chr(10) END, '' ORDER BY ord, text) AS prompt, false AS truncated FROM v_spans WHERE text IS NOT NULL GROUP BY session""", SPANS)
def fence_render(spark, sf_dir):
    return sessions.fenced(inputs.spans(spark, sf_dir).where("text IS NOT NULL"), F.lit(NONCE))


@query("SELECT ord, pid, CAST(-1 AS INTEGER) AS verdict FROM v_kev WHERE kind = 'open' AND pid % 10 IN (3, 7)", KEV)
def inode_deny(spark, sf_dir):
    denied = spark.createDataFrame([(3,), (7,)], "ino long")
    opened = inputs.kernel_events(spark, sf_dir).where("kind = 'open'").withColumn("ino", F.col("pid") % 10)
    return opened.join(F.broadcast(denied), "ino", "left_semi").select("ord", "pid", F.lit(-1).alias("verdict"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'nosession' ELSE regexp_replace(source || '/é ' || lang, '[^A-Za-z0-9_.@-]', '_', 'g') END AS name FROM documents")
def session_names(spark, sf_dir):
    c = F.when(F.coalesce("source", F.lit("")) == "", "").otherwise(F.concat("source", F.lit("/é "), "lang"))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", t.session_name(c).alias("name"))


@query("SELECT doc_id, regexp_matches(substr(sha256(CAST(doc_id AS VARCHAR)), 1, CAST(14 + doc_id % 4 AS INTEGER)), '^[0-9A-Fa-f]{16}$') AS valid FROM documents")
def nonce_valid(spark, sf_dir):
    value = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(1), (F.col("doc_id") % 4 + 14).cast("int"))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", t.is_nonce(value).alias("valid"))


@query("SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(replace(text, chr(10), ' '), '[, \\t]+'), lambda x: x <> '')) AS entry FROM conversations")
def env_list(spark, sf_dir):
    entries = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), "[, \\t]+"), lambda x: x != "")
    return inputs.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(entries).alias("entry"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '—' ELSE strftime(make_timestamp(event_id * 7001 * 1000), '%H:%M:%S.%g') END AS clock FROM events WHERE event_id >= 0")
def clock(spark, sf_dir):
    ms = F.when(F.col("event_id") % 5 == 0, -F.col("event_id")).otherwise(F.col("event_id") * 7001)
    return inputs.read(spark, sf_dir, "events").where("event_id >= 0").select("event_id", t.clock(ms).alias("clock"))


@query("SELECT event_id, format('{:,}', event_id * 7001) AS shown FROM events")
def count_format(spark, sf_dir):
    return inputs.read(spark, sf_dir, "events").select("event_id", t.counted(F.col("event_id") * 7001).alias("shown"))


@query("""SELECT event_id, 'h' || user_id || '.example' AS host, CAST(CASE event_id % 3 WHEN 0 THEN 8000 + event_id % 9 WHEN 1 THEN 443 ELSE 80 END AS INTEGER) AS port, CASE WHEN event_id % 2 = 0 THEN '/v1/' || event_type ELSE '' END AS prefix FROM events""")
def upstream_parts(spark, sf_dir):
    e = F.col("event_id")
    scheme = F.when(e % 3 == 2, "http").otherwise("https")
    port = F.when(e % 3 == 0, F.concat(F.lit(":"), (e % 9 + 8000).cast("string"))).otherwise("")
    path = F.when(e % 2 == 0, F.concat(F.lit("/v1/"), "event_type", F.lit("/"))).when(e % 5 == 0, "/").otherwise("")
    url = F.concat(scheme, F.lit("://h"), F.col("user_id").cast("string"), F.lit(".example"), port, path)
    host, number, prefix = t.url_parts(url)
    return inputs.read(spark, sf_dir, "events").select("event_id", host.alias("host"), number.alias("port"), prefix.alias("prefix"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'processed ' || doc_id || ' insns' END AS summary FROM documents WHERE NOT contains(text, 'processed ')")
def verifier_summary(spark, sf_dir):
    log = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("\nprocessed 1 insns\nprocessed "), F.col("doc_id").cast("string"), F.lit(" insns\n"))))
    return inputs.read(spark, sf_dir, "documents").where(~F.contains("text", F.lit("processed "))).select("doc_id", t.verifier_summary(log).alias("summary"))


@query("SELECT ord, rpad(kind, 5, ' ') || ' pid=' || pid || ' comm=' || comm || ' flags ' || flags AS line FROM v_kev", KEV)
def sensor_lines(spark, sf_dir):
    detail = F.concat(F.lit("flags "), F.col("flags").cast("string"))
    return inputs.kernel_events(spark, sf_dir).select("ord", t.sensor_line(F.col("kind"), F.col("pid"), F.col("comm"), detail).alias("line"))


@query("SELECT ord, kind FROM v_kev WHERE kind IN ('exec', 'open')", KEV)
def class_filter(spark, sf_dir):
    return process.only(inputs.kernel_events(spark, sf_dir), ("exec", "open", "exit"), ("exit", "ghost")).select("ord", "kind")


@query("SELECT ord FROM v_kev WHERE kind <> 'exit' OR ord % 3 = 0", KEV)
def leader_exits(spark, sf_dir):
    events = inputs.kernel_events(spark, sf_dir).withColumn("tid", F.when(F.col("ord") % 3 == 0, F.col("pid")).otherwise(F.col("pid") + 1))
    return process.leaders(events).select("ord")


@query("SELECT conv_id, turn, array_to_string(list_slice(regexp_split_to_array(substr(text, 1, 200), ' '), 1, 40), ' ') AS cmdline FROM conversations WHERE text IS NOT NULL AND NOT starts_with(text, ' ')")
def argv_join(spark, sf_dir):
    args = F.split(F.substring("text", 1, 200), " ")
    return inputs.read(spark, sf_dir, "conversations").where("text IS NOT NULL AND text NOT LIKE ' %'").select("conv_id", "turn", process.argv(args).alias("cmdline"))


@query("SELECT root, pid, min(depth) AS depth FROM down GROUP BY root, pid", f"{KEV}, {_EDGES}, seeds AS (SELECT DISTINCT pid FROM v_kev WHERE kind = 'exec' AND starts_with(comm, 'p3')), {_TREE}")
def needle_descendants(spark, sf_dir):
    events = inputs.kernel_events(spark, sf_dir)
    return process.descendants(process.edges(events), process.named_seeds(events.withColumn("cmdline", F.lit("")), "P3"))


@query("""SELECT pid, depth, row_number() OVER (ORDER BY way) AS place FROM (
  SELECT pid, depth, way FROM walk WHERE depth = (SELECT min(depth) FROM walk w WHERE w.pid = walk.pid AND w.way[1] = walk.way[1]))""", f"""{KEV}, nodes AS (SELECT pid, arg_max(ppid, ord) AS ppid FROM v_kev GROUP BY pid),
walk AS (
  SELECT pid, 0 AS depth, [pid] AS way FROM nodes WHERE ppid NOT IN (SELECT pid FROM nodes) OR pid = ppid
  UNION ALL SELECT n.pid, depth + 1, list_append(way, n.pid) FROM walk JOIN nodes n ON n.ppid = walk.pid AND n.pid <> n.ppid WHERE depth < 64)""")
def forest_walk(spark, sf_dir):
    nodes = inputs.kernel_events(spark, sf_dir).groupBy("pid").agg(F.max_by("ppid", "ord").alias("ppid"))
    return process.walk_order(nodes)


@query("SELECT session, root_pid, row_number() OVER (ORDER BY root_pid, session) AS place FROM (SELECT session, min(pid) AS root_pid FROM v_kev WHERE session IS NOT NULL GROUP BY session)", KEV)
def session_order(spark, sf_dir):
    rows = inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL").groupBy("session").agg(F.min("pid").alias("root_pid"))
    return ordered.numbered(rows, [F.col("root_pid"), F.col("session")], "place")


@query("SELECT session, dense_rank() OVER (ORDER BY first) AS place FROM (SELECT session, min(ord) AS first FROM v_kev WHERE session IS NOT NULL GROUP BY session)", KEV)
def first_seen_order(spark, sf_dir):
    rows = inputs.kernel_events(spark, sf_dir).where("session IS NOT NULL").groupBy("session").agg(F.min("ord").alias("first"))
    return ordered.numbered(rows, [F.col("first")], "place").select("session", "place")


@query("SELECT session, ord, idx, layer, rule FROM findings ORDER BY ord DESC, idx DESC, layer DESC, rule DESC, evidence_digest DESC LIMIT 1000", FINDINGS)
def findings_view(spark, sf_dir):
    order = [F.desc(c) for c in ("ord", "idx", "layer", "rule", "evidence_digest")]
    return _findings(spark, sf_dir).orderBy(*order).limit(VIEW_FINDINGS).select("session", "ord", "idx", "layer", "rule")


@query("""SELECT f.session, to_json({'decision': any_value(decision), 'findings': list({'layer': layer, 'rule': rule, 'severity': severity, 'invariant': invariant, 'evidence_digest': evidence_digest} ORDER BY ord, idx, layer, rule, severity, invariant, evidence_digest)})::VARCHAR AS payload
FROM findings f JOIN decided USING (session) GROUP BY f.session""", f"{FINDINGS}, {DECIDED.format(threshold=3)}")
def verdict_payload(spark, sf_dir):
    return fi.verdict(_findings(spark, sf_dir))


@query("SELECT provenance, layer, severity, count(*) AS n FROM (SELECT 'inferred' AS provenance, * FROM findings) GROUP BY ALL", FINDINGS)
def inferred_provenance(spark, sf_dir):
    return stream.provenance_split(fi.inferred(_findings(spark, sf_dir)))


@query("""SELECT 'c' || conv_id AS session, turn AS idx, 'call' || turn AS id, role AS name, '{"n":' || turn || '}' AS arguments FROM conversations""")
def reply_calls(spark, sf_dir):
    rows = inputs.read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").cast("int").alias("turn"), "role")
    call = F.struct(F.concat(F.lit("call"), F.col("turn").cast("string")).alias("id"), F.struct(F.col("role").alias("name"), F.concat(F.lit('{"n":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments")).alias("function"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("x").alias("content"), F.array(call).alias("tool_calls")).alias("message"))).alias("choices")))
    _, calls = lines.chat_replies(rows.select(F.struct("session", "turn").alias("s"), body.alias("body")), session="s")
    return calls.select("session.session", F.col("session.turn").alias("idx"), "id", "name", "arguments")


@query(f"""SELECT 'layer-disabled' AS rule, layer, count(*) AS n FROM v_spans, (SELECT unnest(['normalize', 'provenance']) AS layer) GROUP BY layer""", SPANS)
def disabled_layers(spark, sf_dir):
    off = Policy(layers=frozenset(("ingress", "toolauth", "egress")))
    found = fi.disabled(inputs.spans(spark, sf_dir).select("session", "ord"), off, ("normalize", "ingress", "provenance"))
    return found.groupBy("rule", "layer").agg(F.count("*").alias("n"))


@query()
def closure_reading_counts(spark, sf_dir):
    """Readings of every text: how many, their bytes, and a digest of the last one."""
    rows = fi.with_readings(inputs.attacks(spark, sf_dir))
    return rows.select("ord", F.size("readings").alias("readings"), F.aggregate("readings", F.lit(0).cast("long"), lambda s, r: s + F.octet_length(r)).alias("bytes"), t.digest(F.element_at("readings", -1)).alias("last"))


@query()
def normalize_findings(spark, sf_dir):
    return fi.normalize_findings(inputs.attacks(spark, sf_dir))


@query()
def ingress_full(spark, sf_dir):
    return fi.ingress_findings(inputs.attacks(spark, sf_dir), inputs.POLICY)


@query()
def canary_full(spark, sf_dir):
    return fi.canary_findings(inputs.attacks(spark, sf_dir), inputs.POLICY)


@query()
def nonce_forgery(spark, sf_dir):
    """The nonce of a session is that of its name; every fifth text shows its own."""
    rows = inputs.attacks(spark, sf_dir).withColumn("nonce", t.digest(F.col("session")))
    rows = rows.withColumn("text", F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit(" END-"), "nonce")).otherwise(F.col("text")))
    return fi.nonce_findings(rows)
