"""Where agent records come from: JSON lines of a run, chat messages, hook events, content blocks.

JSON here keeps the order of keys, the first of repeated keys, and knows lines that are wrong; Spark's own parser
drops that, so lines are parsed in Arrow batches. Everything after the scan is native.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sessions import trust_of
from ..policy import Policy

#: How deep JSON may nest, and the kinds of a line and of an event.
DEPTH = 64
KINDS = ("policy", "session_open", "span", "event", "tool_call", "reply", "session_close")
EVENT_KINDS = ("exec", "exit", "open", "net")
LINE = (
    "t string, ord long, session string, harness string, root_pid long, trust string, role string, channel string, ref string, text string, "
    "kind string, ts long, pid long, ppid long, comm string, cmdline string, filename string, flags long, dirfd int, port int, addr string, "
    "name string, known boolean, user_confirmed boolean, args array<struct<k:string,v:string>>, permitted array<string>, required array<string>, "
    "allow array<string>, effects array<string>, guards array<string>, tool_calls array<struct<name:string,known:boolean,user_confirmed:boolean,args:array<struct<k:string,v:string>>,permitted:array<string>,required:array<string>,allow:array<string>,effects:array<string>,guards:array<string>>>, block_threshold string, strict_data boolean, "
    "canaries array<string>, allowed_hosts array<string>, forbidden_effects array<string>, error string"
)
_DEFAULTS = {"harness": "replay", "role": "", "root_pid": 0, "ppid": 0, "ts": 0, "comm": "", "cmdline": "", "filename": "", "flags": 0, "dirfd": -100, "port": 0, "addr": "", "known": True, "user_confirmed": False}


_HALVES = re.compile("[\ud800-\udfff]")
_SMALL = ("dirfd", "port")  # 32 bits


class Bad(ValueError):
    """A line that can't be taken."""


def parse(text: str):
    """JSON with objects as lists of pairs in order, the first of equal keys only. ``Bad`` for anything else."""

    def pairs(items):
        out: dict = {}
        for k, v in items:
            out.setdefault(k, v)
        return out

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=lambda c: (_ for _ in ()).throw(Bad(f"{c} is no JSON")))
    except (ValueError, RecursionError) as e:
        raise Bad(str(e).splitlines()[0]) from None
    if depth(value) > DEPTH:
        raise Bad("nested too deeply")
    return _whole(value) if "\\u" in text else value


def _whole(value):
    """The value with U+FFFD for halves of surrogate pairs. Nesting is bounded."""
    if isinstance(value, str):
        return _HALVES.sub("\ufffd", value)
    if isinstance(value, dict):
        out: dict = {}
        for k, v in value.items():
            out.setdefault(_whole(k), _whole(v))
        return out
    return [_whole(v) for v in value] if isinstance(value, list) else value


def depth(value) -> int:
    """Levels of lists and objects, without recursion."""
    most, todo = 0, [(value, 0)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (dict, list)):
            most = max(most, d + 1)
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def flatten(value, full_numbers: bool = False) -> str:
    """Keys, strings and numbers of a JSON value in order, with blanks between. Numbers have six digits unless asked otherwise."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += [x for pair in reversed(v.items()) for x in reversed(pair)]
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, str):
            out.append(v)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(str(v) if full_numbers else f"{v:g}")
    return " ".join(out)


@F.arrow_udf(T.StringType())
def flatten_json(c: pa.Array) -> pa.Array:
    """What ``flatten`` makes of a JSON text; null for null and for what is no JSON."""

    def one(s):
        try:
            return None if s is None else flatten(parse(s))
        except Bad:
            return None

    return pa.array([one(s) for s in c.to_pylist()], pa.string())


def _typed(value: dict, name: str, kind: type, missing=None):
    """A field of its type; ``missing`` where it is absent or null."""
    got = value.get(name)
    if got is None:
        return missing
    if kind is int and isinstance(got, float) and math.isfinite(got):
        got = int(got)
    if kind is int and isinstance(got, int) and not -(m := 1 << (31 if name in _SMALL else 63)) <= got < m:
        raise Bad(f"{name} is too large")
    if not isinstance(got, kind) or kind is int and isinstance(got, bool):
        raise Bad(f"{name} has the wrong type")
    return got


def _strings(value: dict, name: str) -> list[str]:
    got = _typed(value, name, list, [])
    if not all(isinstance(x, str) for x in got):
        raise Bad(f"{name} must hold strings")
    return got


def _call(value) -> dict:
    """A tool call with its contract. What has the wrong type, null included, is an error: a guard that can't be read must not be passed over."""
    if not isinstance(value, dict):
        raise Bad("a tool call is an object")
    for k in ("name", "known", "args", "permitted", "required", "allow", "effects", "guards"):
        if k in value and value[k] is None:
            raise Bad(f"{k} has the wrong type")
    if value.get("name") is None:
        raise Bad("name is missing")
    args = _typed(value, "args", dict, {})
    spelt = [{"k": k, "v": v if isinstance(v, str) else flatten(v)} for k, v in args.items()]
    out = {k: _strings(value, k) for k in ("permitted", "required", "allow", "effects", "guards")}
    return out | {"args": spelt, "known": _typed(value, "known", bool, True), "user_confirmed": _typed(value, "user_confirmed", bool, False), "name": _typed(value, "name", str)}


def _policy(value: dict) -> dict:
    """What a policy line changes: fields that it doesn't name are null."""
    out = {"block_threshold": _typed(value, "block_threshold", str), "strict_data": _typed(value, "strict_data", bool)}
    out |= {k: _strings(value, k) if value.get(k) is not None else None for k in ("canaries", "allowed_hosts", "forbidden_effects")}
    try:
        Policy(canaries=tuple(out["canaries"] or ()), block_threshold=out["block_threshold"] or "high")
    except ValueError as e:
        raise Bad(str(e)) from None
    return out | {"block_threshold": out["block_threshold"] and out["block_threshold"].lower()}


def line(text: str) -> dict:
    """Fields of a line by its kind, with defaults; ``error`` where it can't be taken."""
    try:
        value = parse(text)
        if not isinstance(value, dict) or not isinstance(value.get("t"), str):
            raise Bad("a line is an object with a string t")
        t = value["t"]
        out = {"t": t, "ord": _typed(value, "ord", int)}
        if t not in KINDS:
            raise Bad(f"no such line: {t}")
        if t != "policy":
            out["session"] = _typed(value, "session", str)
            if out["session"] is None and t != "event":
                raise Bad("session is missing")
        if t == "policy":
            out |= _policy(value)
        elif t == "session_open":
            out |= {"root_pid": _typed(value, "root_pid", int, 0), "harness": _typed(value, "harness", str, "replay")}
        elif t == "span":
            out |= {"trust": _typed(value, "trust", str), "text": _typed(value, "text", str), "role": _typed(value, "role", str, "")}
            origin = _typed(value, "origin", dict)
            if out["trust"] not in ("system", "user", "data") or out["text"] is None or out["trust"] == "data" and origin is None:
                raise Bad("a span needs a trust, a text and, if data, an origin")
            if out["trust"] == "data":
                out |= {"channel": _typed(origin, "channel", str, "unknown"), "ref": _typed(origin, "ref", str, "")}
        elif t == "event":
            for name in ("ts", "pid", "ppid", "flags", "dirfd", "port"):
                out[name] = _typed(value, name, int, _DEFAULTS.get(name))
            for name in ("kind", "comm", "cmdline", "filename", "addr"):
                out[name] = _typed(value, name, str, _DEFAULTS.get(name))
            if out["kind"] not in EVENT_KINDS or out["pid"] is None:
                raise Bad("an event needs a known kind and a pid")
        elif t == "tool_call":
            out |= _call(value)
        elif t == "reply":
            out |= {"text": _typed(value, "text", str), "tool_calls": [_call(x) for x in _typed(value, "tool_calls", list, [])]}
            if out["text"] is None:
                raise Bad("a reply needs a text")
        return out
    except Bad as e:
        return {"error": str(e)}


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (its place in ``paths``), path, lineno and raw (bytes, without line ends) of all lines of text files.

    Files are read in blocks, a task each; a count for each block tells where its lines begin.
    """
    rows = None
    for i, path in enumerate(paths):
        one = spark.read.option("lineSep", "\n").text(path)
        one = one.select(F.lit(i).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw"))
        rows = one if rows is None else rows.unionByName(one)
    blocks = rows.groupBy("file", "path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "path", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(blocks, ["file", "path", "block"]).select("file", "path", (F.col("id") + F.col("shift")).cast("long").alias("lineno"), "raw")


def read_lines(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """All lines of JSONL files: file (its place in ``paths``), lineno, raw and the fields of ``LINE``.

    Blank lines are left out, a trailing CR too; a line without ``ord`` takes its number. Wrong lines have an
    ``error`` and no fields, whatever their bytes; with ``strict`` the first of them ends the query, with file and number.
    """
    schema = T.StructType.fromDDL(LINE)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = {k: [] for k in ("file", "lineno", "raw")}
            rows = []
            for file, number, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = content.decode("utf-8", "replace").removesuffix("\r")
                if not raw.strip():
                    continue
                fields = line(raw)
                if strict and "error" in fields:
                    raise Bad(f"{paths[file]}:{number}: {fields['error']}")
                if fields.get("ord") is None and "error" not in fields:
                    fields["ord"] = number
                rows.append(fields)
                for k, v in (("file", file), ("lineno", number), ("raw", raw)):
                    found[k].append(v)
            body = pa.Table.from_pylist(rows, schema=arrow) if rows else arrow.empty_table()
            head = [pa.array(found["file"], pa.int32()), pa.array(found["lineno"], pa.int64()), pa.array(found["raw"], pa.string())]
            names = ["file", "lineno", "raw", *arrow.names]
            yield pa.RecordBatch.from_arrays([*head, *(c.combine_chunks() for c in body.columns)], names)

    return numbered_lines(spark, paths).select("file", "lineno", "raw").mapInArrow(run, f"file int, lineno long, raw string, {LINE}")


def watched(lines: DataFrame, name: str = "lines") -> tuple[DataFrame, Observation]:
    """``lines`` with counts of received and of wrong ones, that are there once an action has run: the source is then closed."""
    seen = Observation(name)
    return lines.observe(seen, F.count("*").alias("received"), F.count_if(F.col("error").isNotNull()).alias("wrong")), seen


def program(lines: DataFrame) -> DataFrame:
    """Good lines in their order: (ord, file, lineno)."""
    return lines.where("error IS NULL").orderBy("ord", "file", "lineno")


def rejected(lines: DataFrame) -> DataFrame:
    return lines.where("error IS NOT NULL").select("file", "lineno", "raw", "error")


_PART = "array<struct<type:string,text:string>>"


def chat_spans(chats: DataFrame, messages: str = "messages", session: str = "session") -> DataFrame:
    """Spans of chat requests: content is a text or a list of text parts, trust follows the role, and data is
    named by its call or tool."""
    kind = "array<struct<role:string,content:string,tool_call_id:string,name:string>>"
    rows = chats.select(F.col(session).alias("session"), F.posexplode(F.from_json(F.col(messages), kind)).alias("ord", "m"))
    parts = F.from_json("m.content", _PART)
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    text = F.when(F.startswith(F.ltrim("m.content"), F.lit("[")) & parts.isNotNull(), joined).otherwise(F.col("m.content"))
    trust = trust_of(F.coalesce("m.role", F.lit("")))
    data = trust == "data"
    return rows.select("session", F.col("ord").cast("long").alias("ord"), F.col("m.role").alias("role"), trust.alias("trust"), F.when(data, F.lit("tool")).alias("channel"), F.when(data, F.coalesce("m.tool_call_id", "m.name", F.lit("unnamed"))).alias("ref"), F.coalesce(text, F.lit("")).alias("text"))


_REPLY = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>>"


def chat_replies(replies: DataFrame, body: str = "body", session: str = "session") -> tuple[DataFrame, DataFrame]:
    """What the first choice of chat replies says and calls: (session, text) and (session, idx, id, name, arguments).

    Arguments are a JSON text of their own; a body that is no reply says and calls nothing.
    """
    m = F.from_json(F.col(body), _REPLY)["choices"][0]["message"]
    rows = replies.select(F.col(session).alias("session"), m.alias("m")).where("m IS NOT NULL")
    calls = rows.select("session", F.posexplode("m.tool_calls").alias("idx", "c"))
    return rows.select("session", F.coalesce("m.content", F.lit("")).alias("text")), calls.select("session", "idx", "c.id", "c.function.name", F.coalesce("c.function.arguments", F.lit("{}")).alias("arguments"))


def hook_spans(hooks: DataFrame) -> DataFrame:
    """Spans of hook events (session_id, hook_event_name, tool_name, tool_input, tool_response, prompt, ord): a prompt is the
    user's, what a tool was given and answered is data of the tool; other events make none."""
    event = F.col("hook_event_name")
    one = lambda trust, text, part: F.struct(F.lit(trust).alias("trust"), text.alias("text"), F.lit(part).alias("part"))
    made = F.when(event == "UserPromptSubmit", F.array(one("user", F.col("prompt"), 0))).when(event == "PostToolUse", F.array(one("data", F.col("tool_response"), 0), one("data", F.col("tool_input"), 1)))
    rows = hooks.select(F.col("session_id").alias("session"), "ord", "tool_name", F.explode(made).alias("s")).where("s.text IS NOT NULL")
    data = F.col("s.trust") == "data"
    return rows.select("session", (F.col("ord") * 2 + F.col("s.part")).alias("ord"), F.lit("").alias("role"), F.col("s.trust").alias("trust"), F.when(data, F.lit("tool")).alias("channel"), F.when(data, F.col("tool_name")).alias("ref"), F.col("s.text").alias("text"))


def hook_status(event: Column, session: Column) -> Column:
    """``ok``, or why a hook event is refused."""
    return F.when(event.isNull(), "no event").when(F.coalesce(session, F.lit("")) == "", "no session").when(~event.isin("SessionStart", "UserPromptSubmit", "PreToolUse", "PostToolUse"), "unknown event").otherwise("ok")


def wire_messages(blocks: DataFrame) -> DataFrame:
    """Role messages from content blocks (msg, pos, role, type, text, id, name, input): results of tools come before
    the text of their message, calls after it."""
    kind = F.when(F.col("type") == "tool_result", 0).when(F.col("type") == "text", 1).when(F.col("type") == "tool_use", 2)
    rows = blocks.withColumn("class", kind).where("class IS NOT NULL")
    role = F.when(F.col("class") == 0, "tool").otherwise(F.col("role"))
    text = F.when(F.col("class") == 2, F.concat("name", F.lit(" "), F.coalesce("input", F.lit("{}")))).otherwise(F.col("text"))
    return rows.select("msg", "class", "pos", role.alias("role"), F.when(F.col("class") != 1, F.col("id")).alias("tool_call_id"), text.alias("text")).orderBy("msg", "class", "pos")
