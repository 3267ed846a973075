"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

What an edit costs depends on a row's role and fault alone, so a conversation is a short word over nine letters, its
signature. Distinct signatures are sorted; sorted words are a prefix trie, depth first: what two neighbours share
is a path of the trie, whose layers of the dynamic program stay on a stack and are made once. Answers are read at the ends of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .components import shared_folder

#: The costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of a signature: a row that must go; roles by initial (o: any other), in capitals where the row is truncated.
GOES, ROLES = "x", "suao"
_BLANK = "\x20\x09-\x0d"
#: States: nothing said, the system said, the user said, the assistant said. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
_SAYS = {START: (("u", USER),), SYSTEM: (("u", USER),), USER: (("a", ASSISTANT),), ASSISTANT: (("u", USER),)}
SALTS = 16

# A path is (depth, edit, path before); equal paths are the same object, as each state of a layer has one.
_NONE: tuple = (0, "", None)


def _before(a: tuple, b: tuple) -> bool:
    """Whether path ``a`` spells a smaller text than ``b``. They are walked back only as far as they differ."""
    shorter = a[0] < b[0]
    while a[0] > b[0]:
        a = a[2]
    while b[0] > a[0]:
        b = b[2]
    while a is not b:
        shorter = a[1] < b[1] if a[1] != b[1] else shorter
        a, b = a[2], b[2]
    return shorter


def _offer(layer: list, state: int, cost: int, edit: str, path: tuple) -> bool:
    """Take an edit's path into a layer if it is cheaper than the state's, or as cheap and smaller."""
    held = layer[state]
    if held is not None and held[0] < cost:
        return False
    new = (path[0] + 1, edit, path)
    if held is not None and held[0] == cost and not _before(new, held[1]):
        return False
    layer[state] = (cost, new)
    return True


def _inserted(layer: list) -> list:
    """The layer after insertions, of which never more than three in a row pay."""
    for _ in range(3):
        moved = False
        for state, held in enumerate(list(layer)):
            if held is not None:
                for _, following in _SAYS[state]:
                    moved |= _offer(layer, following, held[0] + INSERT, "I", held[1])
        if not moved:
            break
    return layer


def first_layer() -> list:
    return _inserted([(0, _NONE), None, None, None])


def next_layer(layer: list, letter: str) -> list:
    """The layer after one more row."""
    out: list = [None] * 4
    more = TRUNCATED if letter.isupper() else 0
    role = letter.lower()
    for state, held in enumerate(layer):
        if held is None:
            continue
        cost, path = held
        _offer(out, state, cost + DELETE, "D", path)
        if letter == GOES:
            continue
        if state == START and role == "s":
            _offer(out, SYSTEM, cost + KEEP + more, "K", path)
        for said, following in _SAYS[state]:
            if role == said:
                _offer(out, following, cost + KEEP + more, "K", path)
            _offer(out, following, cost + REROLE + more, "R", path)
    return _inserted(out)


def answer(layer: list) -> tuple[int, str]:
    """Cost and edits of the cheapest repair that may end here."""
    best = None
    for state in _ENDS:
        held = layer[state]
        if held is not None and (best is None or held[0] < best[0] or held[0] == best[0] and _before(held[1], best[1])):
            best = held
    letters, path = [], best[1]
    while path[0]:
        letters.append(path[1])
        path = path[2]
    return best[0], "".join(reversed(letters))


def solve(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, edits) of sorted signatures. The stack holds the layers of the path to the latest one."""
    last, stack = "", [first_layer()]
    for word in signatures:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        del stack[shared + 1 :]
        for letter in word[shared:]:
            stack.append(next_layer(stack[-1], letter))
        last = word
        yield word, *answer(stack[-1])


def spoken(edits: str, letters: str) -> Iterator[tuple[str, str]]:
    """(edit, role) of each edit in order, the role '' where the row keeps its own or goes."""
    n, at, begins_with_system = 0, 0, False
    for edit in edits:
        role = ""
        if edit in "IR":
            role = "user" if (n - begins_with_system) % 2 == 0 else "assistant"
        elif edit == "K" and n == 0 and letters[at].lower() == "s":
            begins_with_system = True
        if edit != "D":
            n += 1
        if edit != "I":
            at += 1
        yield edit, role


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; null role or text: a blank) damaged by the checksum of conv_id:turn, with ``place`` that
    tells copies apart and ``gone`` for those that are dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("place"))


def _letter(role: Column, blank: Column, again: Column, cut: Column) -> Column:
    initial = F.substring(role, 1, 1)
    of_role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(blank | again, GOES).when(cut, F.upper(of_role)).otherwise(of_role)


_SIGNED = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, signature and counts of each conversation of rows (conv_id, turn, role, text, gone, place).

    Texts don't travel: a row's faults are told where it is read, and by the digest of what it says in which role
    it is known again. A conversation is walked row by row and never held.
    """
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    light = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("text"), "place", F.md5(said).alias("said"), "gone",
        (~F.col("text").rlike(f"[^{_BLANK}]")).alias("blank"),
        (~F.col("text").rlike(f"(?s)[.!?][{_BLANK}]*\\z")).alias("cut"),
    ).repartition("conv_id")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "place")]
    again = F.row_number().over(Window.partitionBy("conv_id", "said", "gone").orderBy(*order)) > 1
    light = light.withColumn("again", again)
    kind = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    light = light.select("conv_id", "turn", "role", "text", "place", "gone", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), _letter(F.col("role"), F.col("blank"), F.col("again"), F.col("cut")).alias("letter"))
    light = light.sortWithinPartitions("conv_id", *order)

    def walk(batches):
        key = now = None
        for batch in batches:
            out = []
            for conv, turn, gone, initial, kind_, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "kind", "letter")), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append(_signature(key, now))
                    key, now = conv, {"letters": [], "low": None, "high": None, "turns": 0, "kinds": [0] * 4, "illegal": 0, "initial": None}
                if gone:
                    continue
                if turn is not None and turn != now["high"]:
                    now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
                if now["initial"] is not None and now["initial"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["initial"] = initial
                now["kinds"][kind_] += 1
                now["letters"].append(letter)
            yield _batch(out, _SIGNED)
        if now is not None:
            yield _batch([_signature(key, now)], _SIGNED)

    return light.mapInArrow(walk, _SIGNED)


def _signature(conv, now: dict) -> tuple:
    gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
    return conv, "".join(now["letters"]), gaps, *now["kinds"][1:], now["illegal"]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of distinct signatures, by walks through the trie of sorted ones, a range of it in each task."""

    def walk(batches):
        words = (w for b in batches for w in b.column(0).to_pylist())
        rows: list[tuple] = []
        for found in solve(words):
            rows.append(found)
            if len(rows) == 4096:
                yield _batch(rows, "signature string, cost long, audit string")
                rows = []
        yield _batch(rows, "signature string, cost long, audit string")

    ranges = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return ranges.mapInArrow(walk, "signature string, cost long, audit string")


def repair(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id) with gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, of rows as from ``damaged``.

    Rows of a turn stand by role and text (its digest), copies after what they copy. Null ids are one conversation; null turns come
    first; a conversation without rows (all gone) has zeros and empty texts; no rows give no conversations.
    Other columns, whatever their names, are left alone. Digests are made as rows stream past: nothing holds a
    conversation but its letters. A conversation's rows meet in one task, as its digest runs over all of them.
    """
    shared_folder(rows.sparkSession)
    known = signed(rows).checkpoint()
    found = solved(known)
    # One signature may be that of most conversations: its answer is copied to several keys.
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    answers = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    answered = known.withColumn("_s", salt).join(answers, ["signature", "_s"]).drop("_s")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # A conversation's answer comes before its rows.
    none = lambda kind: F.lit(None).cast(kind)
    heads = answered.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("_d"), none("int").alias("place"), none("string").alias("text"), "signature", "audit", *columns)
    body = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), "turn", "role", F.md5("text").alias("_d"), "place", "text", none("string").alias("signature"), none("string").alias("audit"), *(none("long").alias(c) for c in columns))
    order = [F.col(c).asc_nulls_first() for c in ("part", "turn", "role", "_d", "place")]
    laid = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", *order)
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in columns) + ", audit string, repaired_sha256 string"

    def walk(batches):
        state = None
        for batch in batches:
            out = []
            names = ("conv_id", "part", "role", "text", "signature", "audit", *columns)
            for conv, part, role, text, signature, audit, *counts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if part == 0:
                    if state:
                        out.append(_end(state))
                    state = {"head": (conv, *counts, audit), "edits": spoken(audit, signature), "sha": hashlib.sha256(), "any": False}
                    continue
                for edit, given in state["edits"]:
                    if edit != "D":
                        _say(state, given or role, "" if edit == "I" else text)
                    if edit != "I":
                        break
            yield _batch(out, schema)
        if state:
            yield _batch([_end(state)], schema)

    return laid.mapInArrow(walk, schema)


def _say(state: dict, role: str, text: str) -> None:
    state["sha"].update(f"\n{role}:{text}".encode() if state["any"] else f"{role}:{text}".encode())
    state["any"] = True


def _end(state: dict) -> tuple:
    """The row of a conversation, after the insertions that follow its last row."""
    for _, given in state["edits"]:
        _say(state, given, "")
    return *state["head"], state["sha"].hexdigest()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged by rule and repaired."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair(damaged(rows))
