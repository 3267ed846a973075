"""Readings of a text: what it says once disguises are undone, found breadth first within a budget.

All kernels work on bytes, as case, reversal and letters are meant bytewise. They run in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DECODE_DEPTH, INGRESS_VARIANTS, PRINTABLE, ROUNDS, RUN_LENGTH, RUNS, TEXT_BYTES, VARIANTS
from . import text as native

#: Greek and Cyrillic letters that look Latin, from Unicode's list of confusables.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "l", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u",
    "Ѕ": "S", "І": "l", "Ј": "J", "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ı": "i", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
}
_KEEP = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalnum())
_DROP = bytes(set(range(256)) - set(_KEEP))
_SEPARATORS = native.SEPARATORS.encode()
_UPPER = native.UPPER.encode() + native.LOWER.encode()
_ROT13 = bytes.maketrans(_UPPER, _UPPER[13:26] + _UPPER[:13] + _UPPER[39:] + _UPPER[26:39])
_PRINTED = bytes(range(32, 127)) + b"\n\r\t"
_UNSEEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f​-‍﻿‪-‮⁠⁦-⁩\U000e0000-\U000e007f]")
_RUN = re.compile(rb"[A-Za-z0-9+/=%%]{%d,}" % RUN_LENGTH)
_BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{2}[A-Za-z0-9+/=]{2})+")
_HEX = re.compile(rb"(?:[0-9A-Fa-f]{2})+")
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
_QUOTED = re.compile(rb"=([0-9A-Fa-f]{2})|=\n")
LONGEST_TARGET = 4


@cache
def folding() -> dict[int, str]:
    """Code points and the one to four ASCII letters or digits that they stand for: compatibility forms by
    rule, then the look-alikes above. ASCII itself and accented letters stay."""
    table = {}
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) <= LONGEST_TARGET and plain.isascii() and plain.isalnum():
            table[cp] = plain
    return table | {ord(c): to for c, to in LOOKALIKES.items()}


def fold(t: bytes) -> bytes:
    """Look-alikes as the letters that they imitate; bytes that are not UTF-8 stay."""
    return t if t.isascii() else t.decode("utf-8", "surrogateescape").translate(folding()).encode("utf-8", "surrogateescape")


def normalized(t: bytes) -> bytes:
    seen = _UNSEEN.sub("", t.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
    return seen if len(seen) > TEXT_BYTES else fold(seen)


def noiseless(t: bytes) -> bytes:
    return t.translate(None, _DROP)


def _readable(t: bytes) -> bytes | None:
    """A decoded text up to its first NUL, if enough of it can be printed."""
    t = t.partition(b"\0")[0]
    good = len(t) - len(t.translate(None, _PRINTED))
    return t if t and good / len(t) >= PRINTABLE else None


def _unbase64(t: bytes) -> bytes | None:
    if len(t) < RUN_LENGTH or not _BASE64.fullmatch(t):
        return None
    if b"=" not in t[:-2]:
        if t[-2:-1] == b"=" and t[-1:] != b"=":
            t = t[:-1] + b"="
        return _readable(base64.b64decode(t))
    # Padding inside: every four letters by themselves.
    parts = (q if b"=" not in q else q[:2] + b"==" if q[2:3] == b"=" else q for q in (t[i : i + 4] for i in range(0, len(t), 4)))
    return _readable(b"".join(map(base64.b64decode, parts)))


def peel(t: bytes) -> bytes | None:
    """One layer of base64, hex, percent or quoted-printable coding less; the first that applies."""
    if (out := _unbase64(t)) is not None:
        return out
    if len(t) >= RUN_LENGTH and _HEX.fullmatch(t) and (out := _readable(bytes.fromhex(t.decode()))) is not None:
        return out
    for sign, pattern in ((b"%", _PERCENT), (b"=", _QUOTED)):
        if sign in t:
            out = pattern.sub(lambda m: bytes((int(m[1], 16),)) if m[1] else b"", t).partition(b"\0")[0]
            if out != t:
                return out
    return None


def unwrap(t: bytes) -> tuple[bytes | None, int]:
    """All layers of coding less, and how many they were; None if there is none."""
    depth, now = 0, t
    if len(t) <= TEXT_BYTES:
        while depth < DECODE_DEPTH and (inner := peel(now)) is not None:
            now, depth = inner, depth + 1
    return (now if depth else None), depth


def embedded(t: bytes) -> list[bytes]:
    """Distinct texts that coded runs inside the text stand for, in order."""
    if len(t) > TEXT_BYTES:
        return []
    found = (inner for m in _RUN.finditer(t) if (inner := peel(m[0])) is not None)
    distinct: dict[bytes, None] = {}
    for inner in found:
        distinct.setdefault(inner)
        if len(distinct) == RUNS:
            break
    return list(distinct)


VIEWS = (
    normalized,
    lambda t: unwrap(t)[0],
    lambda t: b" ".join(embedded(t)),
    lambda t: t.translate(None, _SEPARATORS),
    noiseless,
    lambda t: t.translate(_ROT13),
    lambda t: t[::-1],
)


def walk(t: bytes, limit: int = VARIANTS):
    """Readings one by one: the text, then what each view makes of the latest ones, for four rounds."""
    seen, edge = {t}, [t]
    yield t
    for _ in range(ROUNDS):
        following = []
        for reading in edge:
            for view in VIEWS:
                if len(seen) >= limit:
                    return
                new = view(reading)
                if new and new not in seen:
                    seen.add(new)
                    following.append(new)
                    yield new
        edge = following


def readings(t: bytes, limit: int = VARIANTS) -> list[bytes]:
    return list(walk(t, limit))


def needle(canary: str) -> bytes:
    return noiseless(fold(canary.encode())).lower()


def finds(t: bytes, needles: list[bytes]) -> list[bool]:
    """Which needles (made by ``needle``) some reading contains; stops when all are found."""
    missing = {n for n in needles if n}
    hit = set()
    for reading in walk(t):
        if not missing:
            break
        plain = noiseless(reading).lower()
        hit |= {n for n in missing if n in plain}
        missing -= hit
    return [n in hit for n in needles]


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts as far as their first NUL."""
    return [(x or b"").partition(b"\0")[0] for x in column.cast(pa.binary()).to_pylist()]


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def closure_readings(c: pa.Array) -> pa.Array:
    """All readings of a text, the text itself first."""
    return pa.array([readings(t) for t in _bytes(c)], pa.list_(pa.binary()))


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def embedded_decodes(c: pa.Array) -> pa.Array:
    return pa.array([embedded(t) for t in _bytes(c)], pa.list_(pa.binary()))


@F.arrow_udf(T.StructType().add("text", T.BinaryType()).add("depth", T.IntegerType()))
def unwrapped(c: pa.Array) -> pa.Array:
    found = [unwrap(t) for t in _bytes(c)]
    return pa.array([{"text": t, "depth": d} for t, d in found], pa.struct([("text", pa.binary()), ("depth", pa.int32())]))


@F.arrow_udf(T.StringType())
def folded(c: pa.Array) -> pa.Array:
    return pa.array([normalized(t).decode("utf-8", "replace") for t in _bytes(c)], pa.string())


LOOK = "struct<large:boolean,plain:string,depth:int,coded:string,embedded:string,markers:array<string>,shaped:boolean,forged:boolean,errors:array<string>>"


def _digest(t: bytes) -> str:
    return hashlib.sha256(t).hexdigest()[:16]


def look(text: str, data: bool, nonce: str | None, layers: frozenset[str], words: tuple) -> dict:
    """What the inbound layers see of a text, evidence as digests. The readings are made once for all of them.

    A layer that raises is named in ``errors``: this text's trouble is its own, and no other's.
    """
    own, raw = text.encode(), text.encode().partition(b"\0")[0]
    out: dict = {"large": len(own) > TEXT_BYTES, "errors": []}
    seen: list[bytes] = []

    def normalize():
        if out["large"]:
            return
        if (plain := normalized(raw).decode("utf-8", "replace")) != text:
            out["plain"] = _digest(plain.encode())
        inner, depth = unwrap(raw)
        out["depth"] = depth
        if depth:
            out["coded"] = _digest(inner)
        elif found := embedded(raw):
            out["embedded"] = _digest(found[0])

    def ingress():
        if not data:
            return
        seen[:] = readings(raw, VARIANTS if nonce and "provenance" in layers else INGRESS_VARIANTS)
        lowered = [r.lower() for r in seen[:INGRESS_VARIANTS]]
        markers, person, imperatives, targets, mine = words
        out["markers"] = [m.decode() for r in lowered for m in markers if m.lower() in r]
        said = any(p in r for r in lowered for p in person)
        asked = any(any(x in r for x in imperatives) and any(x in r for x in targets) for r in lowered)
        out["shaped"] = said or asked and not any(x in own.lower() for x in mine)

    def provenance():
        wanted = noiseless((nonce or "").encode()).lower()
        if data and wanted:
            seen[:] = seen or readings(raw)
            out["forged"] = any(wanted in noiseless(r).lower() for r in seen)

    for layer in (normalize, ingress, provenance):
        if layer.__name__ in layers:
            try:
                layer()
            except Exception:  # noqa: BLE001 - whatever it is, it must show as a finding
                out["errors"].append(layer.__name__)
    return out


def looked(layers: tuple[str, ...], words: tuple, see=look):
    """A function of (text, data, nonce) in Arrow batches: ``see`` for each text."""
    wanted = frozenset(layers)

    @F.arrow_udf(LOOK)
    def run(c: pa.Array, data: pa.Array, nonce: pa.Array) -> pa.Array:
        rows = zip(c.to_pylist(), data.to_pylist(), nonce.to_pylist(), strict=True)
        kind = pa.struct([("large", pa.bool_()), ("plain", pa.string()), ("depth", pa.int32()), ("coded", pa.string()), ("embedded", pa.string()), ("markers", pa.list_(pa.string())), ("shaped", pa.bool_()), ("forged", pa.bool_()), ("errors", pa.list_(pa.string()))])
        return pa.array([see(t or "", bool(d), n, wanted, words) for t, d, n in rows], kind)

    return run


def plain_forms(c: Column) -> Column:
    """The letters and digits of a text, lowered, as they stand, in rot13, reversed, and both: native, and all
    among the readings. A needle found here needs no further search."""
    base = native.lower_ascii(native.strip_noise(c))
    return F.array(base, native.rot13(base), F.reverse(base), F.reverse(native.rot13(base)))


def shows(c: Column, n: bytes) -> Column:
    """Whether one of the native forms contains a needle."""
    return F.exists(plain_forms(c), lambda x: F.contains(x, F.lit(n.decode()))) if n else F.lit(False)


def with_canaries(df: DataFrame, canaries: tuple[str, ...] | Column, text: str = "text") -> DataFrame:
    """``df`` with ``hits``: the canaries that some reading of the text contains; null where the search raises.

    Texts that show all canaries natively skip Python's search by passing it an empty text.
    """
    if isinstance(canaries, Column):
        return df.withColumn("hits", canaries_in(F.coalesce(F.col(text), F.lit("")), canaries))
    needles = [needle(c) for c in canaries]
    if not needles:
        return df.withColumn("hits", F.array().cast("array<string>"))

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def search(c: pa.Array) -> pa.Array:
        return pa.array([_found(t, needles) for t in _bytes(c)], pa.list_(pa.bool_()))

    shown = F.array(*(shows(F.col(text), n) for n in needles))
    df = df.withColumn("_shown", shown)
    df = df.withColumn("_found", search(F.when(F.forall("_shown", lambda x: x), F.lit("")).otherwise(F.coalesce(F.col(text), F.lit("")))))
    named = F.transform(F.arrays_zip(F.array(*map(F.lit, canaries)).alias("c"), F.col("_shown"), F.col("_found")), lambda x: F.when(x["_shown"] | x["_found"], x["c"]))
    return df.withColumn("hits", F.when(F.col("_found").isNotNull(), F.filter(named, lambda x: x.isNotNull()))).drop("_shown", "_found")


def _found(t: bytes, needles: list[bytes], find=finds) -> list[bool] | None:
    """``finds``, or None where it raises."""
    try:
        return find(t, needles)
    except Exception:  # noqa: BLE001 - whatever it is, it must show as a finding
        return None


@F.arrow_udf(T.ArrayType(T.StringType()))
def canaries_in(c: pa.Array, canaries: pa.Array) -> pa.Array:
    """The canaries of a row's own list that some reading of its text contains; null where the search raises."""
    out: list[list[str] | None] = []
    needles: dict[str, bytes] = {}
    for t, own in zip(_bytes(c), canaries.to_pylist(), strict=True):
        hit = _found(t, [needles[x] if x in needles else needles.setdefault(x, needle(x)) for x in own or []])
        out.append(None if hit is None else [x for x, h in zip(own or [], hit, strict=True) if h])
    return pa.array(out, pa.list_(pa.string()))


def ingress_readings(t: bytes) -> list[bytes]:
    return list(islice(walk(t, INGRESS_VARIANTS), INGRESS_VARIANTS))
