"""Text functions as built-in expressions: every one stays in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that separate without meaning.
SEPARATORS = " \t\n\r-._|,:;*~'\"`"
#: Controls, zero-width and direction marks, word joiner, tags.
INVISIBLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\u200B-\\u200D\\uFEFF\\u202A-\\u202E\\u2060\\u2066-\\u2069\\x{E0000}-\\x{E007F}]"
#: Characters that a terminal would obey.
UNPRINTABLE = [*range(0, 9), *range(10, 32), *range(127, 160)]
#: Where a link in running text ends.
_LINK = "(?:https:|http:)?//[^\\s)\\]>\"'`]*"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    """Whether a text that is lowered already contains one of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n.lower())) for n in needles], F.lit(False))


def strip_noise(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def strip_separators(c: Column) -> Column:
    return F.translate(c, SEPARATORS, "")


def strip_invisibles(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def rot13(c: Column) -> Column:
    return F.translate(c, UPPER + LOWER, UPPER[13:] + UPPER[:13] + LOWER[13:] + LOWER[:13])


def digest(c: Column) -> Column:
    """What a finding says about its evidence: never the text itself."""
    return F.substring(F.sha2(c, 256), 1, 16)


def scrub(c: Column) -> Column:
    """Control characters spelt out; texts without one are passed through after a single test."""
    hit = c.rlike("[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x9F]")
    spelt = reduce(lambda x, b: F.replace(x, F.lit(chr(b)), F.lit(f"\\x{b:02x}")), UNPRINTABLE, c)
    return F.when(hit, spelt).otherwise(c)


def html_safe(c: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, scrub(c))


def links(c: Column) -> Column:
    """Links of a text in order, with or without a scheme."""
    return F.regexp_extract_all(c, F.lit(f"({_LINK})"), 1)


def link_host(link: Column) -> Column:
    """The lowered host of a link: without user, port, path or query. A bracketed address loses its bracket's end."""
    host = F.regexp_extract(link, "^(?:https:|http:)?//([^/?# )\\]>\"']*)", 1)
    host = F.regexp_replace(host, "^[^@]*@", "")
    return lower_ascii(F.when(F.startswith(host, F.lit("[")), host).otherwise(F.substring_index(host, ":", 1)))


def host_allowed(host: Column, allowed: tuple[str, ...] | Column) -> Column:
    """An entry is the host itself or, with a leading dot, an apex and all below it."""
    if isinstance(allowed, Column):
        return F.exists(allowed, lambda a: (host == a) | (F.startswith(a, F.lit(".")) & ((host == F.substring(a, 2, 1 << 30)) | F.endswith(host, a))))
    tests = [(host == a) | ((host == a[1:]) | F.endswith(host, F.lit(a)) if a.startswith(".") else F.lit(False)) for a in allowed]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def session_name(c: Column) -> Column:
    """A session id that is safe as a file name."""
    return F.when(F.coalesce(c, F.lit("")) == "", "nosession").otherwise(F.regexp_replace(c, "[^A-Za-z0-9_.@-]", "_"))


def is_nonce(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{16}$")


def clock(ms: Column) -> Column:
    return F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS")).otherwise("—")


def open_mode(flags: Column) -> Column:
    mode = F.when(flags.bitwiseAND(3) == 1, "w").when(flags.bitwiseAND(3) == 2, "rw").otherwise("r")
    return F.concat(mode, F.when(flags.bitwiseAND(64) != 0, "+").otherwise(""))


def event_detail(kind: Column, comm: Column, cmdline: Column, filename: Column, flags: Column, addr: Column, port: Column) -> Column:
    """One line about a process event."""
    peer = F.concat(addr, F.lit(":"), port.cast("string"))
    return (
        F.when(kind == "exec", scrub(F.coalesce(F.nullif(F.trim(cmdline), F.lit("")), filename)))
        .when(kind == "exit", F.concat(scrub(comm), F.lit(" exited")))
        .when(kind == "open", F.concat(F.lit("("), open_mode(flags), F.lit(") "), scrub(filename)))
        .when(kind == "net", F.concat(scrub(comm), F.lit(" → "), scrub(peer)))
    )


def counted(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, port and path prefix of an http or https address; the port is that of its scheme where none is given."""
    part = lambda k: F.regexp_extract(url, "^(https?)://([^/:]+)(?::([0-9]+))?(/.*)?$", k)
    port = F.when(part(3) != "", part(3)).when(part(1) == "https", "443").when(part(1) == "http", "80")
    return part(2), port.cast("int"), F.regexp_replace(part(4), "/+$", "")


def verifier_summary(log: Column) -> Column:
    """The last line of a verifier's log that begins with what it has processed; null without one."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit("(processed [^\n]*)"), 1), F.lit(-1))


def sensor_line(kind: Column, pid: Column, comm: Column, detail: Column) -> Column:
    """An event of the sensor as a line of its log."""
    return F.format_string("%-5s pid=%d comm=%s %s", kind, pid, comm, detail)
