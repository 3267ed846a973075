"""What tool calls may do: arguments, effects, guards.

A call has call_id, session, ord, name, known, user_confirmed, tainted; its contract is permitted, required, allow ("key:value"),
effects and guards, as arrays; its arguments are an array of (k, v) in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_ascii
from ..policy import Policy, Rules, rules
from .findings import finding, union

#: Tools that carry data out, how such names begin, and what they contain.
EGRESS_TOOLS = ("send_email", "send_mail", "send_message", "send_sms", "send_dm", "post_message", "post_comment", "slack_post", "create_issue", "create_pr", "upload_file", "publish", "webhook", "http_request", "fetch_url", "webfetch", "websearch", "web_fetch", "web_search", "email", "mail", "smtp", "telegram_send", "slack_send")
EGRESS_PREFIXES = ("send_", "post_", "publish_", "upload_", "webhook_")
EGRESS_PARTS = ("email", "webhook")


def is_egress(name: Column) -> Column:
    low = lower_ascii(F.substring(name, 1, 127))
    tests = [low.isin(*EGRESS_TOOLS), *(F.startswith(low, F.lit(p)) for p in EGRESS_PREFIXES), *(F.contains(low, F.lit(p)) for p in EGRESS_PARTS)]
    return reduce(lambda a, b: a | b, tests)


def keys(args: Column) -> Column:
    return F.transform(args, lambda a: a["k"])


def missing(args: Column, required: Column) -> Column:
    return F.array_except(required, keys(args))


def unexpected(args: Column, permitted: Column) -> Column:
    """Keys that are not permitted, as often as they stand there."""
    return F.filter(keys(args), lambda k: ~F.array_contains(permitted, k))


def not_listed(args: Column, allow: Column) -> Column:
    """Entries of the allowlist that the last argument of their key doesn't equal; entries without a colon say nothing."""
    last = lambda key: F.element_at(F.transform(F.filter(args, lambda a: a["k"] == key), lambda a: a["v"]), -1)
    split = lambda s: (F.substring_index(s, ":", 1), F.substr(s, F.instr(s, ":") + 1))

    def broken(s: Column) -> Column:
        key, value = split(s)
        present = F.exists(args, lambda a: a["k"] == key)
        return F.contains(s, F.lit(":")) & (F.octet_length(key) < 64) & (~present | F.coalesce(F.when(present, last(key)) != value, F.lit(True)))

    return F.filter(allow, broken)


def authorise(calls: DataFrame, policy: Policy | Rules) -> DataFrame:
    """Findings of tool calls. An unknown tool is that alone."""
    known, forbidden = calls.where("known"), rules(policy).forbidden_effects
    each = lambda rows, c: rows.select("*", F.posexplode(c).alias("idx", "_x"))
    say = lambda rows, rule, evidence, idx=0: finding(rows, "toolauth", rule, "critical", True, evidence, idx)
    guard = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("guards", n) for n in names])
    return union([
        say(calls.where(~F.col("known")), "tool-unknown", F.col("name")),
        say(each(known, F.filter("effects", lambda e: F.array_contains(forbidden, e))), "tool-effect-forbidden", F.col("_x"), F.col("idx")),
        say(each(known, missing(F.col("args"), F.col("required"))), "tool-args-invalid", F.col("_x"), F.col("idx")),
        say(each(known, unexpected(F.col("args"), F.col("permitted"))), "tool-args-unexpected", F.col("_x"), F.col("idx")),
        say(known.where(guard("NO_UNTRUSTED_INFLUENCE", "no_untrusted_influence") & F.col("tainted")), "tainted-action", F.col("name")),
        say(known.where(guard("USER_CONFIRMED", "user_confirmed") & ~F.col("user_confirmed")), "tool-unconfirmed", F.col("name")),
        say(each(known, not_listed(F.col("args"), F.col("allow"))), "tool-args-not-allowlisted", F.col("_x"), F.col("idx")),
    ])
