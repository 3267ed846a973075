"""Process trees, attribution of events to sessions, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_ascii
from .ordered import numbered, running_max, shared_folder


def edges(events: DataFrame) -> DataFrame:
    """pid, ppid: the last parent that an exec of the pid named, 0 for none."""
    execs = events.where((F.col("kind") == "exec") & (F.col("ppid") != 0))
    return execs.groupBy("pid").agg(F.max_by("ppid", "ord").alias("ppid"))


def ancestry(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, pid, depth, path) of all processes below each seed (root), itself included at depth 0; ``path`` leads
    from the root's child to the process.

    Breadth first: each round joins only the processes found last and drops those known, so cycles and
    self-parents end. Rounds are as many as the tree is deep, whatever that is.
    """
    shared_folder(links.sparkSession)
    links = links.where("pid <> ppid").select(F.col("pid").alias("child"), "ppid").checkpoint()
    start = seeds.select(F.col("root"), F.col("root").alias("pid"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"))
    known = edge = start.distinct().checkpoint()
    most_parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = 0
    while not edge.isEmpty():
        depth += 1
        found = edge.join(links, edge["pid"] == links["ppid"]).select("root", F.col("child").alias("pid"), F.lit(depth).alias("depth"), F.array_append("path", F.col("child").cast("long")).alias("path"))
        found = found.groupBy("root", "pid", "depth").agg(F.min("path").alias("path"))
        edge = found.join(known.select("root", "pid"), ["root", "pid"], "left_anti").checkpoint()
        known = known.unionByName(edge).coalesce(most_parts).checkpoint()
    return known


def descendants(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, pid, depth) of ``ancestry``."""
    return ancestry(links, seeds).select("root", "pid", "depth")


def named_seeds(events: DataFrame, needle: str) -> DataFrame:
    """Processes with an exec whose name begins with the needle, as seeds (root) for where no root is known."""
    return events.where(F.col("kind") == "exec").where(name_matches(F.col("comm"), F.col("cmdline"), needle)).select(F.col("pid").alias("root")).distinct()


def only(events: DataFrame, kinds: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Events of the given kinds, all if none are given, without the excluded ones; unknown names do nothing."""
    rows = events.where(F.col("kind").isin(*kinds)) if kinds else events
    return rows.where(~F.col("kind").isin(*excluded)) if excluded else rows


def leaders(events: DataFrame) -> DataFrame:
    """Events without exits of threads (``tid`` other than ``pid``)."""
    return events.where((F.col("kind") != "exit") | (F.col("tid") == F.col("pid")))


def argv(args: Column) -> Column:
    """A command line from arguments: at most 40, each up to 255 characters, joined by blanks until over 256 are taken."""
    step = lambda s, a: F.when(F.length(s) > 256, s).otherwise(F.concat(s, F.when(s == "", "").otherwise(" "), F.substring(a, 1, 255)))
    return F.aggregate(F.slice(args, 1, 40), F.lit(""), step)


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is unknown or themselves."""
    parents = nodes.select(F.col("pid").alias("ppid"))
    top = nodes.join(parents, "ppid", "left_anti").unionByName(nodes.where("pid = ppid"))
    return top.select("pid", "ppid").distinct()


def forest(nodes: DataFrame) -> DataFrame:
    """pid, root, depth of every node; nodes on a cycle are roots of their own at depth 0."""
    return _forest(nodes).select("pid", "root", "depth")


def _forest(nodes: DataFrame) -> DataFrame:
    below = ancestry(nodes, roots(nodes).select(F.col("pid").alias("root")))
    loose = nodes.join(below, "pid", "left_anti").select("pid", F.col("pid").alias("root"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"))
    return below.select("pid", "root", "depth", "path").unionByName(loose)


def walk_order(nodes: DataFrame) -> DataFrame:
    """pid, depth and place (from 1) of every node as a walk in depth meets them: roots and children by pid."""
    rows = _forest(nodes).withColumn("way", F.concat(F.array(F.col("root").cast("long")), F.col("path")))
    return numbered(rows, [F.col("way")], "place").select("pid", "depth", "place")


def name_matches(comm: Column, cmdline: Column, needle: str) -> Column:
    """Whether the command, or the first word of its line without folders, begins with the needle, in either case."""
    base = F.regexp_extract(F.substring_index(F.coalesce(cmdline, F.lit("")), " ", 1), "[^/]*$", 0)
    low = needle.lower()[:16]
    return F.startswith(lower_ascii(F.coalesce(comm, F.lit(""))), F.lit(low)) | F.startswith(lower_ascii(base), F.lit(low))


_FIRST, _LAST = -(1 << 62), (1 << 62) + 1


def first_open(sessions: DataFrame, by: list[str]) -> DataFrame:
    """``by``, since, until, session: which session is the first that is open at a place; it holds for since < place <= until.

    ``sessions``: session, opened, closed (null: never). Of those of one ``by``, an earlier one comes before until it is closed.
    """
    ends = F.coalesce("closed", F.lit(_LAST))
    before = Window.partitionBy(*by).orderBy("opened", "session").rowsBetween(Window.unboundedPreceding, -1)
    rows = sessions.withColumn("since", F.greatest(F.col("opened"), F.max(ends).over(before))).withColumn("until", ends)
    return rows.where("since < until").select(*by, "since", "until", F.struct("opened", "session").alias("session"))


def _segments(changes: DataFrame, execs: DataFrame, labels: DataFrame, named: Column) -> DataFrame:
    """pid, since, until, up, best, named: what holds of a process for since < place <= until. ``up`` is its parent while it is in
    the tree, ``best`` the first open session that it is the root of, ``named`` whether its name is looked for.

    ``changes``: exec and exit rows that apply. A process is there from the start with the last parent and name that any of its
    ``execs`` gives; each exec gives its own, an exit takes it out until the next one. Every process that is named as
    a parent has segments for all places.
    """
    life = F.coalesce(F.sum(F.when(F.col("kind") == "exit", 1).otherwise(0)).over(Window.partitionBy("pid").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = lambda c, test: F.max_by(c, F.when(test, F.col("ord")))
    told = {"ppid": F.col("ppid") != 0, "comm": F.col("comm") != "", "cmdline": F.col("cmdline") != ""}
    start = execs.groupBy("pid").agg(*(last(c, test).alias(c) for c, test in told.items()))
    rows = changes.select("pid", "ord", "kind", "ppid", "comm", "cmdline").unionByName(start.select("pid", F.lit(_FIRST).alias("ord"), F.lit("exec").alias("kind"), F.coalesce("ppid", F.lit(0).cast("long")).alias("ppid"), "comm", "cmdline"))
    rows = rows.withColumn("_life", life)
    so_far = Window.partitionBy("pid", "_life").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("pid", "ord", "kind", *(F.last(F.when(test, F.col(c)), ignorenulls=True).over(so_far).alias(c) for c, test in told.items()))
    there = F.col("kind") == "exec"
    states = rows.select("pid", F.col("ord").alias("at"), F.struct(F.when(there & (F.col("ppid") != F.col("pid")), F.col("ppid")).alias("up"), (there & named).alias("named")).alias("tree"), F.lit(None).cast("struct<session:struct<opened:bigint,session:string>>").alias("label"))
    none = F.lit(None).cast("struct<up:bigint,named:boolean>")
    on = labels.select("pid", F.col("since").alias("at"), none.alias("tree"), F.struct("session").alias("label"))
    off = labels.select("pid", F.col("until").alias("at"), none.alias("tree"), F.struct(F.lit(None).cast("struct<opened:bigint,session:string>").alias("session")).alias("label"))
    # A label ends where another begins: the end is told first.
    marks = states.withColumn("_k", F.lit(1)).unionByName(off.withColumn("_k", F.lit(0))).unionByName(on.withColumn("_k", F.lit(2)))
    everyone = rows.select("pid").union(rows.select("ppid")).union(labels.select("pid")).where("pid IS NOT NULL").distinct()
    nothing = F.lit(None).cast("struct<session:struct<opened:bigint,session:string>>")
    marks = marks.unionByName(everyone.select("pid", F.lit(_FIRST - 1).alias("at"), none.alias("tree"), nothing.alias("label"), F.lit(0).alias("_k")))
    place = Window.partitionBy("pid").orderBy("at", "_k")
    until_now = place.rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.select("pid", F.col("at").alias("since"), "_k", F.last("tree", ignorenulls=True).over(until_now).alias("tree"), F.last("label", ignorenulls=True).over(until_now).alias("label"))
    # Of the marks of one place the last one counts, and of equal states in a row the first one.
    place = Window.partitionBy("pid").orderBy("since", "_k")
    rows = rows.select("*", F.lead("since").over(place).alias("_next")).where("_next IS NULL OR _next > since")
    state = F.struct(F.coalesce("tree.up", F.lit(0).cast("long")).alias("up"), F.col("label.session").alias("best"), F.coalesce("tree.named", F.lit(False)).alias("named"))
    rows = rows.select("pid", "since", state.alias("s")).withColumn("_same", F.col("s").eqNullSafe(F.lag("s").over(Window.partitionBy("pid").orderBy("since")))).where("NOT _same")
    rows = rows.select("pid", "since", F.coalesce(F.lead("since").over(Window.partitionBy("pid").orderBy("since")), F.lit(_LAST)).alias("until"), "s.*")
    return rows.withColumn("up", F.nullif("up", F.lit(0)))


def _climbed(segments: DataFrame) -> DataFrame:
    """``segments`` with the best session and whether a name was found anywhere above, by doubling: each round a segment takes what
    its parent's segments know of twice as many levels, in the places that both share. Chains end after log2(depth) rounds;
    what has not ended after log2(processes) + 1 is a cycle, and has been all round it."""
    rows = segments.checkpoint()
    rounds = (max(rows.select("pid").distinct().count(), 1)).bit_length() + 1
    for _ in range(rounds):
        open_ = rows.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = rows.select(F.col("pid").alias("up"), F.col("since").alias("_s"), F.col("until").alias("_u"), F.col("up").alias("_up"), F.col("best").alias("_b"), F.col("named").alias("_n"))
        met = open_.join(above, "up").where("_s < until AND since < _u")
        met = met.select("pid", F.greatest("since", "_s").alias("since"), F.least("until", "_u").alias("until"), F.col("_up").alias("up"), F.least("best", "_b").alias("best"), (F.col("named") | F.col("_n")).alias("named"))
        rows = rows.where("up IS NULL").unionByName(met).checkpoint()
    return rows


def _as_of(rows: DataFrame, spans: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` (``by``, ord) with ``value`` of the span (``by``, since, until) that holds at their place: the last one that begins before.

    Rows and spans are laid out in one order by ranges, so that a key with very many rows is in many tasks.
    """
    kind = "struct<" + ",".join(f"{c}:{k}" for c, k in spans.select(*by, "since", "until", value).dtypes) + ">"
    points = rows.withColumn("_span", F.lit(None).cast(kind)).withColumn("_k", F.lit(0))
    # A row at the place where a span begins still belongs to the one before.
    marks = spans.select(*by, F.col("since").alias("ord"), F.struct(*by, "since", "until", value).alias("_span"), F.lit(1).alias("_k"))
    both = points.unionByName(marks, allowMissingColumns=True)
    both = running_max(both, [F.col(c) for c in (*by, "ord", "_k")], {"_h": F.col("_span")}).where("_k = 0")
    holds = F.col("ord") <= F.col("_h.until")
    for c in by:
        holds = holds & (F.col(c) == F.col(f"_h.{c}"))
    return both.withColumn(value, F.when(holds, F.col(f"_h.{value}"))).drop("_span", "_k", "_h")


def attributed(events: DataFrame, sessions: DataFrame, needle: str = "") -> DataFrame:
    """``events`` (ord, session, kind, pid, ppid, comm, cmdline) with ``owner``: the session that the event names, else the first open one
    in whose tree the pid is at that place. Null: owned by none.

    ``sessions``: session, opened, closed, root. A session without a root (0) begins at the processes whose name begins with ``needle``. The
    tree is built from all execs at first; then each exec of an owned event gives the process its parent, and each
    exit takes it and all below it out. What nobody owns changes nothing, so events are attributed again until the events that count
    stay the same; at least one more place is settled by each round.
    """
    shared_folder(events.sparkSession)
    for c in ("comm", "cmdline"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(""))
    moves = events.where(F.col("kind").isin("exec", "exit")).select("ord", "session", "pid", F.coalesce("ppid", F.lit(0).cast("long")).alias("ppid"), "kind", F.coalesce("comm", F.lit("")).alias("comm"), F.coalesce("cmdline", F.lit("")).alias("cmdline")).checkpoint()
    named = name_matches(F.col("comm"), F.col("cmdline"), needle) if needle else F.lit(False)
    roots_ = first_open(sessions.where("root <> 0"), ["root"]).withColumnRenamed("root", "pid").checkpoint()
    loose = _open_without_root(sessions.where("root = 0")) if needle else None
    free = events.where("session IS NULL").select("ord", "pid", "kind").checkpoint()
    if free.isEmpty():
        return events.withColumn("owner", F.col("session"))
    given = moves.where("session IS NOT NULL")
    counted, state = moves, None
    while True:
        found = _as_of(free, _climbed(_segments(counted, moves.where("kind = 'exec'"), roots_, named)).select("pid", "since", "until", F.struct("best", "named").alias("_c")), ["pid"], "_c")
        found = found.select("ord", "kind", F.col("_c.best").alias("best"), F.coalesce("_c.named", F.lit(False)).alias("named"))
        if loose is not None:
            found = _as_of(found, loose, [], "loose")
            found = found.withColumn("best", F.least("best", F.when(F.col("named"), F.col("loose"))))
        found = found.select("ord", "kind", F.col("best.session").alias("_tree")).checkpoint()
        settled = found.where(F.col("kind").isin("exec", "exit") & F.col("_tree").isNotNull()).select("ord")
        following = settled.agg(F.count("*"), F.bit_xor(F.xxhash64("ord"))).first()
        if following == state:
            break
        state = following
        counted = given.unionByName(moves.join(settled, "ord", "left_semi"))
    return events.join(found.select("ord", "_tree"), "ord", "left").withColumn("owner", F.coalesce("session", "_tree")).drop("_tree")


def _open_without_root(sessions: DataFrame) -> DataFrame:
    """since, until, loose: the first open one of the sessions without a root, which share their trees."""
    rows = sessions.select("session", "opened", F.coalesce("closed", F.lit(_LAST)).alias("until"))
    rows = running_max(rows, [F.col("opened"), F.col("session")], {"_before": F.col("until")})
    return rows.withColumn("since", F.greatest("opened", "_before")).where("since < until").select("since", "until", F.struct("opened", "session").alias("loose"))


def durations(events: DataFrame) -> DataFrame:
    """Exits with the time since the latest exec of the pid after its last exit; 0 if there is none or it is later."""
    by = Window.partitionBy("pid").orderBy("ord")
    lives = F.sum(F.when(F.col("kind") == "exit", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.where(F.col("kind").isin("exec", "exit")).withColumn("_life", F.coalesce(lives, F.lit(0)))
    inside = Window.partitionBy("pid", "_life").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("kind") == "exec", F.col("ts")), ignorenulls=True).over(inside)
    rows = rows.withColumn("_start", start).where("kind = 'exit'")
    return rows.withColumn("duration", F.greatest(F.coalesce(F.col("ts") - F.col("_start"), F.lit(0)), F.lit(0))).drop("_start", "_life")


def nodes(events: DataFrame) -> DataFrame:
    """A row for each pid: last parent other than 0, last command, first and last time, events, whether it lives."""
    return events.groupBy("pid").agg(
        F.coalesce(F.max_by("ppid", F.when(F.col("ppid") != 0, F.col("ord"))), F.lit(0)).alias("ppid"),
        F.max_by("comm", F.when(F.coalesce("comm", F.lit("")) != "", F.col("ord"))).alias("comm"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("events"),
        (F.max_by("kind", "ord") != "exit").alias("alive"),
    )


def exit_status(status: Column) -> tuple[Column, Column]:
    """Exit code and signal of a wait status."""
    return F.shiftright(status, 8).bitwiseAND(255), status.bitwiseAND(127)


def rings(events: DataFrame, most: int) -> DataFrame:
    """For each session: events, those that its ring holds, and how many were overwritten."""
    counted = events.groupBy("session").agg(F.count("*").alias("events"))
    return counted.select("session", "events", F.least("events", F.lit(most)).alias("held"), F.greatest(F.col("events") - most, F.lit(0)).alias("drop_total"))
