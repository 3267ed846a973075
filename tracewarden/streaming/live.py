"""Live counterparts: what depends on order is kept as state by key, everything else is the batch code itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns of a live row; ``ord`` is the arrival order within a key.
LIVE = "stream string, session string, ord long, t string, seq long, trust string, kind string, pid long, ppid long, ts long"


def frames(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of socket or Kafka frames, of which each may hold several."""
    return lines.select(F.explode(F.split(value, "\r?\n")).alias("line")).where("trim(line) <> ''")


def watch(spark: SparkSession, folder: str, schema: str = LIVE, fmt: str = "json") -> DataFrame:
    """A folder that records are landed in, as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def _in_order(frames_: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames_), ignore_index=True)
    return rows.sort_values("ord", kind="stable")


def fresh_only(rows: DataFrame) -> DataFrame:
    """Rows with ``duplicate``, by ``stream``: a positive seq that isn't over all that the stream has sent before.

    State is one number for each stream.
    """

    def step(key, frames_, state: GroupState):
        top = state.get[0] if state.exists else 0
        for pdf in [_in_order(frames_)]:
            flags = []
            for seq in pdf["seq"]:
                known = pd.notna(seq) and seq > 0
                flags.append(bool(known and seq <= top))
                if known and seq > top:
                    top = int(seq)
            state.update((top,))
            yield pdf.assign(duplicate=flags)

    return rows.groupBy("stream").applyInPandasWithState(step, f"{LIVE}, duplicate boolean", "top long", "append", GroupStateTimeout.NoTimeout)


def live_taint(rows: DataFrame) -> DataFrame:
    """Rows with ``tainted``, by session: a data span has come before or is this row. State is one bit, and never decays."""

    def step(key, frames_, state: GroupState):
        seen = bool(state.get[0]) if state.exists else False
        pdf = _in_order(frames_)
        marks = []
        for t, trust in zip(pdf["t"], pdf["trust"], strict=True):
            seen = seen or (t == "span" and trust == "data")
            marks.append(seen)
        state.update((seen,))
        yield pdf.assign(tainted=marks)

    return rows.groupBy("session").applyInPandasWithState(step, f"{LIVE}, tainted boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)


class _Members(StatefulProcessor):
    """Tracked processes of a session: their exec times by pid, so that a batch touches the pids that its rows name."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getMapState("since", "pid long", "ts long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows)
        held: dict[int, int | None] = {}
        changed, kept, spans = set(), [], []

        def since(pid: int) -> int | None:
            if pid not in held:
                held[pid] = self.since.getValue((pid,))[0] if self.since.containsKey((pid,)) else None
            return held[pid]

        for i, (t, kind, pid, ppid, ts) in enumerate(zip(*(pdf[c] for c in ("t", "kind", "pid", "ppid", "ts")), strict=True)):
            if pd.isna(pid):
                continue
            pid, ts = int(pid), 0 if pd.isna(ts) else int(ts)
            began = since(pid)
            joins = kind == "exec" and (began is not None or (pd.notna(ppid) and since(int(ppid)) is not None))
            if t == "session_open" or joins:
                held[pid] = ts
                changed.add(pid)
            if t != "session_open" and (joins or began is not None):
                kept.append(i)
                spans.append(max(0, ts - began) if kind == "exit" else 0)
                if kind == "exit":
                    held[pid] = None
                    changed.add(pid)
        for pid in changed:
            if held[pid] is not None:
                self.since.updateValue((pid,), (held[pid],))
            elif self.since.containsKey((pid,)):
                self.since.removeKey((pid,))
        if kept:
            yield pdf.iloc[kept].assign(duration=spans)

    def close(self) -> None:
        pass


def live_membership(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Process events of a session whose pid is tracked, with the time since its exec on exits (``duration``, else 0).

    The root opens the set, an exec by a child of a member joins it, an exit leaves it. State is an entry for each tracked pid, held
    in RocksDB, which the session is set to; it has no cap. With ``ttl_ms`` a pid is forgotten when no exec of it has come for so long
    in processing time. Rows without a pid are no one's; no time counts as 0.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("session").transformWithStateInPandas(_Members(ttl_ms), f"{LIVE}, duration long", "append", mode)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All rows that are there now, through the stream and into a table in memory: for tests and replays."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def land(stream: DataFrame, folder: str, checkpoint: str):
    """Append a stream to Parquet files exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
