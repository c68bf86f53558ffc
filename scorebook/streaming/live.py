"""Live operators on Structured Streaming.  State is keyed, so partitions work independently; versions decide, not arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import measures as M
from ..operators.changes import changed_rows, latest_state
from ..operators.core import latest_per_key


def watch_versions(stream: DataFrame, key: str, version: str, key_type: str = "long", version_type: str = "string") -> DataFrame:
    """(key, version) whenever a key's version is above the last one seen; older versions are ignored."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = pd.concat([b[version] for b in batches]).dropna().drop_duplicates().sort_values()
        new = seen[seen > state.get[0]] if state.exists else seen
        if len(new):
            state.update((new.iloc[-1],))
            yield pd.DataFrame({key: k[0], version: new.to_numpy()})

    schema = f"{key} {key_type}, {version} {version_type}"
    return stream.select(key, version).groupBy(key).applyInPandasWithState(step, schema, f"last {version_type}", "append", GroupStateTimeout.NoTimeout)


def dedupe_ids(stream: DataFrame, event_id: str, ts: str, within: str = "24 hours") -> DataFrame:
    """The first event of each id within the period."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([event_id])


def debounce(stream: DataFrame, key: str, ts: str, quiet: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """One row for each burst of a key's events, when it was quiet long enough.

    Times count in milliseconds, as watermarks do.  An event ``quiet`` after the last one begins a burst; session windows that touch are
    one, so they are a millisecond short, and the watermark is as much behind.
    """
    w = F.session_window(ts, f"{quiet} -1 milliseconds")
    times = stream.withColumn(ts, F.timestamp_millis(F.unix_millis(ts))).withWatermark(ts, f"{delay} 1 milliseconds")
    due = F.timestamp_millis(F.unix_millis(F.col("session_window.end")) + 1)
    return times.groupBy(key, w).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("first"), due.alias("due"), "events")


def debounce_capped(stream: DataFrame, key: str, ts: str, quiet_s: int = 30, most_s: int = 120, key_type: str = "long", delay: str = "10 seconds") -> DataFrame:
    """Like ``debounce``, but a burst is given out ``most_s`` seconds after its first event at the latest."""

    quiet, most = quiet_s * 1000, most_s * 1000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], first, min(last + quiet, first + most), n))
            first, last, n = None, None, 0
        else:
            t = np.sort(np.concatenate([b[ts].to_numpy("datetime64[ms]").astype(np.int64) for b in batches]))
            gap = np.flatnonzero(np.diff(t) >= quiet) + 1  # events that come after a quiet time
            at = 0
            while at < len(t):  # one turn for each burst
                if first is None:
                    first, last, n = int(t[at]), int(t[at]), 0
                due = first + most
                if t[at] >= min(last + quiet, due):
                    out.append((k[0], first, min(last + quiet, due), n))
                    first = None
                    continue
                nth = int(np.searchsorted(gap, at, side="right"))
                end = min(int(np.searchsorted(t, due)), int(gap[nth]) if nth < len(gap) else len(t))
                last, n, at = int(t[end - 1]), n + end - at, end
        if first is None:
            state.remove()
        else:
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(min(last + quiet, first + most), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "first_ms", "due_ms", "events"])

    rows = stream.withWatermark(ts, delay).select(key, ts).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {key_type}, first_ms long, due_ms long, events long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_arrivals(stream: DataFrame, key: str, quiet_s: float = 30, most_s: float = 120, key_type: str = "long") -> DataFrame:
    """(key, events) for each burst of a key's rows by the time they arrive, so none is ever late: given out when the key was quiet for
    ``quiet_s`` seconds, or ``most_s`` seconds after its first row.  It waits by the clock, so run it with ``start_batches``, not through what is available."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (state.getCurrentProcessingTimeMs(), 0)
        n += sum(len(b) for b in batches)
        left = min(quiet_s * 1000, first + most_s * 1000 - state.getCurrentProcessingTimeMs())
        if state.hasTimedOut or left <= 0:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "events": [n]})
        else:
            state.update((first, n))
            state.setTimeoutDuration(max(1, int(left)))

    return stream.select(key).groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, events long", "first long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def feed_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Finished plays (complete, with a description) of the newer snapshot that are new or changed."""
    done = F.col("is_complete") & (F.coalesce(F.length("description"), F.lit(0)) > 0)
    return changed_rows(previous.filter(done), following.filter(done), ["game_pk", "at_bat_index"])


def changes_over_versions(plays: DataFrame, version: str, keys: list[str]) -> DataFrame:
    """Of all versions of plays, those rows that differ from the version before."""
    rest = [c for c in plays.columns if c not in (*keys, version)]
    w = Window.partitionBy(*keys).orderBy(version)
    now = F.struct(*rest)
    return plays.withColumns({"_before": F.lag(now).over(w), "_first": F.row_number().over(w) == 1}).filter(F.col("_first") | ~now.eqNullSafe(F.col("_before"))).drop("_before", "_first")


def latest(stream: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Latest message of each key; on a stream, run it in complete or update mode."""
    return latest_state(stream, keys, seq)


def pending_plays(log: DataFrame, rendered: Column, seq: str) -> DataFrame:
    """Last write of each play beyond the last rendered index, newest first."""
    later = log.filter(F.col("at_bat_index") > rendered)
    return latest_per_key(later, ["game_pk", "at_bat_index"], [F.col(seq).desc()]).orderBy("game_pk", F.col("at_bat_index").desc())


def game_states(parsed: DataFrame) -> DataFrame:
    """One row for each document: status, whether it is completed, shown score, inning and line score of its game."""
    status, line = "g.gameData.status", "g.liveData.linescore"
    state = M.game_status(F.col(f"{status}.codedGameState"), F.col(f"{status}.abstractGameState"))
    score = lambda s: M.shown_score(state, F.col(f"{line}.teams.{s}.runs")).alias(f"{s}_score")
    return parsed.select("game_pk", "feed_ts", state.alias("status"), M.completed(f"{status}.codedGameState").alias("completed"), score("away"), score("home"), F.col(f"{line}.currentInning").alias("inning"), F.lower(f"{line}.inningHalf").alias("inning_half"), F.col(f"{line}.outs").alias("outs"), F.col(f"{line}.innings").alias("innings"))


def state_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """States of games that are new or differ from the version before, whatever their time stamps."""
    return changed_rows(previous.drop("feed_ts"), following.drop("feed_ts"), ["game_pk"])


def current_runs(state: Column, latest_play: Column) -> Column:
    """The larger of what the state and the latest play say; what is missing counts 0."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(state, zero), F.coalesce(latest_play, zero))


def scoring_alerts(states: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Which side's runs (see ``current_runs``) rose since the state before; the away side is looked at first."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rose = lambda s: F.col(f"{s}_runs") > F.lag(f"{s}_runs").over(w)
    return states.withColumn("scored", F.when(rose("away"), "away").when(rose("home"), "home")).filter("scored IS NOT NULL")


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs all available input through ``work`` batch by batch: derive, replace by key, refresh the touched days, and
    rebuild seasons with final games.  The checkpoint makes it restartable; ``work`` must be repeatable."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """The same for a stream that goes on until it is stopped."""
    return stream.writeStream.foreachBatch(work).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
