"""Lineup confirmation: PENDING games become CONFIRMED or, at the cutoff, SKIPPED.

A game is confirmed by the first snapshot before the cutoff in which both sides have a
batting order. The cutoff lies 30 minutes before the day's first pitch. Confirmed and
skipped games never change again. The batch and the streaming form give the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.functions.text import numbered

CUTOFF_MINUTES = 30
OUTPUT = "game_pk string, state string, decided_us long"


def initial_states(schedule: DataFrame) -> DataFrame:
    """One PENDING row per scheduled game; an empty day gives none."""
    return schedule.select(F.col("game_pk").cast("string").alias("game_pk"), F.lit("PENDING").alias("state")).distinct()


def states_document(states: DataFrame, date: str, checked: str | None = None) -> DataFrame:
    """States of one day's games as a map document."""
    return states.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("game_pk", "state")))).alias("games")).select(
        F.lit(date).alias("date"), F.lit(checked).cast("string").alias("last_checked"), "games")


def cutoffs(schedule: DataFrame, day: str, start: str, minutes: int = CUTOFF_MINUTES) -> DataFrame:
    """Cutoff of every day: minutes before its first pitch."""
    return schedule.groupBy(day).agg((F.min(start) - F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("cutoff"))


def both_sides(home: str, away: str):
    """Whether both batting orders are non-empty; a missing order counts as empty."""
    return (F.coalesce(F.size(home), F.lit(0)) > 0) & (F.coalesce(F.size(away), F.lit(0)) > 0)


def resolve(games: DataFrame, snapshots: DataFrame, now, keys=("game_pk",)) -> DataFrame:
    """Batch form. games holds keys and cutoff; snapshots keys, ts and complete (boolean).

    now is a timestamp literal or column: games still pending at the cutoff are skipped
    only once it has passed.
    """
    keys = list(keys)
    d = snapshots.filter("complete").select(*keys, "ts").join(games, keys).filter(F.col("ts") < F.col("cutoff")).filter(F.col("ts") <= now)
    first = d.groupBy(*keys).agg(F.min("ts").alias("confirmed_at"))
    g = games.join(first, keys, "left")
    done = F.col("confirmed_at").isNotNull()
    state = F.when(done, "CONFIRMED").when(F.col("cutoff") <= now, "SKIPPED").otherwise("PENDING")
    return g.select(*keys, state.alias("state"),
                    F.when(done, F.col("confirmed_at")).when(F.col("cutoff") <= now, F.col("cutoff")).alias("decided_at"))


def day_counts(states: DataFrame, by=()) -> DataFrame:
    """Scheduled, confirmed, skipped and pending games; finished when none is pending."""
    c = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy(*by).agg(F.count(F.lit(1)).alias("scheduled"), c("CONFIRMED").alias("confirmed"),
                                   c("SKIPPED").alias("skipped"), (c("PENDING") == 0).alias("finished"))


def payload(confirmed: DataFrame) -> DataFrame:
    """Lineup documents: batting orders numbered from 1, with the probable starters."""
    return confirmed.select(
        "game_pk", "date", "confirmed_at", "home_team_id", "away_team_id",
        numbered(F.col("home_order"), "player_id").alias("home_lineup"),
        numbered(F.col("away_order"), "player_id").alias("away_lineup"), "home_pitcher_id", "away_pitcher_id")


def make_processor():
    """The state machine of one game; built on the executors' own pyspark. Times are microseconds, so no time zone enters."""
    from pyspark.sql.streaming import StatefulProcessor

    LONG = lambda name: T.StructType([T.StructField(name, T.LongType())])

    class LineupState(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.done = handle.getValueState("done", T.StructType([T.StructField("state", T.StringType())]))
            self.cutoff = handle.getValueState("cutoff", LONG("us"))

        def _schedule(self, us: int) -> None:
            self.cutoff.update((us,))
            self.handle.registerTimer(-(-us // 1000))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            """A game of the schedule waits for its cutoff before any snapshot of it comes."""
            self._schedule(int(initialState["cutoff_us"].min()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            best, seen = None, not self.done.exists()
            for pdf in rows:
                cuts = pdf["cutoff_us"].dropna()
                if seen and not self.cutoff.exists() and len(cuts):
                    self._schedule(int(cuts.min()))
                if seen and self.cutoff.exists():
                    ok = pdf[pdf["complete"].fillna(False).astype(bool) & (pdf["ts_us"] < self.cutoff.get()[0])]
                    if len(ok):
                        first = int(ok["ts_us"].min())
                        best = first if best is None else min(best, first)
            if best is not None:
                self.done.update(("CONFIRMED",))
                self.handle.deleteTimer(-(-self.cutoff.get()[0] // 1000))
                yield pd.DataFrame({"game_pk": [key[0]], "state": ["CONFIRMED"], "decided_us": [best]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.done.exists():
                self.done.update(("SKIPPED",))
                yield pd.DataFrame({"game_pk": [key[0]], "state": ["SKIPPED"], "decided_us": [self.cutoff.get()[0]]})

        def close(self):
            pass

    return LineupState()


def stream(snapshots: DataFrame, schedule: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """Streaming form. snapshots holds game_pk, ts and complete; schedule, a batch table, game_pk and cutoff.

    Every game of the schedule starts with a timer at its cutoff, so one that no snapshot ever mentions is decided as well, once the
    event time of any game has passed it. Games scheduled later join through rows of the stream that carry a cutoff (a column of
    snapshots if present; complete may be NULL there); snapshots of games nobody scheduled are ignored. Emits one row per game
    when it is decided. The cutoff fires on event time, so a late snapshot within the delay still confirms a game. A
    restart goes on from the checkpoint, where the schedule already is. Needs the RocksDB state store.
    """
    cut = F.unix_micros("cutoff") if "cutoff" in snapshots.columns else F.lit(None).cast("long")
    d = snapshots.withWatermark("ts", delay).select(
        F.col("game_pk").cast("string").alias("game_pk"), "ts", F.unix_micros("ts").alias("ts_us"), cut.alias("cutoff_us"), "complete")
    initial = None
    if schedule is not None:
        rows = schedule.filter("game_pk IS NOT NULL AND cutoff IS NOT NULL")
        initial = rows.groupBy(F.col("game_pk").cast("string").alias("game_pk")).agg(
            F.min(F.unix_micros("cutoff")).alias("cutoff_us")).groupBy("game_pk")
    out = d.groupBy("game_pk").transformWithStateInPandas(
        statefulProcessor=make_processor(), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime", initialState=initial)
    return out.select("game_pk", "state", F.timestamp_micros("decided_us").alias("decided_at"))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
