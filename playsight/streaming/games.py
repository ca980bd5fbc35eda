"""State per game over a stream of polls, and the batch form of the same."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that end a game, and how long a game may fail to start.
TERMINAL = ("final", "cancelled", "postponed")
NO_START_S = 3 * 3600


def game_states(polls: DataFrame, late: str = "10 minutes", no_start_s: int = NO_START_S) -> DataFrame:
    """(game, ts, status, anchor, polls, change): a row a poll that says something new, from polls (game, ts, kickoff, status, score, p).

    The anchor is the p of the first poll and never changes.  A poll is repeated unless status or score
    differ from the last one told.  After a terminal status, or where a game hasn't started `no_start_s`
    after its kickoff (told once, as "abandoned"), nothing more is told; the state goes a day later.
    """
    state = "anchor double, n int, status string, score string, done boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        anchor, n, status, score, done = held.get if held.exists else (None, 0, None, None, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "status", "score"])
        out: list[dict[str, Any]] = []
        for r in rows.itertuples(index=False):
            if done:
                continue
            n += 1
            anchor = float(r.p) if anchor is None else anchor
            now = r.status
            if now == "scheduled" and (r.ts - r.kickoff).total_seconds() > no_start_s:
                now = "abandoned"
            done = now in TERMINAL or now == "abandoned"
            if (now, r.score) != (status, score):
                out.append({"game": key[0], "ts": r.ts, "status": now, "anchor": anchor, "polls": n, "change": "status" if now != status else "score"})
                status, score = now, r.score
        held.update((anchor, n, status, score, done))
        held.setTimeoutTimestamp(int((rows["ts"].max().timestamp() + 86_400) * 1000))
        if out:
            yield pd.DataFrame(out)

    kept = polls.withWatermark("ts", late)
    return kept.groupBy("game").applyInPandasWithState(step, "game long, ts timestamp, status string, anchor double, polls int, change string", state, "append", GroupStateTimeout.EventTimeTimeout)


def game_states_batch(polls: DataFrame, no_start_s: int = NO_START_S) -> DataFrame:
    """The same over a finished table, by windows."""
    w = W.partitionBy("game").orderBy("ts", "status", "score")
    unborn = (F.col("status") == "scheduled") & (F.unix_seconds("ts") - F.unix_seconds("kickoff") > no_start_s)
    rows = polls.withColumn("now", F.when(unborn, F.lit("abandoned")).otherwise(F.col("status")))
    ended = F.max(F.col("now").isin(*TERMINAL, "abandoned").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("over", F.coalesce(ended, F.lit(0))).withColumn("anchor", F.first("p").over(w)).withColumn("polls", F.row_number().over(w))
    rows = rows.where("over = 0").withColumn("_s", F.lag("now").over(w)).withColumn("_c", F.lag("score").over(w))
    told = ~F.col("_s").eqNullSafe(F.col("now")) | ~F.col("_c").eqNullSafe(F.col("score"))
    change = F.when(F.col("_s").eqNullSafe(F.col("now")), "score").otherwise("status")
    return rows.where(told).select("game", "ts", F.col("now").alias("status"), "anchor", "polls", change.alias("change"))


def heartbeats(states: DataFrame, key: str, ts: str, signature: list[str], every_s: int = 120) -> DataFrame:
    """Rows that differ from the row before in `signature`, or come at least `every_s` after the last change's whole beats: what a publisher writes."""
    w = W.partitionBy(key).orderBy(ts)
    sign = F.sha2(F.to_json(F.struct(*signature)), 256)
    rows = states.withColumn("_s", sign).withColumn("_new", (~F.col("_s").eqNullSafe(F.lag("_s").over(w))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    inside = W.partitionBy(key, "_run").orderBy(ts)
    beat = F.floor((F.unix_seconds(ts) - F.unix_seconds(F.first(ts).over(inside))) / every_s)
    rows = rows.withColumn("_beat", beat)
    return rows.withColumn("_last", F.lag("_beat").over(inside)).where("_new = 1 or _beat <> _last").drop("_s", "_new", "_run", "_beat", "_last")


def once(stream: DataFrame, identity: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeated pulls of the same record, and without rows later than the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def in_time(rows: DataFrame, fetched: str, start: str, recorded: str, late: str = "10 minutes") -> DataFrame:
    """Rows written before the start and not later than `late` after they were fetched; the rest is dropped without a word."""
    return rows.where((F.col(fetched) < F.col(start)) & (F.col(recorded) < F.col(start)) & (F.col(recorded) <= F.col(fetched) + F.expr(f"INTERVAL {late}")))
