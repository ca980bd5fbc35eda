"""Streaming operators and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hold_last(events: DataFrame, key: str, within_s: int, late: str = "10 minutes") -> DataFrame:
    """The last quote at most `within_s` before a start, emitted once at the start; none if called off.

    events (a stream): key, ts timestamp, kind (quote, start, off), price double.  State per key is the
    last quote; it ends with the start or when it is called off, or after a day without events.
    """
    state = "ts double, price double, done boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        ts, price, done = held.get if held.exists else (None, None, False)
        rows = pd.concat(list(frames))
        # at one time an end comes before quotes, as in the batch form, and the highest quote last
        rows = rows.assign(_o=rows["kind"].map({"off": 0, "start": 1, "quote": 2})).sort_values(["ts", "_o", "price"])
        out: list[dict[str, Any]] = []
        for r in rows.itertuples(index=False):
            at = r.ts.timestamp()
            if done:
                continue
            if r.kind == "off":
                done = True
            elif r.kind == "start":
                done = True
                if ts is not None and at - within_s <= ts < at:
                    out.append({key: k[0], "start": r.ts, "price": price})
            elif ts is None or (at, float(r.price)) >= (ts, price):
                ts, price = at, float(r.price)
        held.update((ts, price, done))
        held.setTimeoutTimestamp(int((rows["ts"].max().timestamp() + 86_400) * 1000))
        if out:
            yield pd.DataFrame(out)

    kept = events.withWatermark("ts", late)
    return kept.groupBy(key).applyInPandasWithState(step, f"{key} long, start timestamp, price double", state, "append", GroupStateTimeout.EventTimeTimeout)


def hold_last_batch(events: DataFrame, key: str, within_s: int) -> DataFrame:
    """The same over a finished table: first start that isn't called off before, last quote before it."""
    ends = events.where("kind in ('start', 'off')").groupBy(key).agg(F.min_by(F.struct("kind", "ts"), F.struct("ts", "kind")).alias("e"))
    starts = ends.where("e.kind = 'start'").select(key, F.col("e.ts").alias("start"))
    quotes = events.where("kind = 'quote'").select(F.col(key).alias("_k"), F.col("ts").alias("_ts"), "price")
    near = (F.col("_k") == F.col(key)) & (F.col("_ts") < F.col("start")) & (F.col("_ts") >= F.col("start") - F.expr(f"INTERVAL {within_s} SECONDS"))
    return starts.join(quotes, near).groupBy(key, "start").agg(F.max_by("price", F.struct("_ts", "price")).alias("price"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", streaming: bool = False) -> DataFrame:
    """Events and their value per window and type; the same plan for a stream and a table."""
    rows = events.withWatermark("ts", late) if streaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def on_change(states: DataFrame, key: str, order: list[str], signature: list[str]) -> DataFrame:
    """Rows whose signature differs from the row before: what a publisher that writes only on change writes."""
    from pyspark.sql import Window as W

    s = F.sha2(F.to_json(F.struct(*signature)), 256)
    w = W.partitionBy(key).orderBy(*order)
    return states.withColumn("_s", s).withColumn("_p", F.lag("_s").over(w)).where(~F.col("_s").eqNullSafe(F.col("_p"))).drop("_s", "_p")
