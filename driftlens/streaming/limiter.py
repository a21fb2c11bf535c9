"""Sliding-window request limiter: at most N accepted requests per client and window.

Rejected requests leave no trace, so each decision depends on earlier decisions and no frame
aggregate expresses it. The state is at most N timestamps per client.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(recent: list[int], now: int, window_ms: int, most: int) -> tuple[bool, int, list[int]]:
    """(accepted, seconds to wait, timestamps kept) for one request."""
    fresh = [t for t in recent if now - t < window_ms]
    if len(fresh) >= most:
        return False, max(1, math.ceil((window_ms - (now - fresh[0])) / 1000)), fresh
    return True, 0, [*fresh, now]


def limit_batch(requests: DataFrame, window_ms: int = 60_000, most: int = 5) -> DataFrame:
    """Decisions for a whole history. ``requests``: client, ts, request_id.

    Requests of one client in the same millisecond collapse to a count first. A quiet period of a whole
    window resets the limiter, so histories split there and a busy client spreads over tasks. Within a
    stretch, sorted rows stream through a task that remembers N timestamps.
    """
    stamped = requests.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    moments = stamped.groupBy("client", "ms").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("ms") / window_ms))
    cells = moments.groupBy("client", "cell").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    timeline = Window.partitionBy("client").orderBy("cell")
    quiet = F.coalesce(F.col("low") - F.lag("high").over(timeline) >= window_ms, F.lit(True))
    stretches = cells.withColumn("stretch", F.sum(quiet.cast("int")).over(timeline)).select("client", "cell", "stretch")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for batch in batches:
            rows = []
            for client, stretch, ms, n in batch[["client", "stretch", "ms", "n"]].itertuples(index=False):
                if (client, stretch) != current:
                    current, recent = (client, stretch), []
                granted, wait = 0, 0
                for _ in range(min(n, most + 1)):
                    ok, wait, recent = decide(recent, ms, window_ms, most)
                    granted += ok
                rows.append((client, ms, granted, wait))
            yield pd.DataFrame(rows, columns=["client", "ms", "granted", "wait"])

    decided = (
        moments.join(stretches, ["client", "cell"])
        .select("client", "stretch", "ms", "n")
        .repartition("client", "stretch")
        .sortWithinPartitions("client", "stretch", "ms")
        .mapInPandas(stream, "client string, ms long, granted int, wait int")
    )
    order = F.row_number().over(Window.partitionBy("client", "ms").orderBy("request_id"))
    early = stamped.withColumn("place", order).filter(F.col("place") <= most).select("client", "ms", "request_id", "place")
    accepted = (
        early.join(decided.filter("granted > 0").select("client", "ms", "granted"), ["client", "ms"])
        .filter(F.col("place") <= F.col("granted"))
        .select("client", "request_id", F.lit(True).alias("ok"))
    )
    return (
        stamped.join(decided.select("client", "ms", "wait"), ["client", "ms"])
        .join(accepted, ["client", "request_id"], "left")
        .select(
            "client", "request_id", F.coalesce("ok", F.lit(False)).alias("accepted"),
            F.when(F.col("ok").isNull(), F.col("wait")).otherwise(0).alias("retry_after_s"),
        )
    )


def limit_stream(requests: DataFrame, window_ms: int = 60_000, most: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """The same decisions on a stream. State holds N timestamps per client and expires in event time, one
    window after the client's last request; ``lateness`` is the watermark delay."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        arrived = pd.concat(list(batches)).sort_values(["ms", "request_id"])
        rows = []
        for request_id, ms in arrived[["request_id", "ms"]].itertuples(index=False):
            ok, wait, recent = decide(recent, ms, window_ms, most)
            rows.append((key[0], request_id, ok, wait))
        state.update((recent,))
        state.setTimeoutTimestamp(max(int(arrived["ms"].max()) + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["client", "request_id", "accepted", "retry_after_s"])

    timed = requests.select("client", "request_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    stamped = timed.withColumn("ms", F.unix_millis("ts"))
    return stamped.groupBy("client").applyInPandasWithState(
        step,
        outputStructType="client string, request_id long, accepted boolean, retry_after_s int",
        stateStructType="recent array<long>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
