"""Requests as a stream: allowances per user and window, and the state of a service with a fallback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after a failure before the main service is asked again.
RECHECK_S = 60


def limited(log: DataFrame, allowance: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per user and window: requests, and how many were above the allowance. Works on a batch and on a stream."""
    counted = log.withWatermark("ts", late).groupBy("user_id", F.window("ts", window)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - allowance, F.lit(0)).alias("refused"))


def answer(down_since: float | None, t: float, main_ok: bool, backup_empty: bool) -> tuple[str, float | None]:
    """Who answers a call and since when the main service counts as down."""
    if down_since is not None and t - down_since < RECHECK_S:
        return ("slow" if backup_empty and main_ok else "backup"), down_since
    if main_ok:
        return "main", None
    return "backup", t


def failover(calls: DataFrame) -> DataFrame:
    """calls: service, ts, main_ok, backup_empty, call_id. One row per call: who answered it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "call_id"])
        out = []
        for r in rows.itertuples():
            who, down = answer(down, r.ts.timestamp(), bool(r.main_ok), bool(r.backup_empty))
            out.append((key[0], r.call_id, who))
        state.update((down,))
        yield pd.DataFrame(out, columns=["service", "call_id", "answered_by"])

    return calls.groupBy("service").applyInPandasWithState(run, "service string, call_id long, answered_by string", "down double", "append", GroupStateTimeout.NoTimeout)
