"""Leases of agents as keyed streams: heartbeats extend a lease, silence ends it.

``lease_expiries`` reports every lease that ran out, once the watermark has passed its end; ``agent_leases`` keeps a status per agent and
counts a lease as expired when the next heartbeat comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRACE_MS = 30_000
OUT = "agent_id long, beats long, expired long, stale_after timestamp, state string, state_since timestamp"
STATE = "beats long, expired long, last timestamp, state string, since timestamp"


def lease_ms(interval_ms: int) -> int:
    """How long a lease lives: three heartbeats, thirty seconds at least."""
    return max(GRACE_MS, 3 * interval_ms)


def agent_leases(heartbeats: DataFrame, interval_ms: int = 20_000) -> DataFrame:
    """State of every agent over a stream of (agent_id, ts, state): beats, leases that ran out, time of the last change.

    Beats older than the last one seen of an agent count as late and change nothing but the count, so replays give
    equal states. Claims of jobs need one queue for all agents and are not modelled here.
    """
    life = pd.Timedelta(milliseconds=lease_ms(interval_ms))

    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beats, expired, last, now, since = state.get if state.exists else (0, 0, None, None, None)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for r in rows.itertuples():
            beats += 1
            if last is not None and r.ts < last:
                continue
            if last is not None and r.ts - last >= life:
                expired += 1
            if r.state != now:
                now, since = r.state, r.ts
            last = r.ts
        state.update((beats, expired, last, now, since))
        yield pd.DataFrame([(key[0], beats, expired, last + life, now, since)], columns=[c.split()[0] for c in OUT.split(", ")])

    return heartbeats.groupBy("agent_id").applyInPandasWithState(go, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


EXPIRY = "agent_id long, beats long, last_beat timestamp, expired_at timestamp"


def lease_expiries(heartbeats: DataFrame, interval_ms: int = 20_000, delay: str = "1 minute") -> DataFrame:
    """Leases that ran out over a stream of (agent_id, ts): beats, the last of them, and when the lease ended.

    A lease lives as long as ``lease_ms`` after its last heartbeat; it is a session of the agent that the watermark closes. Heartbeats may be late by
    ``delay`` and in any order; what is later still counts only while its own lease would be open, as an agent that lost its lease is not heard. Rows
    without an agent or a time are left out. The result does not depend on how rows are dealt to batches. A replay may hold many open leases, which
    the RocksDB state store (``rocksdb_state``) keeps on disk.
    """
    life = lease_ms(interval_ms)
    own = heartbeats.where("agent_id IS NOT NULL AND ts IS NOT NULL").selectExpr("CAST(agent_id AS bigint) AS agent_id", "timestamp_millis(unix_millis(CAST(ts AS timestamp))) AS ts").withWatermark("ts", delay)
    # Sessions that touch are one, leases are not.
    by = own.groupBy(F.session_window("ts", f"{life * 1000 - 1} microseconds").alias("lease"), "agent_id").agg(F.count("*").alias("beats"), F.max("ts").alias("last_beat"))
    return by.select("agent_id", "beats", "last_beat", F.timestamp_millis(F.unix_millis("last_beat") + life).alias("expired_at"))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The session with the state store on disk, and as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
