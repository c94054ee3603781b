"""Keyed state with bounds, times to live and timers: caches, token buckets and daily quotas over streams of calls.

Each works on a shard: calls are dealt to `shards` by their key, as they are to the processes of a service, and a shard holds
at most its part of the bound. Within a micro-batch a shard's rows are taken in the order of time and `tie`. All need
Spark's RocksDB state store (see use_rocksdb).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Origins and age (seconds) of cached rules; buckets, idle seconds and buckets looked at in a sweep.
MOST_ORIGINS, RULES_TTL = 256, 3600
MOST_BUCKETS, IDLE, SWEEP = 10_000, 300, 64


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Shard(StatefulProcessor):
    """A map of state for each shard, read once for a micro-batch and written back where it changed; a timer lets the whole
    shard go once nothing has come for `idle` seconds of event time."""

    key_schema, value_schema, idle = "key string", "a double, b double", 3600.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", self.key_schema, self.value_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["t", "tie"], kind="stable")
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        state = dict(sorted(before.items(), key=lambda x: x[1][-1]))  # in the order of the last number
        made = self.take(calls, state)
        for k in before.keys() - state.keys():
            self.held.removeKey((k,))
        for k, v in state.items():
            if before.get(k) != v:
                self.held.updateValue((k,), v)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((calls["t"].max() + self.idle) * 1000))
        yield made

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def take(self, calls: pd.DataFrame, state: dict) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RuleCache(_Shard):
    """origin -> (time of fetch, place in the order of insertion)."""

    def __init__(self, most: int, ttl: float):
        self.most, self.ttl, self.idle = most, ttl, ttl

    def take(self, calls, state):
        out, place = [], max((v[1] for v in state.values()), default=0.0)
        for tie, origin, t in zip(calls["tie"], calls["key"], calls["t"], strict=True):
            known = state.get(origin)
            hit, gone = known is not None and t - known[0] < self.ttl, None
            if not hit:
                if len(state) >= self.most:  # the oldest inserted goes, even if it is this one
                    gone = min(state, key=lambda k: state[k][1])
                    del state[gone]
                if origin in state:
                    state[origin] = (float(t), state[origin][1])
                else:
                    place += 1
                    state[origin] = (float(t), place)
            out.append((tie, origin, bool(hit), gone))
        return pd.DataFrame(out, columns=["tie", "key", "hit", "evicted"])


class Buckets(_Shard):
    """key -> (tokens left, last call); the last number orders the map by use."""

    def __init__(self, per_minute: float, burst: float, most: int):
        self.full, self.rate, self.most = float(per_minute + burst), per_minute / 60.0, most
        self.idle = max(IDLE, self.full / self.rate)

    def take(self, calls, state):
        out = []
        for tie, who, t in zip(calls["tie"], calls["key"], calls["t"], strict=True):
            left, last = state.pop(who, (self.full, float(t)))
            left = min(self.full, left + max(0.0, t - last) * self.rate)
            if len(state) >= self.most:
                self._sweep(state, t)
            while len(state) >= self.most:
                del state[next(iter(state))]  # the one not used for longest
            ok = left >= 1
            wait = 0 if ok else max(1, math.ceil((1 - left) / self.rate))
            state[who] = (left - ok, float(t))
            out.append((tie, who, ok, wait))
        return pd.DataFrame(out, columns=["tie", "key", "allowed", "retry_seconds"])

    def _sweep(self, state: dict, t: float) -> None:
        """Of the SWEEP least recently used buckets, those idle long enough to be full again go."""
        for who in list(state)[:SWEEP]:
            left, last = state[who]
            if t - last >= IDLE and left + (t - last) * self.rate >= self.full:
                del state[who]


class DailyQuota(_Shard):
    """key -> (calls served of the day, the day's number); the day rolls over with the first later call, earlier days are late."""

    def __init__(self, most: int):
        self.most, self.idle = most, 2 * 86400.0

    def take(self, calls, state):
        out = []
        for tie, who, t in zip(calls["tie"], calls["key"], calls["t"], strict=True):
            day = float(t // 86400)
            served, of = state.get(who, (0.0, day))
            late = day < of
            if day > of:
                served = 0.0
            ok = not late and served < self.most
            if not late:
                state[who] = (served + ok, day)
            out.append((tie, who, ok, late))
        return pd.DataFrame(out, columns=["tie", "key", "allowed", "late"])


def _run(calls: DataFrame, processor: _Shard, key: str, at: str, tie: str, shards: int, late: str, shape: str) -> DataFrame:
    use_rocksdb(calls.sparkSession)
    when = F.col(at).cast("timestamp")
    rows = calls.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), (F.unix_micros(when) / 1e6).alias("t"), when.alias("ts"))
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("shard").transformWithStateInPandas(processor, f"tie long, key string, {shape}", "Append", "EventTime")


def rule_cache_stream(calls: DataFrame, key: str = "origin", at: str = "ts", tie: str = "id", most: int = MOST_ORIGINS, ttl: float = RULES_TTL, shards: int = 8, late: str = "1 hour") -> DataFrame:
    """tie, key, hit and evicted for each look-up of an origin's rules: a hit if they were fetched less than ttl seconds ago.
    A miss fetches them; each shard holds at most most / shards origins, and the oldest inserted goes for a new one. Rows
    without a key or time are left out."""
    return _run(calls, RuleCache(max(1, most // shards), ttl), key, at, tie, shards, late, "hit boolean, evicted string")


def bounded_bucket_stream(calls: DataFrame, per_minute: float, burst: float, key: str = "user_id", at: str = "ts", tie: str = "event_id", most: int = MOST_BUCKETS, shards: int = 8, late: str = "1 hour") -> DataFrame:
    """tie, key, allowed and retry_seconds: the token bucket with a bound on keys. Full, idle buckets are swept first, then
    the least recently used one goes, and starts full when its key comes again."""
    return _run(calls, Buckets(per_minute, burst, max(1, most // shards)), key, at, tie, shards, late, "allowed boolean, retry_seconds long")


def client_quota_stream(calls: DataFrame, most: int, key: str = "user_id", at: str = "ts", tie: str = "event_id", shards: int = 8, late: str = "1 day") -> DataFrame:
    """tie, key, allowed and late: the first `most` calls of a client and UTC day are served. A row of a day that is already
    over for its client is late: not served, and not counted."""
    return _run(calls, DailyQuota(most), key, at, tie, shards, late, "allowed boolean, late boolean")


# --- a sink ---------------------------------------------------------------------------------------------------


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch as JSON lines in a folder of its own: written again after a failure, it replaces itself."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def append_usage(stream: DataFrame, path: str, checkpoint: str):
    """A started query that appends usage rows, each once, whatever batches are replayed: read `path` with Spark's JSON
    reader, which adds the column batch."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, batch_id, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
