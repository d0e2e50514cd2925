"""Stateful steps of the live loop, keyed by match."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchline.session import durable
from pitchline.streaming.feed import BucketedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOW_OUT = "match_key string, action string, event_id bigint"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that per-key state and timers need, for queries started inside."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def _earliest(best: tuple | None, rows: pd.DataFrame) -> tuple | None:
    """Smallest (ts, event_id) seen so far; chunks are reduced one by one."""
    if rows.empty:
        return best
    r = rows.sort_values(["ts", "event_id"]).iloc[0]
    found = (r["ts"], int(r["event_id"]))
    return found if best is None or found < best else best


class StatusGate:
    """Predict once per match, finalise once when it is completed; a match completed unseen is predicted first.

    A batch is cut down to one row per match before it meets the state, and
    only the state folders of its matches are read and written.  A finalised
    match leaves the state ``keep`` seconds of event time after its last row;
    rows older than that are not looked at.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 7 * 86_400, buckets: int = 32):
        self.spark, self.path, self.keep = spark, path, keep
        self.state = BucketedTable(spark, f"{path}/state", ["match_key"], buckets)
        self.clock = BucketedTable(spark, f"{path}/clock", ["name"], 1)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: match_key, status, event_id, ts."""
        status, at = F.lower("status"), F.struct("ts", "event_id")
        horizon = self._horizon(batch, batch_id)
        open_ = batch if horizon is None else batch.filter(F.coalesce(F.col("ts") >= F.lit(horizon), F.lit(True)))
        one = durable(open_.groupBy("match_key").agg(
            F.min(F.when(status.isin("upcoming", "live", "completed"), at)).alias("first"),
            F.min(F.when(status == "completed", at)).alias("last"), F.max("ts").alias("seen")).filter(F.col("first").isNotNull()))
        old = self.state.read(one)
        blank = {"o_predict": F.lit(None).cast(one.schema["first"].dataType), "o_final": F.lit(None).cast(one.schema["first"].dataType),
                 "o_seen": F.lit(None).cast("timestamp")}
        if old is None:
            met = one.withColumns(blank)
        else:  # what this batch itself wrote before a crash does not count
            earlier = lambda c: F.when(F.col(f"{c}_by") < batch_id, F.col(c)).alias(f"o_{c}")
            held = old.select(F.col("match_key").alias("_k"), earlier("predict"), earlier("final"), F.col("seen").alias("o_seen"),
                              *[F.col(f"{c}_by").alias(f"o_{c}_by") for c in ("predict", "final")])
            met = one.join(held, F.col("match_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        fresh = {"predict": F.col("o_predict").isNull(), "final": F.col("o_final").isNull() & F.col("last").isNotNull()}
        now = {"predict": F.col("first"), "final": F.col("last")}
        by = lambda c: F.when(fresh[c], F.lit(batch_id)).otherwise(F.col(f"o_{c}_by") if old is not None else F.lit(None)).cast("long")
        met = durable(met)
        out = met.select("match_key", F.explode(F.array(*[
            F.when(fresh[c], F.struct(F.lit(c).alias("action"), now[c].alias("at"))) for c in now])).alias("x")).filter("x IS NOT NULL")
        out.select("match_key", "x.action", "x.at.event_id", "x.at.ts").write.mode("overwrite").parquet(f"{self.path}/rows/at={batch_id}")
        rows = met.select("match_key", *[x for c in now for x in (
            F.coalesce(f"o_{c}", F.when(fresh[c], now[c])).alias(c), by(c).alias(f"{c}_by"))], F.greatest("seen", "o_seen").alias("seen"))
        over = None if horizon is None else F.col("final").isNotNull() & (F.col("seen") < F.lit(horizon))
        self.state.replace(rows, one, batch_id, over)

    def _horizon(self, batch: DataFrame, batch_id: int):
        """Event time up to which finalised matches are forgotten; it follows the newest row of the batches before this one."""
        old = self.clock.read()
        past = None if old is None else old.filter(F.col("batch") < batch_id).agg(F.max("high")).first()[0]
        high = batch.agg(F.max("ts")).first()[0]
        stamps = [t for t in (past, high) if t is not None]
        if stamps:
            rows = self.spark.createDataFrame([("clock", batch_id - 1, past), ("clock", batch_id, max(stamps))], "name string, batch long, high timestamp")
            self.clock.replace(rows, rows, batch_id)
        return None if past is None else past - timedelta(seconds=self.keep)

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop("at")


class TossWindow(StatefulProcessor):
    """Emit once when the toss is known inside the band before the start; else at the start, if known at all.

    One timer stands per match: at the start, moved when the start changes, and
    after the emission ``keep`` milliseconds later, when the state is dropped.
    """

    def __init__(self, lo: float, hi: float, keep: int):
        self.lo, self.hi, self.keep = lo, hi, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "done boolean")
        self.toss = handle.getValueState("toss", "ts timestamp, event_id bigint")

    def _timer(self, at: int) -> None:
        """The only timer of the match."""
        old = list(self.handle.listTimers())
        if old != [at]:
            for timer in old:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            yield pd.DataFrame([], columns=["match_key", "action", "event_id"])
            return
        inside = latest = newest = None
        for chunk in rows:
            known = chunk[chunk["toss_winner"].fillna("") != ""]
            inside = _earliest(inside, known[known["minutes"].between(self.lo, self.hi)])
            if not known.empty:
                r = known.sort_values(["ts", "event_id"]).iloc[-1]
                found = (r["ts"], int(r["event_id"]))
                latest = found if latest is None or found > latest else latest
            r = chunk.sort_values(["ts", "event_id"]).iloc[-1]  # the newest row names the start
            said = (r["ts"], int(r["event_id"]), int(r["start_ms"]))
            newest = said if newest is None or said > newest else newest
        out = []
        if inside is not None:
            self.done.update((True,))
            out.append((key[0], "in_window", inside[1]))
            self._timer(newest[2] + self.keep)
        else:
            if latest is not None and (not self.toss.exists() or latest > tuple(self.toss.get())):
                self.toss.update(latest)
            self._timer(newest[2])
        yield pd.DataFrame(out, columns=["match_key", "action", "event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.done.exists():
            self.done.clear()
        else:
            if self.toss.exists():
                out.append((key[0], "best_effort", int(self.toss.get()[1])))
            self.done.update((True,))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep)
        self.toss.clear()
        yield pd.DataFrame(out, columns=["match_key", "action", "event_id"])

    def close(self) -> None:
        pass


def toss_window(feed: DataFrame, lo: float, hi: float, delay: str = "0 seconds", keep: int = 86_400_000) -> DataFrame:
    """``feed``: match_key, ts, start_ts, toss_winner, event_id; the deadline is an event-time timer."""
    timed = feed.withWatermark("ts", delay).withColumns({
        "minutes": (F.unix_micros("start_ts") - F.unix_micros("ts")) / 60_000_000.0,
        "start_ms": F.unix_millis("start_ts"),
    })
    return timed.groupBy("match_key").transformWithStateInPandas(
        TossWindow(lo, hi, keep), WINDOW_OUT, outputMode="append", timeMode="EventTime")
