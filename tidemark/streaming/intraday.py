"""Minute bars as a stream: ingest with keyed upserts, per-symbol rolling features in state, roll-ups with watermarks; and the batch twin.

Features of a bar rest on that bar's own trailing window (at most 60 bars and the running day), in batch and stream alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder
from ..sources.ingest import parse_messages
from .merge import KeyedStore

ANNUAL = math.sqrt(252 * 390)
FEATURES = ("intraday_vwap", "intraday_rsi_14", "intraday_momentum_20", "intraday_volatility_20", "intraday_volume_ratio", "intraday_price_to_open", "intraday_range_position")


def features(bars: DataFrame) -> DataFrame:
    """T02-T08 in batch: bars (symbol, ts, event_id, close, volume[, vwap]) with the seven features, one shuffle by symbol and one by symbol and day."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    rows = lambda n, back=0: w.rowsBetween(-(n - 1) - back, -back)
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    b = bars if "vwap" in bars.columns else bars.withColumn("vwap", F.lit(None).cast("double"))
    before = F.lag("close").over(w)
    b = b.withColumn("step", F.col("close") - before).withColumn("ret", F.when(before > 0, F.col("close") / before - 1))
    up, down = F.sum(F.greatest("step", F.lit(0.0))).over(rows(14)), F.sum(F.greatest(-F.col("step"), F.lit(0.0))).over(rows(14))
    past, mean = F.lag("close", 20).over(w), F.avg("volume").over(rows(20, 1))
    traded = F.col("volume") > 0
    low, high, first = F.min("close").over(day), F.max("close").over(day), F.first("close").over(day)
    return b.select(
        "symbol", "ts", "event_id",
        F.coalesce("vwap", F.try_divide(F.sum(F.when(traded, F.col("close") * F.col("volume"))).over(rows(60)), F.sum(F.when(traded, F.col("volume"))).over(rows(60)))).alias("intraday_vwap"),
        F.when(F.count("step").over(rows(14)) == 14, F.when(down > 1e-12, 100 - 100 / (1 + up / down)).otherwise(100.0)).alias("intraday_rsi_14"),
        F.when(past > 0, F.col("close") / past - 1).alias("intraday_momentum_20"),
        F.when(F.count("ret").over(rows(20)) == 20, F.stddev_samp("ret").over(rows(20)) * ANNUAL).alias("intraday_volatility_20"),
        F.when(F.count("volume").over(rows(20, 1)) == 20, F.try_divide("volume", mean)).alias("intraday_volume_ratio"),
        F.when(first > 0, F.col("close") / first - 1).alias("intraday_price_to_open"),
        F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5).alias("intraday_range_position"),
    )


def of_bars(close: np.ndarray, volume: np.ndarray, back: int) -> dict[str, np.ndarray]:
    """The features of trailing windows at the bars after the first `back` (at most 60), all at once; NaN where a feature or an input is missing."""
    n, missing = len(close) - back, np.full(60 - back, np.nan)
    c, v = np.concatenate([missing, close]), np.concatenate([missing, volume])  # bar k stands at 60 + k
    last = lambda x, k, ago=0: np.lib.stride_tricks.sliding_window_view(x, k)[61 - k - ago :][:n]  # noqa: E731  the k values up to each bar, or up to the one before
    ratio = lambda a, b, fits: np.divide(a, b, out=np.full(n, np.nan), where=fits)
    now, past = c[60:], c[40:][:n]
    before = np.concatenate([[np.nan], c[:-1]])
    step, ret = c - before, np.divide(c, before, out=np.full(len(c), np.nan), where=before > 0) - 1
    amount, traded = np.where(v > 0, c * v, np.nan), np.where(v > 0, v, 0.0)
    known = ~np.isnan(amount)
    units = last(traded, 60).sum(axis=1)
    up, down = last(step.clip(min=0), 14).sum(axis=1), last((-step).clip(min=0), 14).sum(axis=1)
    mean = last(v, 20, 1).mean(axis=1)
    return {
        "intraday_vwap": ratio(last(np.where(known, amount, 0.0), 60).sum(axis=1), units, last(known, 60).any(axis=1) & (units != 0)),
        "intraday_rsi_14": np.where(np.isnan(down), np.nan, np.where(down > 1e-12, 100 - 100 / (1 + ratio(up, down, down > 1e-12)), 100.0)),
        "intraday_momentum_20": ratio(now, past, past > 0) - 1,
        "intraday_volatility_20": last(ret, 20).std(axis=1, ddof=1) * ANNUAL,
        "intraday_volume_ratio": ratio(v[60:], mean, mean != 0),
    }


def of_days(close: np.ndarray, days: np.ndarray, day: int, first: float, high: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The running open, high and low of each bar's day; the first day goes on from those given if it is `day`."""
    opens, highs, lows = np.empty(len(close)), np.empty(len(close)), np.empty(len(close))
    starts = np.flatnonzero(np.diff(days, prepend=days[0] - 1))
    for a, b in zip(starts, [*starts[1:], len(close)], strict=True):
        own = slice(a, b)
        goes_on = a == 0 and days[0] == day
        opens[own] = first if goes_on else close[a]
        highs[own], lows[own] = np.fmax.accumulate(close[own]), np.fmin.accumulate(close[own])
        if goes_on:
            highs[own], lows[own] = np.fmax(highs[own], high), np.fmin(lows[own], low)
    return opens, highs, lows


class RollingFeatures(StatefulProcessor):
    """Per symbol, a ring of 60 bars and the day's open, high and low; emits long rows, nulls skipped. A batch's bars are taken in arrays, CHUNK at a time."""

    CHUNK = 8192

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ring", "close array<double>, volume array<double>, day int, first double, high double, low double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        close, volume, *today = self.state.get() if self.state.exists() else ([], [], -1, 0.0, 0.0, 0.0)
        back, now = len(close), got["close"].to_numpy(float)
        ts, event, days = got["ts"].to_numpy(), got["event_id"].to_numpy(), got["ts"].to_numpy().astype("datetime64[D]").astype(int)
        close, volume = np.concatenate([np.array(close, float), now]), np.concatenate([np.array(volume, float), got["volume"].to_numpy(float)])
        first, high, low = of_days(now, days, *today)
        self.state.update((close[-60:].tolist(), volume[-60:].tolist(), int(days[-1]), float(first[-1]), float(high[-1]), float(low[-1])))
        for at in range(0, len(now), self.CHUNK):
            own, begin = slice(at, at + self.CHUNK), max(0, back + at - 60)
            x = of_bars(close[begin : back + at + self.CHUNK], volume[begin : back + at + self.CHUNK], back + at - begin)
            c, f, h, lo = now[own], first[own], high[own], low[own]
            x["intraday_price_to_open"] = np.divide(c, f, out=np.full(len(c), np.nan), where=f > 0) - 1
            x["intraday_range_position"] = np.divide(c - lo, h - lo, out=np.full(len(c), 0.5), where=h > lo)
            have = {name: np.flatnonzero(~np.isnan(x[name])) for name in FEATURES}
            rows_ = np.concatenate(list(have.values()))
            names = np.repeat(np.array(FEATURES, object), [len(i) for i in have.values()])
            yield pd.DataFrame({"symbol": np.full(len(rows_), key[0], object), "ts": ts[own][rows_], "event_id": event[own][rows_], "feature_name": names, "value": np.concatenate([x[n][i] for n, i in have.items()]), "version": np.full(len(rows_), "v1", object)})

    def close(self) -> None:
        pass


def stream_of(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Bar files as a stream, a few files a batch. `path` is a folder of files, or a single one (which a stream only takes by a pattern)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path}*")


def drained(stream: DataFrame, write, mode: str = "append") -> None:
    """Runs a stream over what is there; `write(batch, id)` gets each batch. The checkpoint is in the shared folder."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ingest(stream: DataFrame, keys: list[str], seq: str, buckets: int = 16) -> DataFrame:
    """Every batch merged into a keyed store as it comes: the last write of each key wins by arrival, whatever its event time.

    A batch that is run again, as after a failure between its merge and the stream's own commit, changes nothing.
    """
    store = KeyedStore(stream.sparkSession, new_folder(stream.sparkSession, "bars"), keys, seq, buckets)
    drained(stream, store.merge)
    return store.read(stream.schema.add("first_batch", "long").add("batch", "long"))


def landed(messages: DataFrame, part: str, parts: int) -> str:
    """Message texts in as many files as arrivals, one after another, as a feed would land them; `part` numbers them from 0. A folder for message_stream()."""
    folder = new_folder(messages.sparkSession, "messages")
    for k in range(parts):
        messages.where(F.col(part) == k).select("value").coalesce(1).write.mode("append").text(folder)
    return folder


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Minute bars of landed message files, one file a batch, parsed within the stream."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", 1).text(folder))


def stateful(stream: DataFrame) -> DataFrame:
    """T09 over a stream of (symbol, ts, event_id, close, volume): needs the RocksDB state store."""
    spark = stream.sparkSession
    path = new_folder(spark, "features")
    out = stream.groupBy("symbol").transformWithStateInPandas(RollingFeatures(), "symbol string, ts timestamp, event_id long, feature_name string, value double, version string", "Append", "None")
    with rocksdb(spark):
        drained(out, lambda df, i: df.write.mode("append").parquet(path))
    return spark.read.parquet(path)


def roll_up(bars: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Open, high, low, close and volume of tumbling windows, in batch or stream; `late` sets a watermark on a stream."""
    b = bars.withWatermark("ts", late) if late else bars
    g = b.groupBy("symbol", F.window("ts", width).alias("w"))
    order = F.struct("ts", "event_id")
    out = g.agg(F.min_by("close", order).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def chained(stream: DataFrame, late: str, ident: str = "event_id") -> DataFrame:
    """Minutes rolled up to hours and these to days in one stream, in append mode: (symbol, ts, open, high, low, close, volume, n) of closed days.

    stream: symbol, ts, event_id, close, volume. The watermark goes through all three windows. Rows that come after it are dropped by the first operator, which
    also drops repeats of an event, and whose progress counts them row by row (see drained_counting()).
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])
    at = F.struct("ts", ident)
    minute = once.groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    for width in ("1 hour", "1 day"):
        minute = minute.groupBy("symbol", F.window(F.window_time("w"), width).alias("w")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"), F.sum("n").alias("n")
        )
    return minute.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


def drained_counting(stream: DataFrame, path: str) -> int:
    """Runs an append stream into a folder; returns how many rows came too late for the watermark, by the progress of its first stateful operator."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    # operators are listed from the sink back
    return sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])


class Silence(StatefulProcessor):
    """T10 in the stream: per symbol, event-time timers at 2 minutes and beyond 120 minutes after its last bar; rows (symbol, last, at, kind, minutes).

    kind `refill` when the first timer goes off and `skip` when the second does; `reconnect` at the first bar after 2 minutes or more without one, with the
    minutes that were missed, whether a timer has told of them or not (a batch's rows are seen before the timers that it sets off). Bars that come out of
    order, before the last one, neither end a silence nor begin one.
    """

    REFILL, SKIP = 2 * 60_000, 120 * 60_000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(int(ts.value // 1_000_000) for r in rows for ts in r["ts"])
        last = newest = self.state.get()[0] if self.state.exists() else None
        out = []
        for at in times:
            if newest is not None and at - newest >= self.REFILL:
                out.append((key[0], newest, at, "reconnect", (at - newest) // 60_000))
            newest = at if newest is None else max(newest, at)
        if newest != last:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.state.update((newest,))
            self.handle.registerTimer(newest + self.REFILL)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (last,) = self.state.get()
        now, at, out = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs(), []
        if at - last < self.SKIP:
            out.append((key[0], last, at, "refill", (at - last) // 60_000))
            at = last + self.SKIP
        if at <= now:  # a timer that is set here would only go off a batch later
            out.append((key[0], last, at, "skip", (at - last) // 60_000))
        else:
            self.handle.registerTimer(at)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=["symbol", "last", "at", "kind", "minutes"])
        return d.assign(last=pd.to_datetime(d["last"].astype("int64"), unit="ms"), at=pd.to_datetime(d["at"].astype("int64"), unit="ms"), minutes=d["minutes"].astype("int64"))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that transformWithState needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def silences(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """T10 over a stream of (symbol, ts, ...): every silence and reconnection, with the number of the batch that told it, as far as the watermark came."""
    path = new_folder(stream.sparkSession, "silences")
    out = stream.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(Silence(), "symbol string, last timestamp, at timestamp, kind string, minutes long", "Append", "EventTime")
    with rocksdb(stream.sparkSession):
        drained(out, lambda df, i: df.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(path))
    return stream.sparkSession.read.parquet(path)


def refill_after(silent: DataFrame, source: DataFrame) -> DataFrame:
    """Bars of `source` (symbol, ts, ...) that fall into a silence which ended in a reconnection and may be refilled (2 to 120 minutes).

    One equi-join on symbol and hour: a silence of at most two hours touches three, so no symbol's bars meet all of its silences.
    """
    gaps = silent.where("kind = 'reconnect' and unix_millis(at) - unix_millis(last) between 120000 and 7200000").select("symbol", "last", "at")
    gaps = gaps.withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "last"), F.date_trunc("hour", "at"), F.expr("interval 1 hour"))))
    return source.withColumn("hour", F.date_trunc("hour", "ts")).join(gaps, ["symbol", "hour"]).where("ts > last and ts < at").drop("hour", "last", "at")


def reconnect_plan(bars: DataFrame, now: str) -> DataFrame:
    """Per symbol the minutes since its last bar: under 2 nothing, up to 120 a refill, beyond that skipped."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last"))
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.select("symbol", F.floor(seconds / 60).alias("minutes"), F.when(seconds < 120, "none").when(seconds <= 7200, "refill").otherwise("skip").alias("action"))
