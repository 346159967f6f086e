"""Streams over several files: repeated batches, late corrections, chained windows, timers against the batch plan at several times."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import intraday as stream
from tidemark.streaming.merge import KeyedStore

T0 = dt.datetime(2024, 3, 4, 9, 30)


def bars(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), i, float(c), 10) for s, m, i, c in rows], "symbol string, ts timestamp, event_id long, close double, volume long")


def landed(spark, *files):
    folder = stream.new_folder(spark, "test")
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_store_merges_and_repeats_change_nothing(spark):
    store = KeyedStore(spark, stream.new_folder(spark, "store"), ["symbol", "ts"], "event_id", buckets=4)
    first, second = bars(spark, [("a", 0, 1, 10), ("a", 0, 2, 11), ("b", 0, 3, 20), ("a", 1, 4, 12)]), bars(spark, [("a", 0, 0, 99), ("c", 5, 6, 30)])
    assert store.version() == -1 and store.read(first.schema).count() == 0
    store.merge(first, 0)
    store.merge(second, 1)
    want = {("a", 0, 99.0, 0, 1), ("a", 1, 12.0, 0, 0), ("b", 0, 20.0, 0, 0), ("c", 5, 30.0, 1, 1)}  # the correction wins, though its number is older
    plain = lambda v=None: {(r.symbol, (r.ts - T0).seconds // 60, r.close, r.first_batch, r.batch) for r in store.read(version=v).collect()}
    assert plain() == want
    folders = store.folders()
    store.merge(second, 1)  # again, as after a lost commit
    store.merge(first, 0)
    assert store.folders() == folders and plain() == want
    assert plain(0) == {("a", 0, 11.0, 0, 0), ("a", 1, 12.0, 0, 0), ("b", 0, 20.0, 0, 0)}
    untouched = {b for b, f in folders.items() if "000000000000-" in f}
    store.merge(bars(spark, [("b", 0, 9, 21)]), 2)
    changed = {b for b in folders if store.folders()[b] != folders[b]}
    assert len(changed) == 1 and len(untouched - changed) + len(changed) >= 1
    assert store.vacuum() > 0 and {r.close for r in store.read().where("symbol = 'b'").collect()} == {21.0}
    store.merge(first.where("false"), 3)
    assert store.version() == 3 and store.read().count() == 4


def test_failed_attempt_leaves_no_trace(spark):
    store = KeyedStore(spark, stream.new_folder(spark, "store"), ["symbol", "ts"], "event_id")
    store.merge(bars(spark, [("a", 0, 1, 10)]), 0)
    bars(spark, [("a", 0, 2, 666)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/data/000000000001-dead")  # data without a manifest
    assert [r.close for r in store.read().collect()] == [10.0]
    store.merge(bars(spark, [("a", 0, 2, 11)]), 1)
    assert [r.close for r in store.read().collect()] == [11.0]


def test_messages_are_parsed_and_merged_batch_by_batch(spark):
    text = lambda k, s, c, ev="AM": f'{{"ev":"{ev}","sym":"{k}","s":{s},"c":{c},"n":1}}'
    rows = [(0, text("a", 60000, 1.0)), (0, text("b", 60000, 2.0)), (1, text("a", 120000, 3.0)), (1, text("a", 60000, 4.0)), (1, text("a", 60000, 9.0, "T")), (2, "broken"), (2, '{"ev":"AM","s":60000}'), (3, text("b", 60000, 5.0))]
    folder = stream.landed(spark.createDataFrame(rows, "part int, value string"), "part", 4)
    got = stream.ingest(stream.message_stream(spark, folder), ["symbol", "ts"], "trades")
    assert {(r.symbol, r.ts.minute, r.close, r.volume, r.first_batch, r.batch) for r in got.collect()} == {("a", 1, 4.0, 0, 0, 1), ("a", 2, 3.0, 0, 1, 1), ("b", 1, 5.0, 0, 0, 3)}


def test_chained_windows_equal_batch_and_count_the_late(spark):
    early = [("a", m, m, 10 + m % 7) for m in range(0, 4000, 13)] + [("b", m, 5000 + m, 20) for m in range(0, 3000, 500)]
    late = [("a", 5, 9001, 500.0), ("a", 6, 9002, 500.0), ("b", 3950, 9003, 1.0)]
    repeated = [early[0]]
    end = [("~", 20_000, 9999, 0)]
    s = landed(spark, bars(spark, early), bars(spark, [("a", 3995, 8000, 11)]), bars(spark, late), bars(spark, repeated), bars(spark, end))
    path = stream.new_folder(spark, "days")
    assert stream.drained_counting(stream.chained(s, "60 minutes"), path) == 3  # two late ones and the repeat of an old one
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume, r.n) for r in spark.read.parquet(path).where("symbol <> '~'").collect()}
    kept = bars(spark, [*early, ("a", 3995, 8000, 11), late[2]])
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in stream.roll_up(kept, "1 day").collect()}
    assert {k: v[:5] for k, v in got.items()} == want
    assert sum(v[5] for v in got.values()) == kept.count()


def test_timers_agree_with_the_batch_plan_at_several_times(spark):
    files = [[("a", 0, 1, 1), ("b", 0, 2, 1), ("c", 0, 3, 1)], [("a", 1, 4, 1)], [("a", 60, 5, 1)], [("d", 61, 6, 1)], [("b", 100, 7, 1), ("d", 130, 8, 1)], [("e", 131, 9, 1)], [("e", 400, 10, 1)], [("f", 401, 11, 1)]]
    told = stream.silences(landed(spark, *[bars(spark, f) for f in files])).collect()
    for k in (2, 4, 6, 7):  # timers of batch k go off by the time that the batches before it have reached
        now = max(m for f in files[:k] for _, m, *_ in f)
        seen = [x for f in files[: k + 1] for x in f]
        plan = {r.symbol: r.action for r in stream.reconnect_plan(bars(spark, seen), str(T0 + dt.timedelta(minutes=now))).collect()}
        state = {}
        for r in sorted((r for r in told if r.batch <= k), key=lambda r: (r.batch, r.at)):
            state[r.symbol] = "none" if r.kind == "reconnect" else r.kind
        last = {s: max(m for x, m, *_ in seen if x == s) for s, *_ in seen}
        for s, action in plan.items():
            if last[s] <= now and s not in {x for x, *_ in files[k]}:
                assert state.get(s, "none") == action, (k, s)
    gaps = {(r.symbol, r.minutes) for r in told if r.kind == "reconnect"}
    assert gaps == {("a", 59), ("b", 100), ("d", 69), ("e", 269)}
    source = bars(spark, [("a", 30, 50, 7), ("a", 0, 51, 7), ("b", 99, 52, 7), ("e", 200, 53, 7), ("z", 30, 54, 7)])
    silent = spark.createDataFrame(told)
    assert {(r.symbol, r.event_id) for r in stream.refill_after(silent, source).collect()} == {("a", 50), ("b", 52)}
