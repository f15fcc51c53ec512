"""Streams in several batches: against batch results, with late rows inside and outside the delay, bounded state, and replayed batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapelab.sources.tables import load
from tapelab.streaming import incremental as inc
from tapelab.streaming.state import WHOLE_EVERY, WorkState, fold_stream

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted(map(str, df.collect()))


class Feed:
    """A folder that a stream reads: each call adds rows and runs the stream over them."""

    def __init__(self, spark, at, schema, build):
        self.spark, self.at, self.schema, self.build = spark, str(at), schema, build
        self.states = []

    def __call__(self, *values):
        self.spark.createDataFrame(list(values), self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        stream = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.at}/in"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        self.states.append([p["numRowsTotal"] for p in (q.lastProgress or {"stateOperators": []})["stateOperators"]])
        self.out_schema = stream.schema
        return self

    def out(self):
        return self.spark.read.schema(self.out_schema).parquet(f"{self.at}/out")


def test_stream_bars_equal_batch(spark, tmp_path):
    t = load(spark, SF, "ticks").select("ticker", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = inc.stream_bars(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), "1 hour", "15 minutes")
    out = inc.drain(stream, "bars_out", str(tmp_path / "ck"), "append")
    mark = t.agg(F.max("ts") - F.expr("interval 15 minutes")).first()[0]
    closed = inc.batch_bars(t, "1 hour").filter(F.col("start") + F.expr("interval 1 hour") <= F.lit(mark))
    assert rows(out) == rows(closed) and closed.count() > 100


def test_late_ticks_and_bounded_state(spark, tmp_path):
    at = lambda h, m=0: DAY + dt.timedelta(hours=h, minutes=m)
    feed = Feed(spark, tmp_path, "ticker long, ts timestamp, event_id long, price double", lambda s: inc.stream_bars(s, "1 hour", "15 minutes"))
    feed((1, at(0, 10), 1, 10.0), (1, at(0, 50), 2, 12.0), (2, at(0, 20), 3, 5.0))
    feed((1, at(1, 5), 4, 13.0), (1, at(0, 55), 5, 11.0))  # ten minutes late: counts
    feed((1, at(3, 0), 6, 14.0))
    feed((1, at(0, 58), 7, 99.0), (2, at(2, 50), 8, 6.0))  # two hours late: doesn't; ten minutes: does
    feed((1, at(30), 9, 15.0))
    got = {(r["ticker"], r["start"].hour): (r["open"], r["high"], r["low"], r["close"], r["transactions"]) for r in feed.out().collect()}
    assert got == {(1, 0): (10.0, 12.0, 10.0, 11.0, 3), (2, 0): (5.0, 5.0, 5.0, 5.0, 1), (1, 1): (13.0, 13.0, 13.0, 13.0, 1), (2, 2): (6.0, 6.0, 6.0, 6.0, 1), (1, 3): (14.0, 14.0, 14.0, 14.0, 1)}
    assert feed.states[0] == [2] and feed.states[-1] == [1]  # only the hour that is open


def test_duplicates_within_the_delay(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    feed = Feed(spark, tmp_path, "id long, published timestamp", lambda s: inc.stream_dedupe(s, "id", "published", "1 day"))
    feed(*((i, at(0)) for i in range(50)), (1, at(1)))
    feed((1, at(20)), (2, at(10)), (100, at(30)))
    feed((3, at(29)), (101, at(100)))
    feed((102, at(200)))
    assert sorted(r["id"] for r in feed.out().collect()) == sorted([*range(50), 100, 101, 102])
    assert feed.states[0] == [50] and feed.states[-1][0] <= 2


def test_trailing_days_equal_batch(spark, tmp_path):
    n = load(spark, SF, "news").select("ticker", "sentiment", F.col("published").cast("timestamp").alias("ts"))
    parts = [[tuple(r) for r in n.filter(F.dayofyear("ts") % 3 == k).orderBy("ts").limit(200).collect()] for k in range(3)]
    everything = sorted((r for p in parts for r in p), key=lambda r: r[2])
    feed = Feed(spark, tmp_path, "ticker long, sentiment int, ts timestamp", lambda s: inc.stream_trailing(s, "15 minutes"))
    third = len(everything) // 3
    for i in (0, third, 2 * third):
        feed(*everything[i : i + third if i < 2 * third else None])
    mark = everything[-1][2] - dt.timedelta(minutes=15)
    want = {}
    for ticker, sentiment, ts in everything:
        hour = ts.replace(minute=0, second=0, microsecond=0)
        for h in range(1, 25):
            want.setdefault((ticker, hour + dt.timedelta(hours=h)), []).append(sentiment)
    want = {k: (len(v), sum(v) / len(v)) for k, v in want.items() if k[1] <= mark}
    got = {(r["ticker"], r["at"]): (r["n_24h"], r["mean_24h"]) for r in feed.out().collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


RESULT = "key long, ok boolean, result string, error string, n long"


def batch(spark, *values):
    return spark.createDataFrame(list(values), RESULT)


def states(state):
    return {r["key"]: (r["status"], r["attempts"], r["result"], r["error"]) for r in state.read().collect()}


def test_work_state_retries(spark, tmp_path):
    s = WorkState(spark, str(tmp_path / "state"), most=3)
    assert states(s) == {}
    s.apply(batch(spark, (1, True, "80", None, 1), (2, False, None, "timeout", 2), (None, True, "x", None, 3), (3, False, None, "a", 4), (3, False, None, "b", 5), (3, False, None, "c", 6), (3, True, "9", None, 7)), 0, ["n"])
    assert states(s) == {1: ("done", 1, "80", None), 2: ("failed", 1, None, "timeout"), 3: ("failed", 3, None, "c")}
    s = WorkState(spark, str(tmp_path / "state"), most=3)  # a new process sees the same
    s.apply(batch(spark, (1, False, None, "late", 1), (2, False, None, "again", 2), (3, True, "9", None, 3), (4, False, None, "d", 4), (4, True, "7", None, 5), (4, False, None, "e", 6)), 1, ["n"])
    assert states(s) == {1: ("done", 1, "80", None), 2: ("failed", 2, None, "again"), 3: ("failed", 3, None, "c"), 4: ("done", 2, "7", None)}
    keys = spark.createDataFrame([(k,) for k in range(1, 6)], "key long")
    assert sorted(r["key"] for r in s.to_do(keys).collect()) == [2, 5]
    assert {r["status"]: r["n"] for r in s.counts(keys).collect()} == {"done": 2, "failed": 2, "pending": 1}
    s.reset_failed(2)
    assert states(s)[3] == ("pending", 3, None, "c") and sorted(r["key"] for r in s.to_do(keys).collect()) == [2, 3, 5]
    s.apply(batch(spark, (3, False, None, "f", 1), (3, True, "1", None, 2)), 3, ["n"])  # pending: once more, whatever it had
    assert states(s)[3] == ("failed", 4, None, "f")


def test_replayed_and_broken_batches(spark, tmp_path):
    s = WorkState(spark, str(tmp_path / "state"), most=9)
    one = batch(spark, (1, False, None, "x", 1))
    s.apply(one, 0, ["n"])
    s.apply(one, 0, ["n"])  # replayed after its commit
    assert states(s) == {1: ("failed", 1, None, "x")}

    class Crash(Exception):
        pass

    save = s.save

    def broken(df, folder):
        save(df, folder)
        (tmp_path / "state" / folder.rpartition("/")[2] / "_SUCCESS").unlink()  # died between the files and the commit
        raise Crash

    s.save = broken
    with pytest.raises(Crash):
        s.apply(one, 1, ["n"])
    s.save = save
    assert states(s) == {1: ("failed", 1, None, "x")}
    s.apply(one, 1, ["n"])
    assert states(s) == {1: ("failed", 2, None, "x")}
    for v in range(2, WHOLE_EVERY + 2):  # over a version that holds all keys
        s.apply(batch(spark, (v, True, str(v), None, 1)), v, ["n"])
    assert states(s) == {1: ("failed", 2, None, "x"), **{v: ("done", 1, str(v), None) for v in range(2, WHOLE_EVERY + 2)}}
    assert sum(w for _, w in s.versions()) == 1
    (tmp_path / "state" / f"whole-{WHOLE_EVERY - 1:012d}" / "_SUCCESS").unlink()  # without it the changes alone say the same
    assert states(s)[1] == ("failed", 2, None, "x") and len(states(s)) == WHOLE_EVERY + 1


def test_stream_of_results_goes_on(spark, tmp_path):
    s = WorkState(spark, str(tmp_path / "state"), most=3)
    for k in range(3):
        batch(spark, (1, k == 2, str(k), "e", k), (2, False, None, "e", k)).write.mode("append").parquet(str(tmp_path / "in"))
        fold_stream(spark.readStream.schema(RESULT).parquet(str(tmp_path / "in")), s, str(tmp_path / "ck"), ["n"])
    assert states(s) == {1: ("done", 3, "2", None), 2: ("failed", 3, None, "e")}
