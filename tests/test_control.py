"""Control of requests: the stream's decisions are the replay's, whatever the order of arrival within the watermark."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import control, runs
from lexweave.streaming import control as stream

SCHEMA = "key string, ts timestamp, us long, id long, tokens long, elapsed double, kind string, pause double"
LIMITS = control.Limits(3, 20, 60, 4, 6, 10.0, down_at=3, up_at=5, ring=6)


def made(seed, n=240):
    """Rows of three keys, several at one moment, over about half an hour."""
    r, at, out = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        at += r.choice((0, 0, 3, 7, 20))
        out.append((r.choice("abc"), at, at * 1_000_000, i, r.randrange(12), r.choice((None, 1.0, 4.0, 25.0)), r.choice((None, None, "rate", "timeout", "format")), r.choice((None, 0.0, 30.0))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, None, *rest) for k, _, *rest in rows], SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def decided(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_replay(spark, tmp_path, seed):
    rows = made(seed)
    want = decided(control.replayed(frame(spark, rows), LIMITS))
    r = random.Random(seed)
    arrived = sorted(rows, key=lambda x: x[1] + r.random() * 110)
    folder = f"file://{tmp_path}/in"
    for k in range(0, len(arrived), 60):
        frame(spark, arrived[k : k + 60]).coalesce(1).write.mode("append").parquet(folder)
    beat = ("", rows[-1][1] + 900, (rows[-1][1] + 900) * 1_000_000, 0, 0, None, None, None)
    frame(spark, [beat]).coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        with stream.rocksdb(spark):
            q = stream.controlled(source, LIMITS, "2 minutes").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        q.awaitTermination()
        return decided(spark.read.parquet(f"file://{tmp_path}/out").where("key <> ''"))

    assert run() == want and len(want) == len(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    # a restarted stream goes on where it stopped; what comes too late changes nothing
    frame(spark, [("a", 0, rows[0][2], 10_000, 5, 1.0, None, None)]).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want


def test_replay_equals_the_windows_and_controllers(spark):
    found = frame(spark, made(3)).where("elapsed is not null and kind is not null").withColumn("o", F.struct("us", "id"))
    own = {r.id: r for r in control.replayed(found.drop("o"), LIMITS).collect()}
    rate = runs.rate_windows(found, "key", "ts", "id", F.col("tokens"), 3, 20, 60).collect()
    for r in rate:
        assert (r.requests, r.window_tokens) == (own[r.id].requests, own[r.id].window_tokens)
        assert r.wait == pytest.approx(own[r.id].wait, abs=1e-3) and r.gap == pytest.approx(own[r.id].gap, abs=1e-3)
    held = runs.global_pause(found.withColumn("s", F.col("us") / 1e6), "key", "o", F.col("s"), F.col("pause")).collect()
    assert all(r.held == pytest.approx(own[r.id].held, abs=1e-3) for r in held) and any(r.held > 0 for r in held)
    assert {own[i].action for i in own} == {"none", "up", "down"}


def test_edge_rows(spark):
    assert control.replayed(frame(spark, []), LIMITS).count() == 0
    c = F.col
    raw = spark.createDataFrame([(None, 1), ("a", None), ("a", 1)], "k string, s long")
    own = control.events(raw, c("k"), F.timestamp_seconds("s"), F.lit(1), F.lit(None), F.lit(None), F.lit(None).cast("string"), F.lit(None))
    assert [(r.key, r.tokens, r.elapsed) for r in own.collect()] == [("a", 0, None)]
    one = control.replayed(own, LIMITS).first()
    assert (one.requests, one.wait, one.held, one.action, one.failure_pause) == (1, 0.0, 0.0, None, None)

def test_replay_of_dense_windows_stays_linear(spark):
    """Moments looked at for the wait grow with the events, not with the window: 20 000 events of one window, all over the limit of tokens."""
    import time

    from lexweave.operators.control import Control, Event, Limits

    def seconds(n):
        own, start = Control(Limits(3, 200, 3600)), time.process_time()
        waits = [d[4] for d in own.run(Event(k * 1000, k, 1, None, None, None) for k in range(n))]
        # the moment 200 tokens before is the one that has to leave
        assert waits[-1] == pytest.approx((n - 201) / 1000 + 3600 - (n - 1) / 1000, abs=1e-6)
        return time.process_time() - start

    assert seconds(20_000) < 12 * seconds(4_000) + 0.2


def test_rate_windows_of_batches_and_moments(spark):
    """Windows reach over Arrow batches; events of one moment are in each other's windows; those without key or time are left out."""
    rows = [("a", k // 3, k, 2) for k in range(25_000)] + [("b", 5, 1, 7), (None, 5, 2, 7), ("b", None, 3, 7)]
    own = spark.createDataFrame(rows, "key string, s long, id long, n int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.key, r.id): r for r in runs.rate_windows(own, "key", "ts", "id", F.col("n"), 10, 40, 60).collect()}
    assert len(got) == 25_001 and got["b", 1].requests == 1 and got["b", 1].window_tokens == 7
    r = got["a", 20_001]
    assert (r.requests, r.window_tokens) == (183, 366) and r.wait == 60 - 6
