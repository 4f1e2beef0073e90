"""Keyed state that leaves: streams equal batches until a key is evicted, and what leaves is what should."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.streaming import bounded

S, HOUR = 1_000_000_000, 3_600_000_000_000
TOUCH = "seq long, t_ns long, app_id string, occurrence boolean, t_start_ns long, t_end_ns long"


@pytest.fixture(autouse=True)
def store(spark):
    """RocksDB, and micro-batches without data, in which timers run."""
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k, None) for k in keys}
    bounded.rocks(spark)
    spark.conf.set(keys[1], "true")
    spark.conf.set(keys[2], "2")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def streamed(spark, batches, schema, make, folder, name):
    """Rows that the stream gives for files read one after another, and the rows of state after all of them."""
    source, at = str(folder / f"{name}-in"), str(folder / f"{name}-check")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{k:03d}")
        q = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)).writeStream
        q = q.format("parquet").option("path", str(folder / f"{name}-out")).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        last = q.recentProgress[-1]
    return spark.read.parquet(str(folder / f"{name}-out")).collect(), last.stateOperators[0].numRowsTotal


def touch(seq, t, app, begin=None):
    """Seconds after a start; Spark takes the epoch itself, the first watermark, for late."""
    t, begin = t + 1000, None if begin is None else begin + 1000
    return (seq, t * S, app, begin is None, None if begin is None else begin * S, None if begin is None else t * S)


def test_idle_keys_leave_and_promoted_ones_stay(spark, tmp_path):
    """A key that was promoted by dwell survives 300 others that come and go; an idle one begins anew."""
    first = [touch(0, 0, "term"), touch(1, 6, "term", 0), touch(2, 10, "once"), touch(3, 20, "once")]
    noise = [touch(10 + k, 30 + k, f"app-{k}") for k in range(300)]
    later = [touch(400, 8000, "tick"), touch(401, 8001, "tick")]
    last = [touch(500, 20_000, "term"), touch(501, 20_001, "once"), touch(502, 20_002, "tock")]
    got, state = streamed(spark, [first, noise, later, last], TOUCH, bounded.gated, tmp_path, "gate")
    seen = {r.seq: r.promoted for r in got}
    assert {*range(4), *range(10, 310), 400, 401, 500, 501, 502} - set(seen) == set()
    assert len(got) == 309 and seen[1] and seen[500]  # as after any pressure
    assert not seen[501]  # two hours on, its two earlier occurrences are forgotten; with them it would be the third
    assert state < 4 * 12  # the 300 are gone; what is left are rows and timers of a few keys
    want = ingest.gated(spark.createDataFrame(first + noise, TOUCH), "app_id").select("seq", "promoted")
    assert {r.seq: r.promoted for r in want.collect()} == {k: v for k, v in seen.items() if k < 400}


def test_gate_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0
    for seq in range(400):
        t += rng.randint(0, 9)
        rows.append(touch(seq, t, f"app-{rng.randint(0, 60)}", t - rng.randint(0, 4) if rng.random() < 0.5 else None))
    got, _ = streamed(spark, [rows[:150], rows[150:160], rows[160:]], TOUCH, lambda s: bounded.gated(s, dwell_ns=9 * S), tmp_path, "equal")
    want = ingest.gated(spark.createDataFrame(rows, TOUCH), "app_id", dwell_ns=9 * S).select("seq", "app_id", "promoted")
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))


def test_cooldown_equals_the_batch_and_forgets(spark, tmp_path):
    rng = random.Random(2)
    rows, t = [], 1000 * S
    for _ in range(500):
        t += rng.randint(0, 12) * S
        rows.append((rng.choice(["make", "cargo", "same", None, "é" * 50, *(f"rare {k}" for k in range(40))]), t + rng.randint(0, 4) * S))
    rows.sort(key=lambda r: r[1])
    got, state = streamed(spark, [rows[:200], rows[200:210], rows[210:], [("end", t + 10 * HOUR)], [("end", t + 20 * HOUR)]], "text string, t_ns long", lambda s: bounded.cooled(s, 600 * S), tmp_path, "cool")
    want = ingest.cooled(spark.createDataFrame([*rows, ("end", t + 10 * HOUR), ("end", t + 20 * HOUR)], "text string, t_ns long"), "text", "t_ns", 600 * S)
    assert sorted(map(str, got)) == sorted(map(str, want.select("text", "t_ns").collect())) and state <= 6
    assert spark.createDataFrame(rows, "text string, t_ns long").select(F.countDistinct("text")).first()[0] > 20
