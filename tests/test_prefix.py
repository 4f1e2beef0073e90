"""Running totals in slices equal those of one window; no slice is much larger than it should be."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, prefix, privacy


def rows(hot):
    rng = random.Random(7)
    keys = ["hot"] * hot + [None] * 20 + [f"k{i}" for i in range(40) for _ in range(rng.randint(1, 5))]
    rng.shuffle(keys)
    return [(i, k, rng.choice([None, 0, 1, 5, -2])) for i, k in enumerate(keys)]


@pytest.mark.parametrize("slice_rows", [7, 100, 1 << 18])
def test_running_totals(spark, slice_rows):
    data = rows(600)
    df = spark.createDataFrame(data, "seq long, key string, x long").withColumn("slice", F.lit("own"))
    got = prefix.running(df, ["key"], ["seq"], {"total": ("sum", F.col("x")), "top": ("max", F.col("x"))}, slice_rows)
    want = {}
    for k in {r[1] for r in data}:
        own = [r for r in data if r[1] == k]
        tops = accumulate((r[2] for r in own), lambda a, b: max((v for v in (a, b) if v is not None), default=None))
        want |= {r[0]: (s, t) for r, s, t in zip(own, accumulate(r[2] or 0 for r in own), tops)}
    assert {r.seq: (r.total, r.top) for r in got.collect()} == want and got.where("slice <> 'own'").count() == 0
    assert prefix.running(df.limit(0), ["key"], ["seq"], {"total": ("sum", F.col("x"))}, slice_rows).count() == 0


def test_a_key_with_all_rows_is_spread(spark):
    df = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("one").alias("key"))
    sizes = [r["count"] for r in prefix.sliced(df, ["key", "seq"], 20).groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000
    touches = df.select("seq", F.col("key").alias("app"), F.lit(True).alias("occurrence"), F.lit(None).cast("long").alias("t_start_ns"), F.lit(None).cast("long").alias("t_end_ns"))
    got = ingest.gated(touches, "app", occurrences=15_000, slice_rows=1000)
    assert got.where("promoted").agg(F.min("seq"), F.count("*")).first()[:] == (14_999, 5001)


@pytest.mark.parametrize("slice_rows", [3, 1 << 18])
def test_following(spark, slice_rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 30), i) for i in range(50)]
    got = prefix.following(spark.createDataFrame(data, "t long, seq long"), ["t", "seq"], "t", "next", slice_rows).collect()
    data.sort()
    assert {r.seq: r.next for r in got} == {s: (data[k + 1][0] if k + 1 < len(data) else None) for k, (_, s) in enumerate(data)}


@pytest.mark.parametrize("slice_rows", [5, 1 << 18])
def test_pauses_meet_events_in_one_order(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(prefix, "SLICE", slice_rows)
    rng = random.Random(3)
    paused = [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 200) for _ in range(30))]
    events = [(i, rng.randint(0, 210) if i % 9 else None, rng.choice(["a", "bad", None])) for i in range(120)]
    got = privacy.allowed(spark.createDataFrame(events, "seq long, t_ns long, app_id string"), spark.createDataFrame([("bad",)], "app_id string"), spark.createDataFrame(paused, "from_ns long, until_ns long"))
    assert sorted(r.seq for r in got.collect()) == [i for i, t, app in events if app != "bad" and (t is None or not any(a <= t < b for a, b in paused))]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
