"""Snapping in slices against all rows; a probe is one row."""

import random

import pytest

from tidemark.operators import relational as rel


def brute(t, rows, around):
    """(out, edge, s, id) of the best row."""
    near = [(not s <= t <= e, min(abs(s - t), abs(e - t)), s, i) for i, s, e in rows if e >= t - around and s <= t + around]
    return min(near)[3] if near else None


@pytest.mark.parametrize("slice_rows", [5, 40, 1 << 18])
@pytest.mark.parametrize("seed", [0, 1])
def test_snapping_is_brute_force(spark, seed, slice_rows):
    rng = random.Random(seed)
    rows = [(i, s, s + rng.choice([0, 1, 5, 40, 300, 2000])) for i, s in enumerate(rng.choice([rng.randint(-50, 3000), 500, 501]) for _ in range(70))]
    probes = [(1000 + i, rng.choice([rng.randint(-200, 5200), 500, 501])) for i in range(300)] + [(9999, None)]
    focus = spark.createDataFrame([(i, f"app {i}", s, e) for i, s, e in rows], "id long, app_id string, t_start_ns long, t_end_ns long")
    got = rel.snapped(spark.createDataFrame(probes, "probe_id long, t_ns long"), focus, 20, slice_rows).collect()
    assert len(got) == len(probes)
    assert {(r.probe_id, r.t_ns): r.id for r in got} == {(p, t): None if t is None else brute(t, rows, 20) for p, t in probes}
    assert all(r.app_id == (f"app {r.id}" if r.id is not None else None) for r in got)


def test_no_probe_is_asked_for_every_size(spark):
    """No broadcast that waits for the whole history, and no row a probe and power of two."""
    focus = spark.createDataFrame([(1, "a", 1, 9)], "id long, app_id string, t_start_ns long, t_end_ns long")
    found = rel.snapped(spark.createDataFrame([(1, 5)], "probe_id long, t_ns long"), focus, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "shiftright(t_ns" not in plan and [r.id for r in found.collect()] == [1]
