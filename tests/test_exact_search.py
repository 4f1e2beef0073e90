"""Exact search holds a lane of vectors and streams probes past it; no row holds a block."""

import numpy as np
import pytest

from tidemark.operators import search


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1.0), ("double", 1e4)])
@pytest.mark.parametrize("family", [False, True])
def test_lanes_are_brute_force(spark, monkeypatch, kind, scale, family):
    """Several lanes and packs, many copies (ties go by id), vectors far from the origin."""
    for name, n in (("LANE", 40), ("PACK", 7), ("PROBES", 3)):
        monkeypatch.setattr(search, name, n)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(150, 6)) + 3) * scale
    x[20:60] = x[20]
    x[100:110] = x[100] + rng.normal(size=(10, 6)) * 1e-4
    x = x.astype(np.float32 if kind == "float" else np.float64)
    rows = [(i, ("a", "b", None)[i % 3], [float(v) for v in x[i]]) for i in range(150)]
    vectors = spark.createDataFrame(rows, f"id long, family string, vector array<{kind}>")
    probes = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 150, 10)], f"q_id long, probe array<{kind}>")
    far = ((x[:, None, :].astype(float) - x[None, :, :].astype(float)) ** 2).sum(axis=2).round(6)
    want = set()
    for q in range(0, 150, 10):
        for names in (["a", "b", None] if family else ["all"]):
            near = sorted((far[q, i], i) for i, f, _ in rows if not family or f == names)[:5]
            want |= {(q, i, rows[i][1], r + 1) for r, (_, i) in enumerate(near)}
    got = {(r.q_id, r.id, r.family, r["rank"]) for r in search.knn(probes, vectors, 5, family).collect()}
    assert got == want


@pytest.mark.parametrize("find", [search.knn, search.knn_all_families])
def test_no_row_holds_a_block(spark, find):
    """Arrow takes up to 10,000 rows at a time, so a row of megabytes makes batches of gigabytes."""
    vectors = spark.createDataFrame([(i, "a", [float(i), 1.0]) for i in range(30)], "id long, family string, vector array<float>")
    found = find(vectors.where("id % 10 = 0").selectExpr("id AS q_id", "vector AS probe"), vectors, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 6 and "MapInArrow" in plan and "Join" not in plan and "collect_list" not in plan and "binary" not in plan
