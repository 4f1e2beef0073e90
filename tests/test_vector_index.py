"""The stored vector index: recall, what it reads, inserts, families and their generations."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, vectors
from tidemark.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def given(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("f"), F.col("vec_id") % 3).alias("family"))


@pytest.fixture(scope="module")
def index(spark, given, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dense") / "index")
    built = VectorIndex.create(given, at)
    built.insert(given.where("id % 2 = 0"), "a")
    built.insert(given.where("id % 2 = 1"), "a")
    return at


def pairs(found):
    return {(r.q_id, r.id) for r in found.collect()}


def models(index):
    return {f: (generation, model) for f, (generation, _, model) in index.current().items()}


def probes(given):
    return given.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("vector").alias("probe"))


def test_recall_at_a_tenth_of_the_comparisons(spark, given, index):
    """A second reader of the stored index; refine is what each probe compares in full."""
    exact, n = pairs(search.knn(probes(given), given, 10)), given.count()
    got = VectorIndex(spark, index).search(probes(given), 10, visits=24, refine=50)
    assert 50 <= 0.1 * n and len(exact & pairs(got)) >= 0.9 * len(exact) and got.count() == len(exact)
    far = {(r.q_id, r.id): r.distance for r in search.knn(probes(given), given, 10).collect()}
    assert all(r.distance == far[r.q_id, r.id] for r in got.collect() if (r.q_id, r.id) in far)


def test_all_cells_and_all_candidates_are_exact(spark, given, index):
    ix = VectorIndex(spark, index)
    assert pairs(ix.search(probes(given), 10, visits=32, refine=500)) == pairs(search.knn(probes(given), given, 10))
    want = pairs(search.knn(probes(given), given.where("family = 'f1'"), 5))
    assert pairs(ix.search(probes(given), 5, visits=32, refine=500, families=["f1"])) == want
    each = {(r.q_id, r.family, r.id) for r in search.knn(probes(given), given, 3, family=True).collect()}
    assert {(r.q_id, r.family, r.id) for r in ix.search(probes(given), 3, 32, 500, by_family=True).collect()} == each


def test_every_vector_is_stored_as_it_was(spark, given, index):
    want = {r.id: (r.family, r.vector) for r in given.collect()}
    assert {r.id: (r.family, r.vector) for r in VectorIndex(spark, index).vectors().collect()} == want


def test_inserts_are_found_and_families_change_in_one_step(spark, given, tmp_path):
    index = VectorIndex.create(given, str(tmp_path / "ix"), cells=4)
    assert index.vectors().count() == 0 and index.search(probes(given), 3, 4, 9).count() == 0
    index.insert(given.where("family = 'f0'"), "a")
    one = given.where("id = 1").select(F.col("id").alias("q_id"), F.col("vector").alias("probe"))
    assert index.search(one, 1, 4, 20).first().id != 1
    index.insert(given.where("family = 'f1'"), "b")
    assert index.search(one, 1, 4, 20).first().id == 1 and models(index) == {"f0": (1, "a"), "f1": (1, "b")}
    texts = given.select("id", "family", F.concat(F.lit("word "), "id").alias("text"))
    before = {r.id: r.vector for r in index.vectors(["f1"]).collect()}
    index.write(given.where("id = 3").select(F.lit(-1).alias("id"), F.lit("f0").alias("family"), "vector"), {"f0": "broken"})  # a pass that was broken off
    assert vectors.reembedded(index, texts, "b", lambda t: vectors.embedded(t, 64)) == ["f0"]
    assert models(index) == {"f0": (2, "b"), "f1": (1, "b")} and {r.id: r.vector for r in index.vectors(["f1"]).collect()} == before
    want = {r.id: r.vector for r in vectors.embedded(texts.where("family = 'f0'"), 64).collect()}
    assert {r.id: r.vector for r in index.vectors(["f0"]).collect()} == want and "f2" not in index.current()
    assert vectors.reembedded(index, texts, "b", lambda t: t) == []


def test_wrong_widths_and_missing_vectors(spark, given, index, tmp_path):
    with pytest.raises(Exception, match="must have 64 numbers"):
        VectorIndex(spark, index).insert(spark.createDataFrame([(9999, "f0", [1.0, 2.0])], "id long, family string, vector array<float>"))
    with pytest.raises(Exception, match="must have 3 numbers"):
        search.of_width(given, 3).collect()
    with pytest.raises(ValueError):
        VectorIndex.create(given.limit(0), str(tmp_path / "none"))
    small = VectorIndex.create(given.limit(5), str(tmp_path / "few"))
    small.insert(spark.createDataFrame([(1, None, [0.5] * 64), (2, "a", None), (3, "a", [0.5] * 64), (4, "a", [0.5] * 64)], "id long, family string, vector array<float>"), "m")
    got = small.search(spark.createDataFrame([(7, [0.5] * 64), (8, None)], "q_id long, probe array<float>"), 2, 9, 9).collect()
    assert [(r.q_id, r.id, r.rank) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1, 1), (7, 3, 2)]


@pytest.mark.parametrize("probes_, pack", [(1024, 4096), (3, 7)])
def test_exact_search_is_brute_force(spark, monkeypatch, probes_, pack):
    import numpy as np

    monkeypatch.setattr(search, "PROBES", probes_)
    monkeypatch.setattr(search, "PACK", pack)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).round(1)
    x[10] = x[11]
    rows = [(i, ("a", "b", None)[i % 3], [float(v) for v in x[i]]) for i in range(60)] + [(99, "a", None)]
    vectors_ = spark.createDataFrame(rows, "id int, family string, vector array<double>")
    asked = [(i, [float(v) for v in rng.normal(size=4).round(1)]) for i in range(10)] + [(77, None)]
    probes__ = spark.createDataFrame(asked, "q_id int, probe array<double>")
    far = lambda q, v: round(sum((a - b) ** 2 for a, b in zip(q, v)), 6)
    for family in (False, True):
        want = set()
        for q, p in asked[:-1]:
            for names in (["a", "b", None] if family else ["all"]):
                near = sorted(((far(p, v), i, f) for i, f, v in rows[:-1] if not family or f == names), key=lambda x: x[:2])
                want |= {(q, i, f, r + 1) for r, (_, i, f) in enumerate(near[:4])}
        got = {(r.q_id, r.id, r.family, r["rank"]) for r in search.knn(probes__, vectors_, 4, family=family).collect()}
        assert got == want
    assert search.knn(probes__, vectors_.limit(0), 4).count() == 0 == search.knn(probes__.limit(0), vectors_, 4).count()
