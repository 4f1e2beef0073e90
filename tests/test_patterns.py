"""Many patterns in one pass, against plain `in`; no plan has a nested-loop join."""

import random

import duckdb
import pytest

import tidemark.plans  # noqa: F401
from tidemark.operators import patterns, search
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources.tables import chunks


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("group", [1 << 20, 4000])
def test_occurrences(spark, monkeypatch, group):
    monkeypatch.setattr(patterns, "GROUP", group)
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abé 😀", k=n))
    texts = [(i, letters(rng.randint(0, 30))) for i in range(60)] + [(100, None), (101, ""), (102, "ab" * 5000)]
    wanted = sorted({letters(rng.randint(1, 4)) for _ in range(50)} | {"", "abab", "b" * 200, "ab" * 4000})
    rows, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*wanted, wanted[3], None]], "pattern string")
    got = [(r.id, r.pattern) for r in patterns.occurrences(rows, known).collect()]
    assert sorted(got) == sorted((i, p) for i, t in texts if t is not None for p in wanted if p in t)
    assert {r.pattern for r in patterns.present(rows, known).collect()} == {p for p in wanted if any(p in t for _, t in texts if t is not None)}
    none = known.limit(0)
    assert patterns.occurrences(rows, none).count() == 0 == patterns.present(rows, none).count() == patterns.occurrences(rows.limit(0), known).count()


def test_no_nested_loops(spark, sf_dir):
    c = chunks(spark, sf_dir)
    q = spark.createDataFrame([(1, "Did Anna watch the matrix"), (2, "zzz"), (3, None), (4, "what")], "q_id long, question string")
    media = c.selectExpr("doc_id AS m_id", "text").where("m_id % 5 = 3")
    for df in (search.matched(q, c), search.names_known(q, c), search.on_topic(q, media)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_questions_and_media(spark):
    media = spark.createDataFrame([(1, "The Matrix, 1999"), (2, "Alien"), (3, "matrix again"), (4, None)], "m_id long, text string")
    q = spark.createDataFrame([(1, "watched matrix episode"), (2, "zebra"), (3, None), (4, "what")], "q_id long, question string")
    got = sorted((r.q_id, r.m_id) for r in search.on_topic(q, media).collect())
    assert got == [(1, 1), (1, 3), *((n, m) for n in (2, 4) for m in (1, 2, 3, 4))]
    c = spark.createDataFrame([(7, "Installed boxes, installing"), (8, "nothing"), (9, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "installing boxes installs"), (2, "nothing nothings")], "q_id long, question string")
    assert sorted(tuple(r) for r in search.matched(asked, c).collect()) == [(1, 7, 3), (2, 8, 2)]
    names = spark.createDataFrame([(1, "did Anna call Bob"), (2, "did I call"), (3, "did Zed call"), (4, None)], "q_id long, question string")
    said = spark.createDataFrame([("anna and bobby",), (None,)], "text string")
    assert {r.q_id: r.known for r in search.names_known(names, said).collect()} == {1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("group", [1 << 20, 30])
def test_every_pair_is_counted(spark, tmp_path, monkeypatch, group):
    """txt04 gives each asked question with each chunk, also where the count is 0 or the question null."""
    monkeypatch.setattr(patterns, "GROUP", group)
    monkeypatch.setattr(patterns, "ROWS", 7)
    docs = [(-3, "The boxes"), (1, None), (2, ""), (3, "Installed boxes, installing"), (3, "nothing"), (4, "zebra BOX"), (None, "boxed")]
    items = [(0, "installing boxes installs boxes"), (20, None), (40, "what was it"), (60, ""), (60, "zebra"), (80, "nothing else"), (7, "not asked boxes")]
    labels = [(3, 1, 0), (4, 1, 0), (4, 0, 1), (9, 1, 1), (None, 1, 1)]
    for name, rows, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["txt04_terms_matched"](spark, str(tmp_path))
    assert got.columns == ["q_id", "doc_id", "matched"] and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    stems = {0: [["install", "box", "install", "box"]], 20: [None], 40: [[]], 60: [[], ["zebra"]], 80: [["noth", "else"]]}
    seen = [(d, (t or "").lower()) for d, t in docs] + [(4, "zebra box")]
    want = [(q, d, None if own is None else sum(s in t for s in own)) for q, sets in stems.items() for own in sets for d, t in seen]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 6 * 8
    db = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(str, db.sql(ORACLES["txt04_terms_matched"]).fetchall())) == sorted(map(str, want))
