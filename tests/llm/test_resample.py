"""Importance resampling against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) for x in w + [a + " " + b for a, b in zip(w[:-1], w[1:])]]


def brute(docs, target, percent=25, least_words=20, seed=7, buckets=10_000):
    held = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b % buckets for _, _, f in held for b in f), collections.Counter(b % buckets for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in held:
        weight = sum(gain(b % buckets) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(("%d:%s" % (seed, "" if i is None else i)).encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = {x[0]: k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return out, drawn


def corpus():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(120)] + ["Été", "ÀB", "naïve", "A" * 70, "b" * 64, "c" * 65, "d" * 300, "日本", "x_y", "0", "\x00z", "q\x7fr", "😀"]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "x" * 9000), (6, "the " * 5000), (7, "A-b_C d"), (8, " ".join("k%d" % i for i in range(20))), (9, " ".join("k%d" % i for i in range(19)))]
    docs += [(i, rng.choice([" ", "\n", ", ", "--"]).join(rng.choices(vocabulary, k=rng.randint(0, 90)))) for i in range(10, 300)]
    docs += [(None, docs[40][1] + " and more"), (301, docs[41][1])]
    return docs, [None, ""] + [" ".join(rng.choices(vocabulary[:30] + vocabulary[-9:], k=40)) for _ in range(15)]


@pytest.mark.parametrize("slice_rows, block, percent, buckets", [(50_000, 4 << 20, 25, 10_000), (17, 2000, 60, 50)])
def test_resample(spark, monkeypatch, slice_rows, block, percent, buckets):
    docs, target = corpus()
    monkeypatch.setattr(resample, "BLOCK_BYTES", block)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    for c in ("row", "slice", "score", "rank", "place", "bucket", "n"):
        rows = rows.withColumn(c, F.lit("clash"))
    got = resample.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, buckets=buckets, slice_rows=slice_rows).collect()
    want, drawn = brute(docs, target, percent=percent, buckets=buckets)
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score, r.n_words) for r in got) == sorted((i or -1, *x) for i, *x in want)
    assert {r.doc_id: r["rank"] for r in got if r["rank"]} == drawn and len(drawn) > 50


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join("w%d" % i for i in range(30))
    rows = spark.createDataFrame([(1, text)] * 40, "doc_id bigint, text string")
    none = rows.limit(0)
    got = resample.resample(rows, none, slice_rows=7).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len({(r.weight, r.score, r.n_features) for r in got}) == 1
    assert resample.resample(none, rows).count() == 0
    assert [r["rank"] for r in resample.resample(rows.limit(3), rows).collect()] == [None] * 3


def test_composed_codes_equal_those_of_the_whole():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*range(1, 70), 200, 1000]]
    known = resample.Dictionary(b" ".join(words))
    order = rng.integers(0, len(words), 500)
    assert known.pairs(order).tolist() == [zlib.crc32(words[a] + b" " + words[b]) for a, b in zip(order[:-1], order[1:])]
    text = " " + "  ".join(words[k].decode() for k in order) + " "
    assert [known.words[k] for k in known.scan(text)] == [words[k] for k in order]
