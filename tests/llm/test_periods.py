"""Periodic runs against brute force, with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(w, times=4, shortest=6):
    """Every stretch of equal words q apart; its smallest period is tried first."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, times * q) and not any(a <= i and i + length <= a + n and q % p == 0 for a, n, p in found.values()):
                found[i, q] = (i, length, q)
            i = j
    return sorted(found.values(), key=lambda x: (x[0], x[2]))


def report(w, times=4, shortest=6):
    found = brute_runs(w, times, shortest)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    told = "".join("%d,%d,%d\n" % x for x in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], sha(told), sha(kept))


def texts():
    rng = random.Random(2)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a a a a a a a", "a b a b a b a", "a b a b a b a b", "b a b a b a b a b", "x" * 5000, "a a a a a a b a a a a a a", "é é é é é é è è"]
    for _ in range(250):
        vocabulary = ["w%d" % i for i in range(rng.choice([1, 2, 3, 5, 40]))]
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices(vocabulary, k=rng.randint(1, 9))
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 7)[: rng.randint(1, 7 * len(unit))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(words))
    thue = [0]
    for _ in range(8):
        thue += [1 - x for x in thue]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out += [" ".join(map(str, thue)), " ".join(fibonacci[-1]), " ".join((["p"] * 5 + ["q"]) * 30), " ".join(["a b c"] * 40 + ["a b"] * 40)]
    out.append(" ".join(["w%d" % (k % 37) for k in range(37 * 5 + 3)] + ["w1"] * 6 + ["w%d" % (k % 53) for k in range(53 * 4 - 1)]))
    return out + [out[20]] * 3


def test_runs_and_collapsed_texts(spark):
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("runs", "start", "period", "n_runs", "collapsed"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = periods.detect(docs).collect()
    pick = lambda r: (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
    want = collections.Counter((i, *report(WORD.findall(t or ""))) for i, t in rows)
    assert collections.Counter(map(pick, got)) == want and sum(x[1] for x in want) > 200
    assert all(sha(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs and len(WORD.findall(r.collapsed)) == r.n_collapsed for r in got)
    assert periods.detect(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.detect(docs, times=3)


def test_other_thresholds(spark):
    rows = list(enumerate(texts()))
    got = periods.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), times=6, shortest=9, text=False).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in got} == {i: report(WORD.findall(t or ""), 6, 9)[:4] for i, t in rows}


def test_planted_runs(spark, tmp_path):
    """The registered query, on texts whose words are planted anew by their ids."""
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts() * 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g // 1 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want[i, *report(w)] += 1
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == want


def test_splitting_is_stable_and_keeps_runs():
    rng = random.Random(4)
    for _ in range(300):
        w = rng.choices(range(rng.choice([2, 6, 15])), k=rng.randint(6, 120))
        found = periods.split(w, 4, 6)
        for a, b in found:
            assert min(collections.Counter(w[a:b]).values()) >= 4 and b - a >= 6
        assert all(any(a <= i and i + n <= b for a, b in found) for i, n, _ in brute_runs(w))


def test_a_long_text_costs_little():
    """One segment that loses a word at each end in turn, which would be quadratic if it were counted whole each time; and one
    long stretch of few words, where trying every lag would be."""
    import time

    n = 60_000
    w = np.concatenate([np.arange(n), np.arange(n), np.arange(n), np.arange(n)[::-1]])
    began = time.perf_counter()
    periods.split(w.tolist(), 4, 6)
    few = np.random.default_rng(1).integers(0, 3, 300_000)
    periods.runs(few, *periods.segments(few, np.array([0, len(few)])))
    assert time.perf_counter() - began < 20
