"""Line dedup against brute force, with awkward rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import linededup

SPACE, LOWER = "\x20\x09\x0a\x0b\x0c\x0d", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(5)
    shared = ["All rights reserved by nobody %d" % i for i in range(12)] + ["é" * 20, "é" * 19, "ÀÉ" * 12, "x" * 20, "x" * 19, "long " * 3000]
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n  \n"), (5, "x" * 20), (6, "x" * 20), (7, "X" * 20 + "\r\n"), (8, "x" * 20 + "\n\t" + "x" * 20)]
    for i in range(9, 140):
        lines = [rng.choice(shared) if rng.random() < 0.4 else "own line %d of document %d" % (k, i) for k in range(rng.randint(0, 12))]
        lines = [x.upper() if rng.random() < 0.2 else x for x in lines]
        rows.append((i, rng.choice(["\n", "\n ", "\r\n", " \t\n"]).join(lines)))
    rows += [rows[20]] * 500 + [(21, "another text of one id\n" + shared[0]), (None, shared[1] + "\n" + shared[1]), (None, shared[2]), (200, shared[3]), (200, "y\n" + shared[3])]
    twice = "held by two documents only, one of them four times"
    return rows + [(201, twice)] * 4 + [(202, twice)]


def brute(rows, least_chars, least_docs):
    last = 1 << 63
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(last if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := key(x)) >= least_chars and len(held[k]) >= least_docs and max(held[k]) > (last if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


@pytest.mark.parametrize("least_docs, chunk_bytes", [(3, 1 << 24), (3, 2000), (2, 3000), (5, 500)])
def test_line_dedup(spark, least_docs, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("chunk", "copies", "kept", "shard", "kind"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = linededup.deduplicated(docs, least_docs=least_docs, chunk_bytes=chunk_bytes).collect()
    want = brute(rows, 20, least_docs)
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in got) == want
    assert sum(n * x[2] for x, n in want.items()) > 100


def test_empty_and_thresholds(spark):
    assert linededup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        linededup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string"), least_docs=1)


def test_filters_lose_no_repeat_and_pass_few_others():
    rng = np.random.default_rng(3)
    first = np.unique(rng.integers(0, 1 << 20, 20_000).astype(np.uint64))
    second = np.unique(rng.integers(0, 1 << 20, 20_000).astype(np.uint64))
    by_two = np.zeros(len(first), np.uint8)
    by_two[:50] = 1
    one, two = linededup.seen_twice([[first, by_two], [second, np.zeros(len(second), np.uint8)]], 0, 1 << 20)
    assert (two == np.isin(second, first)).all() and two.sum() < 1000
    assert (one == (np.isin(first, second) | by_two.astype(bool))).all()
