"""Suffix, substring and near-duplicate dedup against brute force, with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, substring, suffixes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "ñandú", "😀", "A", "The"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages, texts = [prose(70) for _ in range(4)], [None, None, "", " \t\n", "one", "one", "one two", "One two", "x" * 400, "x" * 400, "a b " * 300]
    for _ in range(60):
        base = prose(rng.randint(1, 200))
        texts.append(base)
        if rng.random() < 0.6:
            texts.append(base + (" " + rng.choice(passages) if rng.random() < 0.5 else ""))
        words = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("\n".join([" ".join(copy), rng.choice(passages)]) if rng.random() < 0.2 else " ".join(copy))
    texts.append(" ".join(passages) * 3)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts)]
    rows += [(rows[20][0], rows[20][1], "x", "y", 1), (None, rows[12][1], None, None, None), (None, texts[-1], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("chunk", "key", "id", "label", "kind", "shard"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs, [(r[0], r[1]) for r in rows]


def key(i):
    return (1 << 63) - 1 if i is None else i


def repeats(rows, units, width):
    """(units, covered mask) of each row: windows whose like also starts in a smaller id."""
    first = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width])
            first[w] = min(first.get(w, key(i)), key(i))
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if first[tuple(u[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        yield i, u, gone


def test_suffix_dedup(spark, corpus):
    docs, rows = corpus
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(docs).collect())
    want = collections.Counter()
    for i, u, gone in repeats(rows, lambda t: list((t or "").encode()), 50):
        want[i, len(u), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), sha(bytes(b for b, g in zip(u, gone) if not g))] += 1
    assert got == want and sum(x[2] for x in want) > 1000
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_hot_anchors_and_block_edges(spark, corpus, monkeypatch):
    """Windows of hot anchors travel alone; segments cut at a block's edge still meet."""
    docs, rows = corpus
    want = collections.Counter((i, sum(gone)) for i, _, gone in repeats(rows, lambda t: list((t or "").encode()), 50))
    for hot in (0, 1, 3):
        assert collections.Counter((r.doc_id, r.n_removed) for r in suffixes.deduplicated(docs, hot=hot).collect()) == want
    data = np.frombuffer(("".join(chr(97 + i % 7) for i in range(3000)) * 2).encode(), np.uint8)
    whole = suffixes.anchors(data, np.array([0, 3000, 6000]), 50)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    cut = suffixes.anchors(data, np.array([0, 3000, 6000]), 50)
    starts = lambda a: sorted(x for f, t in zip(a[2], a[3]) for x in range(f, t + 1))
    assert starts(whole) == starts(cut) == [*range(2951), *range(3000, 5951)]
    mark = suffixes.mark_anchors(4096)([[np.array([1, 2], np.uint64), np.array([60000, 1], np.uint16)], [np.array([2], np.uint64), np.array([1], np.uint16)]])
    assert [x.tolist() for x in mark] == [[2, 1], [1]]


def test_sort_suffixes_orders_and_verifies(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=4000)), np.uint8)
    start = np.array([rng.randrange(3900) for _ in range(1500)])
    width, group = np.full(1500, 50), np.array([rng.randrange(3) for _ in range(1500)])
    for broken in (False, True):
        if broken:  # every hash collides: only the verification tells suffixes apart
            monkeypatch.setattr(suffixes, "prefix_hashes", lambda codes: np.zeros(len(codes) + 1, np.uint64))
        order, kind = suffixes.sort_suffixes(data, start, width, group)
        text = [(group[i], data[start[i] : start[i] + 50].tobytes()) for i in range(1500)]
        assert len(set(kind)) == len(set(text)) and len({(k, t) for k, t in zip(kind, text)}) == len(set(text))
        assert [text[i] for i in order] == sorted(text)


def test_classes_come_from_the_sorted_order(monkeypatch):
    """Equal suffixes are found because the sort makes them neighbours: in another order they are not."""
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choices(b"abc", k=300)) * 6, np.uint8)
    start = np.array(rng.sample(range(1700), 900))
    width, group = np.full(900, 50), np.zeros(900, np.int64)
    want = len({data[i : i + 50].tobytes() for i in start})
    _, kind = suffixes.sort_suffixes(data, start, width, group)
    assert len(set(kind)) == want <= 300
    sort = suffixes.merge_sorted
    monkeypatch.setattr(suffixes, "merge_sorted", lambda padded, prefix, start, width, group: np.argsort(start))  # reads no byte
    _, kind = suffixes.sort_suffixes(data, start, width, group)
    assert len(set(kind)) > 2 * want
    monkeypatch.setattr(suffixes, "merge_sorted", lambda *a: np.array(rng.sample(sort(*a).tolist(), 900)))
    _, kind = suffixes.sort_suffixes(data, start, width, group)
    assert len(set(kind)) > want


def test_substring_dedup(spark, corpus):
    docs, rows = corpus
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, sha(r.kept.encode())) for r in substring.deduplicated(docs).collect())
    want = collections.Counter()
    for i, u, gone in repeats(rows, lambda t: WORD.findall(t or ""), 50):
        kept = sha(" ".join(w for w, g in zip(u, gone) if not g).encode())
        want[i, len(u), sum(gone), kept, kept] += 1
    assert got == want and sum(x[2] for x in want) > 500
    assert substring.deduplicated(docs.limit(0)).count() == 0


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, n, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[key(i)].append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, n, percent):
    docs, rows = corpus
    sets, root = classes(rows, n, percent)
    real = lambda i: None if i == (1 << 63) - 1 else i
    got = neardup.classes(docs, n, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[key(r.doc_id)]}
        assert r.component_id == real(root[key(r.doc_id)]) and r.kept == (r.doc_id == r.component_id), r
    kept = neardup.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {real(i) for i in root if root[i] == i}
    assert neardup.classes(docs.limit(0)).count() == 0


def test_links_between_members_that_their_hub_does_not_link(spark):
    """A chain: neighbours are alike, ends are not; all is one class, whatever hub a bucket has."""
    rng = random.Random(4)
    words, rows = ["w%d" % i for i in range(150)], []
    for i in range(40):
        rows.append((i, " ".join(words), None, None, None))
        for k in range(4):
            words[(i * 4 + k * 37) % 150] = "n%d_%d" % (i, rng.randrange(10**6))
    docs = spark.createDataFrame(rows, SCHEMA)
    _, root = classes([(r[0], r[1]) for r in rows], 3, 80)
    assert {r.doc_id: r.component_id for r in neardup.classes(docs, 3, 80).collect()} == root


def test_signature_distance_guarantee():
    """Any pair within the radius shares a key."""
    rng = random.Random(8)
    for percent in (80, 85):
        most = neardup.radius(percent)
        chunks = np.array_split(np.arange(neardup.PLACES), (most + 1) // 2)
        for _ in range(300):
            wrong = set(rng.sample(range(neardup.PLACES), most))
            assert any(len(wrong & set(c.tolist())) <= 1 for c in chunks)
