"""Classifiers, language ID, decontamination and the pipeline: held-out accuracy, brute force, awkward rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, language, mixing, neardup, personal, quality, substring, toxicity
from tidemark.llm.linear import Grams, fit
from tidemark.llm.textops import Words, text_view

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "x", "de", None, 1), (4, "x", "de", None, 1), (5, "é" * 70_000, "fr", "b", 70_000), (None, "null id", None, "b", 7), (6, "12 345 !!", "es", "b", 9), (7, "w " * 60_000, "en", "c", 120_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("label", "score", "row", "ids", "kept"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)]


def test_quality_counts_and_model(spark, tables, awkward):
    model = quality.train(tables["documents"], tables["labels"])
    both = tables["documents"].unionByName(awkward.select(tables["documents"].columns))
    texts = collections.defaultdict(list)
    for r in both.collect():
        texts[r.doc_id].append(r.text)
    label = {r.doc_id: r.quality for r in tables["labels"].collect()}
    right = n = 0
    for r in quality.score(both, model).collect():
        assert [r[c] for c in quality.STATS] in [stats(t) for t in texts[r.doc_id]]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5) and 0 <= r.probability <= 1
        if r.doc_id in label and out(r.doc_id) and len(texts[r.doc_id]) == 1 and not r.base_failed:
            n, right = n + 1, right + (r.kept == bool(label[r.doc_id]))
    assert n > 30 and right / n > 0.95
    assert quality.keep(awkward, model).columns == awkward.columns and quality.score(awkward.limit(0), model).count() == 0
    empty = quality.train(tables["documents"].limit(0), tables["labels"])
    assert quality.score(awkward, empty).count() == awkward.count()


def test_toxicity(spark, tables, awkward):
    model = toxicity.train(tables["documents"], tables["labels"])
    label = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    got = toxicity.score(tables["documents"], model).collect()
    assert all(r.held_out == out(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    order = sorted(held, key=lambda r: r.score)
    ones = sum(label[r.doc_id] for r in held)
    ranks = sum(k for k, r in enumerate(order) if label[r.doc_id]) - ones * (ones - 1) / 2
    assert ones > 5 and ranks / (ones * (len(held) - ones)) > 0.9
    odd = toxicity.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(awkward.limit(0), model).count() == 0


def test_toxic_rows_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), toxicity.train(docs, labels)).collect() if r.held_out]
    toxic = [r.predicted for r in held if label[r.doc_id] == 1]
    clean = [r.predicted for r in held if label[r.doc_id] == 0]
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_bayes_ratios_and_learning():
    grams = Grams(chars=(3,), bits=12)
    texts = [f"nice day {i}" for i in range(30)] + [f"vile day {i}" for i in range(30)]
    rows = list(grams.rows(*text_view(pa.array(texts))))
    model = fit(rows, np.array([0] * 30 + [1] * 30), grams, unit=False, bayes=True, l2=1e-3)
    p = model.scores(*text_view(pa.array(["a nice one", "a vile one", None])))
    assert p[0] < 0.2 < 0.8 < p[1] and np.isfinite(p[2])


def test_language(spark, tables, awkward):
    model = language.train(tables["documents"])
    truth = {r.doc_id: r.lang for r in tables["documents"].collect()}
    got = language.identify(tables["documents"], model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == out(r.doc_id) for r in got) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = collections.defaultdict(set)
    for r in language.identify(awkward, model).collect():
        odd[r.doc_id].add((r.lang_pred, 0 <= r.score <= 1))
    assert odd[1] == odd[2] == odd[3] == odd[6] == {("und", True)} and odd[4] != {("und", True)} and len(odd[7]) == 1
    assert language.train(awkward.limit(0)) is None and language.identify(awkward, None).count() == awkward.count()


def test_forward_sums_all_segmentations():
    """The forward pass equals the sum over explicit segmentations."""
    rng = random.Random(6)
    texts = {"".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(20)}
    vocabulary = language.Pieces.of(texts)
    p = np.array([[rng.random()] for _ in range(len(texts) + 1)])
    p[-1] = language.RARE
    of = lambda t: int(vocabulary.numbers(np.array([ord(c) for c in t], np.uint32))[len(t) - 1][0])
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(30)]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    logs = language.Lattice(vocabulary, points, np.cumsum([0, *map(len, words)])).logs(p)
    for w, got in zip(words, logs[:, 0]):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(w[last:i])
                    last = i
            numbers = [of(x) if len(x) <= vocabulary.longest else -1 for x in parts]
            if all(k >= 0 or len(x) == 1 for k, x in zip(numbers, parts)):
                total += float(np.prod([p[k, 0] for k in numbers]))
        assert np.isclose(np.exp(got), total)


def test_words_of_any_length_sum_all_segmentations():
    """Rescaling changes nothing, and no cut is made in a long word."""
    rng = random.Random(9)
    texts = {"a", "b", "ab", "ba", "aab", "abab", "b" * 11}
    vocabulary = language.Pieces.of(texts)
    p = np.array([[rng.random(), rng.random() / 50] for _ in range(len(texts) + 1)])
    of = {t: int(vocabulary.numbers(np.array([ord(c) for c in t], np.uint32))[len(t) - 1][0]) for t in texts}
    words = ["".join(rng.choices("abc", k=n)) for n in (1, 7, 8, 9, 40, 41, 100, 700)]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    got = language.Lattice(vocabulary, points, np.cumsum([0, *map(len, words)])).logs(p)
    for w, logs in zip(words, got):
        for k in range(2):
            one, scale = [1.0], [0.0]
            for end in range(1, len(w) + 1):
                total = 0.0
                for n in range(1, min(end, 11) + 1):
                    piece = w[end - n : end]
                    if piece in of or n == 1:
                        total += one[end - n] * np.exp(scale[end - n] - scale[end - 1]) * p[of.get(piece, -1), k]
                one.append(1.0)
                scale.append(scale[-1] + np.log(total))
            assert np.isclose(logs[k], scale[-1])


def test_every_piece_of_the_vocabulary_counts():
    texts, vocabulary = language.piece_texts(), language.pieces()
    assert len(vocabulary.code) == len(texts) > 25_000 and vocabulary.longest == max(map(len, texts)) > 8
    for t in sorted(texts)[::97]:
        assert vocabulary.numbers(np.array([ord(c) for c in t], np.uint32))[len(t) - 1][0] >= 0


def test_masks_survive_substitutions():
    """Any 13 of 16 words, and any two substitutions in 12, leave a seed."""
    for size, n in ((12, 2), (13, 2), (16, 3)):
        for wrong in itertools.combinations(range(size), n):
            assert any(all(p + i not in wrong for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(size - len(m) + 1))


def leaks(text, item, least=13):
    """The overlap of most matches by comparing all diagonals word by word, as (matched, length, start), or None."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d, q = (WORD.findall((t or "").translate(lower)) for t in (text, item))
    need, span, best = min(least, -(-4 * len(q) // 5)), min(5 * least // 4, len(q)), None
    for shift in range(-len(q) + 1, len(d)):
        same = {i for i in range(max(0, shift), min(len(d), len(q) + shift)) if d[i] == q[i - shift]}
        spans = [i for i in sorted(same) if len(same & set(range(i, i + span))) >= need]
        while spans:
            start, end = spans[0], spans[0] + span
            while spans and spans[0] <= end:
                end = max(end, spans.pop(0) + span)
            inside = [i for i in sorted(same) if start <= i < min(end, len(d), len(q) + shift)]
            found = (len(inside), inside[-1] + 1 - start, start)
            if best is None or (found[0], -found[2]) > (best[0], -best[2]):
                best = found
    return best


def test_decontamination_is_brute_force(spark):
    """Every overlap that comparing all positions finds, with its size, and no other; 3 substitutions in 16 words are survived."""
    rng = random.Random(12)
    prose = lambda n, k=3000: ["w%d" % rng.randrange(k) for _ in range(n)]
    items = [prose(rng.choice([13, 14, 16, 20, 40, 90, 600])) for _ in range(24)]
    texts = []
    for i in range(150):
        item = list(items[i % 24])
        a = rng.randrange(max(1, len(item) - 30))
        part = item[a : a + rng.choice([12, 13, 16, 20, 40, 700])]
        for k in rng.sample(range(len(part)), rng.choice([0, 0, 1, 2, 3, len(part) // 6])):
            part[k] = "x%d" % rng.randrange(9)
        texts.append(" ".join(prose(rng.randint(0, 60)) + part + prose(rng.randint(0, 60))))
    texts += ["w1 " * 300, " ".join(items[0] * 3), None, ""]
    items += [["w1"] * 30, ["w1"] * 16]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.length, r.start) for r in decontaminate.overlaps(docs, benchmark).collect()}
    want = {(d, i): x for d, t in enumerate(texts) for i, q in enumerate(items) if (x := leaks(t, " ".join(q)))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 90
    assert {k: v for k, v in got.items()} == want
    assert max(v[0] for v in want.values()) > 400


def test_an_overlap_is_as_long_as_it_is(spark):
    words = ["v%d" % i for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(["a"] * 50 + words[200:700] + ["b"] * 50), None, None, None)], SCHEMA)
    r = decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")).first()
    assert (r.matched, r.length, r.start) == (500, 500, 50)


def thue_morse(a, b, n=2048):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join((a, b)[x] for x in t), "".join((b, a)[x] for x in t)


def test_words_that_linear_hashes_confuse(spark):
    """The Thue-Morse word and its complement are one under every polynomial modulo a power of two."""
    t, u = thue_morse("a", "b")
    assert len(set(Words(*text_view(pa.array([t, u]))).code)) == 2
    assert [x.tolist() for x in quality.counts(*text_view(pa.array([f"{t}\n{u}"])))][3] == [0]
    assert [x.tolist() for x in quality.counts(*text_view(pa.array([f"{t}\n{u}\n{t}"])))][3] == [1]
    filler = ["w%d" % i for i in range(49)]
    rows = [(1, " ".join([*filler, t])), (2, " ".join([*filler, u])), (3, f"x y {t}"), (4, f"x y {u}"), (5, f"x y {t} x y {u}")]
    docs = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring.deduplicated(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.classes(docs.where("doc_id > 2"), 3, 85).collect()}
    assert got == {3: (3, 1), 4: (4, 1), 5: (5, 4)}
    many = spark.createDataFrame([(1, " ".join([t] * 20), None, None, None)], SCHEMA)
    assert decontaminate.overlaps(many, spark.createDataFrame([(1, " ".join([u] * 20))], "item_id bigint, text string")).count() == 0


def test_decontamination(spark, awkward):
    rng = random.Random(3)
    prose = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    items = [prose(rng.randint(14, 60)) for _ in range(25)] + ["only three words", None, "", "A"]
    items.append(items[0])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows, leaks = [], set()
    for i in range(120):
        body, item = prose(rng.randint(0, 150)), rng.randrange(25)
        if i % 3 == 0:
            words = items[item].split()
            for k in rng.sample(range(len(words)), len(words) // 12):
                words[k] = "other"
            text, _ = f"{body}\n{' '.join(words).upper()} {prose(5)}", leaks.add((100 + i, item))
            leaks.update({(100 + i, 29)} if item == 0 else ())
        else:
            text = body
        rows.append((100 + i, text, None, None, None))
    rows.append((300, "say only three words now", None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = decontaminate.overlaps(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got} - {(r.doc_id, r.item_id) for r in got if r.item_id == 28}
    assert found == leaks | {(300, 25)}
    assert all(5 * r.matched >= 4 * r.length for r in got)
    left = decontaminate.clean(docs, benchmark.where("item_id <> 28"))
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in leaks} - {300} and left.columns == docs.columns
    assert decontaminate.overlaps(awkward, benchmark.where("item_id <> 28")).count() == 0
    assert decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0 and decontaminate.clean(awkward, benchmark.limit(0)).count() == awkward.count()


def test_benchmark_in_blocks(spark, tables, monkeypatch):
    whole = sorted(map(str, decontaminate.overlaps(tables["documents"], tables["benchmark"]).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert whole and sorted(map(str, decontaminate.overlaps(tables["documents"], tables["benchmark"]).collect())) == whole


def test_pipeline_stages(spark, tables):
    docs = tables["documents"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "mixing"]
    model = quality.train(docs, tables["labels"])
    now = docs.cache()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, SF).cache()
        ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
        before, kept = ids(now), ids(after)
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            assert kept == collections.Counter(r.doc_id for r in quality.score(now, model).where("kept").collect())
        if k == 1:
            assert kept == collections.Counter(r.doc_id for r in neardup.classes(now).where("kept").collect()) and len(kept) < len(before)
        if k == 2:
            bad = {r.doc_id for r in decontaminate.overlaps(now, tables["benchmark"]).collect()}
            assert kept == collections.Counter({i: n for i, n in before.items() if i not in bad}) and bad
        if k == 3:
            assert kept == before
            assert personal.report(after).agg(F.sum(F.col("n_email") + F.col("n_card") + F.col("n_phone") + F.col("n_ip"))).first()[0] == 0
            assert after.where("n_chars <> length(text)").count() == 0
        if k == 4:
            want = {r.doc_id: r.taken for r in mixing.plan(now).collect() if r.taken}
            assert {r.doc_id: r.mix_words for r in after.collect()} == want
        now = after


def test_pipeline_stages_keep_rows_whole(spark, tables, awkward):
    """Every stage takes nulls, empty and very long texts, repeated rows and columns named as its own are, and hands all columns on."""
    names = ["size", "row", "gone", "taken", "words", "spans", "f", "key", "hub", "_size", "_id", "_gone", "prob", "kept", "value"]
    docs = tables["documents"].where("doc_id < 60").unionByName(awkward.select(tables["documents"].columns))
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.columns == [*docs.columns, *(["mix_words"] if name == "mixing" else [])]
        rows = after.collect()
        assert rows and all(r[c] == c + ("null" if r.doc_id is None else str(r.doc_id)) for r in rows for c in names)
        assert stage(spark, docs.limit(0), SF).count() == 0
    again = mixing.mix(mixing.mix(docs))
    assert again.columns.count("mix_words") == 1 and again.count()


def test_words_of_slices():
    texts = ["a bb a\tbb ccc", None, "", "x", " é bb a bb\x0b", "y" * 3_000_000 + " z"]
    data, offsets = text_view(pa.array(texts))
    words = Words(data, offsets)
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    plain = [w for t in texts for w in WORD.findall(t or "")]
    by = collections.defaultdict(set)
    for w, c in zip(plain, words.code):
        by[w].add(int(c))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
