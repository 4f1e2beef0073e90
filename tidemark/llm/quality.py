"""Quality rules: a hashed word and character n-gram logistic regression, calibrated, plus base
counts that any rule set starts from.

A null or empty text has no words and fails the base rules. Repeated rows and ids are judged each
on their own; extra columns are ignored by score() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import Grams, Model, calibrated, features, sample, share
from tidemark.llm.textops import Words, covered, mix, range_hashes, run_sums, slices

GRAMS = Grams(chars=(2, 3), words=(1, 2), lower=False)
THRESHOLD = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def train(docs: DataFrame, labels: DataFrame, each: int = 1000) -> Model:
    """Fits on up to `each` labelled rows of either label that are not held out."""
    rows, y = features(sample(docs, labels, "quality", each), GRAMS)
    return calibrated(rows, y, GRAMS, unit=True, bayes=False, l2=1e-4, prior=share(labels, "quality"))


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """STATS of each row of a slice."""
    words = Words(data, offsets)
    inside = covered(len(data), words.start, words.end)
    word_chars = run_sums(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = run_sums(SYMBOLS[data], offsets)
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))[: len(start)]
    end = end - (data[end - 1] == 10)
    with_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[with_word], end[with_word]
    row = np.searchsorted(offsets, start, "right") - 1
    several = np.flatnonzero(again(row, range_hashes(data, start, end))[1])
    view, seen, lines = data.tobytes(), set(), np.zeros(len(offsets) - 1, np.int64)
    for r, a, b in zip(row[several].tolist(), start[several].tolist(), end[several].tolist(), strict=True):
        line = (r, view[a:b])
        lines[r] += line in seen
        seen.add(line)
    at, codes = words.windows(5)
    several = again(words.row()[at], codes)[1]
    twice = covered(len(words.start), at[several], at[several] + 5) if len(at) else np.zeros(len(words.start), bool)
    return [words.counts, word_chars, symbols, lines, run_sums(twice, words.first)]


def again(row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equals an earlier item of its row; its value occurs twice or more in its row."""
    key = codes ^ mix(row)
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first[back] != np.arange(len(key)), (n > 1)[back]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, STATS, probability (of good quality), base_failed, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            stats = [x.astype(np.int64) for x in counts(data, offsets)]
            p = shared.value.scores(data, offsets)
            failed = (stats[0] < MIN_WORDS) | (100 * stats[4] > MAX_REPEAT_PERCENT * stats[0])
            columns = [part.column(0), *map(pa.array, stats), pa.array(p), pa.array(failed), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *STATS, "probability", "base_failed", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in STATS) + ", probability double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(judge, schema)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the model keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            stats = counts(data, offsets)
            good = (stats[0] >= MIN_WORDS) & (100 * stats[4] <= MAX_REPEAT_PERCENT * stats[0])
            good &= shared.value.scores(data, offsets) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(judge, docs.schema)
