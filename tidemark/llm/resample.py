"""Importance resampling to a target distribution over hashed word and word-pair features.

Blocks of text are read by an Aho-Corasick automaton whose dictionary holds the block's distinct words, each between two
delimiters, with their CRC-32 (alone and with a space after it) and their length as payload. The scan emits the payloads in
the order of the words. The CRC of two adjacent words joined by a space is composed of their payloads: the first one's, moved
on by the length of the second through tables of the CRC's linear step, plus the second one's. No feature is ever built.

1. Counts by bucket of the corpus and of the target: a task adds up its own, so at most `buckets` rows leave it.
2. A bucket's gain is the logarithm of the target's smoothed share over the corpus's. Gains are a table of `buckets` numbers.
3. A second scan turns features into gains; a document's weight is their floored mean, its score adds seeded Gumbel noise.
4. Documents that are long enough are put in order of their scores by range partitions of about `slice_rows` rows; the ranks of
   a slice begin after the counts of those before it. The best `percent` of them are drawn.

Words are runs of digits, lower-case letters (A-Z only are lowered) and all code points from U+0080. A null or empty text has
none, weight 0 and is never drawn. Each row is a document of its own; equal ids have equal noise, ties of score go to the
smaller id, then null, then by place in the stored scores. An empty corpus or target works: shares are smoothed. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import stored
from tidemark.llm.textops import run_sums, slices

BUCKETS, BLOCK_BYTES = 10_000, 4 << 20
#: Of a byte: a space for what delimits words, else the byte, A-Z lowered.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
#: Lengths up to which moving a CRC on is a table.
TABLED = 64


def crc_step() -> np.ndarray:
    """The CRC register after a byte of each value, from the polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return value


def shifts() -> np.ndarray:
    """[length, byte, value]: what value in that byte of a CRC becomes when `length` more bytes follow; length 0 to TABLED."""
    step, now = crc_step(), np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    out = [now]
    for _ in range(TABLED):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


SHIFTS = shifts()


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes, TABLED at most."""
    out = np.zeros(len(crc), np.uint32)
    for byte in range(4):
        out ^= SHIFTS[length, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


class Dictionary:
    """An automaton over the distinct words of a block, and their payloads."""

    def __init__(self, block: bytes):
        self.words = list(dict.fromkeys(block.split()))
        self.crc = np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words))
        self.crc_space = np.fromiter((zlib.crc32(b" ", c) for c in self.crc.tolist()), np.uint32, len(self.words))
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(self.words):
            self.automaton.add_word(f" {word.decode()} ", k)
        self.automaton.make_automaton()

    def scan(self, text: str) -> np.ndarray:
        """The words of a text that begins and ends with a delimiter, as places in the dictionary, in their order."""
        return np.fromiter((k for _, k in self.automaton.iter(text)), np.int64)

    def pairs(self, word: np.ndarray) -> np.ndarray:
        """CRCs of each word, a space and the word after it."""
        first, second = word[:-1], word[1:]
        out = moved(self.crc_space[first], np.minimum(self.length[second], TABLED)) ^ self.crc[second]
        for i in np.flatnonzero(self.length[second] > TABLED).tolist():
            out[i] = zlib.crc32(self.words[second[i]], int(self.crc_space[first[i]]))
        return out


def scanned(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, words of each row, buckets of its features): features of all rows after one another, words before pairs in each block."""
    for batch, data, offsets in slices(batches, "text", BLOCK_BYTES):
        plain = data.tobytes().translate(PLAIN)
        texts = [plain[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if not plain.strip():
            yield batch, np.zeros(batch.num_rows, np.int64), np.empty((2, 0), np.int64)
            continue
        known = Dictionary(b" ".join(texts))
        each = [known.scan(f" {text.decode()} ") for text in texts]
        word = np.concatenate(each)
        n = np.fromiter(map(len, each), np.int64, len(each))
        bucket = np.stack([(known.crc % np.uint32(buckets))[word], np.append(known.pairs(word) % np.uint32(buckets), np.uint32(0))]).astype(np.int64)
        last = np.cumsum(n)[n > 0] - 1
        bucket[1, last] = -1  # no pair over a row's end
        yield batch, n, bucket


def counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for _, _, bucket in scanned(batches, buckets):
        total += np.bincount(bucket[bucket >= 0], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})


def counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without one are left out."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(counted, buckets=buckets), "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share of each bucket, floored."""
    held = np.zeros((2, buckets), np.int64)
    for row, texts in zip(held, (docs, target), strict=True):
        for bucket, n in counts(texts, buckets).collect():  # `buckets` rows at most
            row[bucket] = n
    (s, t), (all_s, all_t) = held.tolist(), held.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number drawn by seed and id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    padded = np.append(gain, 0)  # -1, which is no feature, gains nothing
    for batch, n, bucket in scanned(batches, len(gain)):
        first = np.concatenate([[0], np.cumsum(n)])
        features = np.maximum(2 * n - 1, 0)
        weight = run_sums(padded[bucket].sum(axis=0), first) // np.maximum(features, 1)
        drawn = np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": n, "n_features": features, "weight": weight, "score": weight + drawn})


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(weighed, gain=gain, seed=seed), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, order: list, n: int, slice_rows: int) -> DataFrame:
    """rows, stored, with `place`: 1, 2, 3, ... in that order, without a window over all of them."""
    dealt = rows.repartitionByRange(max(1, -(-n // slice_rows)), *order).withColumn("slice", F.spark_partition_id())
    dealt = stored(dealt)
    sizes = dealt.groupBy("slice").count()  # one row for each slice_rows rows
    before = sizes.select("slice", (F.sum("count").over(W.orderBy("slice")) - F.col("count")).alias("before"))
    return dealt.join(before, "slice").withColumn("place", F.col("before") + F.row_number().over(W.partitionBy("slice").orderBy(*order))).drop("slice", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, slice_rows: int = 50_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of each row: the best `percent` of the documents of least_words words or
    more have their rank, others null. Equal on every run."""
    scored = stored(scores(docs, gains(docs, target, buckets), seed).withColumn("row", F.monotonically_increasing_id()).withColumn("able", F.col("n_words") >= least_words))
    n, able = scored.agg(F.count("*"), F.count_if("able")).first()
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = ranked(scored, order, n, slice_rows)
    drawn = F.col("able") & (F.col("place") <= percent * able // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place").cast("bigint")).alias("rank"), "n_words")
