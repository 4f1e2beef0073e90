"""Benchmark decontamination by spaced seeds.

MASKS say which word positions a seed reads; the others are ignored, so a seed survives a substituted
word there. The seeds of all benchmark items are joined by hash with those of every document position;
around a hit the two texts are laid side by side on the hit's diagonal, as far as both go. An overlap is
a stretch of which every SPAN words hold `least` matching ones (of an item of fewer words, four fifths of
them), cut to its first and last match: 13 of 16 words by default. With these masks each such 16 words
leave a seed, so none is missed; so do any two substitutions in 12 words.

The benchmark is broadcast only in blocks of at most BLOCK_WORDS words; a larger one is split by a
hash of its items, and each block runs over the documents in turn. Words are lower-cased in A-Z.
Items and documents that are null, empty or shorter than a seed's words never match, except that an
item of fewer words than the shortest mask is searched as a whole. Repeated items and rows give a
result each. A null doc_id stays null. Extra columns are ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import U, Words, mix, slices, text_view

MASKS = ("111111", "1110111", "1101011001", "111001011")
BLOCK_WORDS, AT_ONCE = 1_000_000, 1 << 20
FILTER_BITS = 22


@dataclass(frozen=True)
class Index:
    """Seeds of a block of items, sorted by hash, and the items' words."""

    item_id: np.ndarray
    first: np.ndarray
    code: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray]]
    near: np.ndarray
    least: int

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document word, item word) where seeds agree, about AT_ONCE pairs at a time; a diagonal may come several times."""
        for offsets, (seed, place) in zip(shapes(), self.seeds, strict=True):
            if not len(seed):
                continue
            at, code = seeds_of(words.code, words.first, offsets)
            some = np.flatnonzero(self.near[code >> U(64 - FILTER_BITS)])
            low, high = np.searchsorted(seed, code[some], "left"), np.searchsorted(seed, code[some], "right")
            at, low, n = at[some], low, high - low
            total = np.append(0, np.cumsum(n))
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
                if m := int(total[b] - total[a]):
                    yield np.repeat(at[a:b], n[a:b]), place[np.arange(m) + np.repeat(low[a:b] - (total[a:b] - total[a]), n[a:b])]
                a = b

    def overlaps(self, words: Words) -> dict[str, np.ndarray]:
        """The overlap with most matches of each (row, item) that has one."""
        lines = np.empty((3, 0), np.int64)
        for doc, item in self.hits(words):
            row, which = np.searchsorted(words.first, doc, "right") - 1, np.searchsorted(self.first, item, "right") - 1
            lines = np.unique(np.concatenate([lines, np.stack([row, which, doc - item])], axis=1), axis=1)
        got = {k: [np.empty(0, np.int64)] for k in ("row", "item", "matched", "length", "start")}
        row, which, shift = lines
        low = np.maximum(words.first[row], self.first[which] + shift) if lines.size else shift
        size = np.minimum(words.first[row + 1], self.first[which + 1] + shift) - low if lines.size else shift
        total, a = np.append(0, np.cumsum(size)), 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
            self.extend(words, row[a:b], which[a:b], shift[a:b], low[a:b], size[a:b], got)
            a = b
        out = {k: np.concatenate(v) for k, v in got.items()}
        order = np.lexsort((out["start"], -out["matched"], out["item"], out["row"]))
        out = {k: v[order] for k, v in out.items()}
        new = np.ones(len(order), bool)
        new[1:] = (out["row"][1:] != out["row"][:-1]) | (out["item"][1:] != out["item"][:-1])
        return {k: v[new] for k, v in out.items()}

    def extend(self, words: Words, row: np.ndarray, which: np.ndarray, shift: np.ndarray, low: np.ndarray, size: np.ndarray, got: dict) -> None:
        """Adds the overlaps of whole diagonals: document words low to low + size beside item words that many less shift."""
        items = np.diff(self.first)[which]
        need, span = np.minimum(self.least, -(-4 * items // 5)), np.minimum(5 * self.least // 4, items)
        of = np.repeat(np.arange(len(row)), size)
        begin = np.cumsum(size) - size
        at = np.arange(len(of))
        d = at - np.repeat(begin - low, size)
        same = words.code[d] == self.code[d - shift[of]]
        hits = np.append(0, np.cumsum(same))
        # spans that begin at a match; one that would leave the diagonal ends there
        lead = np.flatnonzero(same)
        stop = np.minimum(lead + span[of[lead]], (begin + size)[of[lead]])
        dense = hits[stop] - hits[lead] >= need[of[lead]]
        lead, stop = lead[dense], stop[dense]
        if not len(lead):
            return
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] > stop[:-1]) | (of[lead[1:]] != of[lead[:-1]])
        first = np.flatnonzero(new)
        start, end = lead[first], np.maximum.reduceat(stop, first)
        last = np.flatnonzero(same)[np.searchsorted(np.flatnonzero(same), end) - 1] + 1
        k = of[start]
        for name, v in (("row", row[k]), ("item", which[k]), ("matched", hits[last] - hits[start]), ("length", last - start), ("start", d[start] - words.first[row[k]])):
            got[name].append(v)


def shapes() -> list[np.ndarray]:
    """Positions that each mask reads; then whole items of 1, 2, ... words, up to the shortest mask."""
    masks = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
    return masks + [np.arange(n) for n in range(1, min(map(len, MASKS)))]


def seeds_of(code: np.ndarray, first: np.ndarray, offsets: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of one shape's seeds that stay inside a row (or are all of it)."""
    span = int(offsets[-1]) + 1
    n = max(0, len(code) - span + 1)
    hashed = np.full(n, U(span))
    for k in offsets:
        hashed = hashed * U(0x9E3779B97F4A7C55) + code[k : k + n]
    room = np.repeat(first[1:], np.diff(first))[:n]
    at = np.arange(n)
    fits = at + span <= room
    if whole:
        fits &= (at + span == room) & (np.repeat(first[:-1], np.diff(first))[:n] == at)
    return at[fits], mix(hashed[fits])


def build(item_id: list[int], text: list[str | None], least: int = 13) -> Index:
    words = Words(*text_view(pa.array(text, pa.string())), lower=True)
    seeds, near = [], np.zeros(1 << FILTER_BITS, bool)
    for k, offsets in enumerate(shapes()):
        at, code = seeds_of(words.code, words.first, offsets, whole=k >= len(MASKS))
        order = np.argsort(code, kind="stable")
        seeds.append((code[order], at[order]))
        near[code >> U(64 - FILTER_BITS)] = True
    return Index(np.array(item_id), words.first, words.code, seeds, near, least)


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of parts of the benchmark, each of about BLOCK_WORDS words at most."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // (4 * BLOCK_WORDS)) or 1
    for k in range(n):
        part = items.where(F.pmod(F.hash("item_id", "text"), F.lit(n)) == k).toArrow()
        yield build(part["item_id"].to_pylist(), part["text"].to_pylist())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, length, start): for every document and item with an overlap that
    counts, the words that match, its length and its first word in the document."""
    rows, found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches, "text"):
                got = shared.value.overlaps(Words(data, offsets, lower=True))
                columns = [part.column(0).take(pa.array(got["row"])), pa.array(shared.value.item_id[got["item"]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[k], pa.int64()) for k in ("matched", "length", "start"))], ["doc_id", "item_id", "matched", "length", "start"])

        one = rows.mapInArrow(search, "doc_id bigint, item_id bigint, matched bigint, length bigint, start bigint")
        found = one if found is None else found.unionAll(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without an overlap that counts. No shuffle: each block of the
    benchmark filters the rows where they are."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[shared.value.overlaps(Words(data, offsets, lower=True))["row"]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
