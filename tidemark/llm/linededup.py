"""Line dedup with two Bloom filters: what is seen once, what is seen twice.

1. Each chunk of documents hashes the keys of its lines, once a document, and sends the cells of those hashes to the shard
   that holds their range of both filters. A shard reads one chunk after the other: a cell that is set in the first filter, or
   that a chunk itself holds for two documents, is set in the second one. It answers a bit for each cell sent. The filters
   have a cell for about each eight bytes of text, spread over as many shards as that takes: their load, and so the share of
   false alarms, is one and the same at every size of the corpus.
2. Only keys whose every cell is in the second filter are suspected repeats. A chunk sends 192 bits of each (the hash of the
   filters, which is not linear, and a BLAKE2b of 128 bits) and its `least_docs` largest ids; two keys would be taken for one
   with a chance below 2**-110 among 10**12 lines. Their shard merges the ids, of which it keeps as many, so the count of
   documents is exact up to the threshold and the largest one known. A key in a single document is in the second filter by a
   false alarm only and falls out here.
3. Each document drops the lines of keys that are in enough documents, unless it has the largest id of them.

A hot line costs its shard one entry a chunk, however often the chunk has it. A chunk sends at most two cells a line, so the
messages are never more than the lines, whatever the number of chunks and shards.

Null and empty texts are one empty line. Documents are told apart by id: rows of one id count once, each of them keeps or
drops its lines alike, and equal rows are worked on once. A null id is an id too, larger than all others. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import Corpus, answered, corpus, dealt, ids, packed, told, unpacked
from tidemark.llm.textops import _SPACE, LOWER, SLICE_BYTES, U, mix, range_hashes, run_sums, text_view

#: Cells of each hash.
CELLS = 2
CHUNK_BYTES = 16 << 20
NONE = np.iinfo(np.int64).min


class Lines:
    """Lines of a slice: byte ranges [start, end) without the line feed, the first line of each row in `first` (one entry
    more than rows), and of those whose key is long enough (`some`) the ranges and hashes of the keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_chars: int):
        feeds = np.flatnonzero(data == 10)
        rows, before = len(offsets) - 1, np.searchsorted(feeds, offsets)
        self.first = before + np.arange(rows + 1)
        self.data, n = data, int(self.first[-1])
        self.start, self.end = np.empty(n, np.int64), np.empty(n, np.int64)
        opens = np.zeros(n, bool)
        opens[self.first[:-1]] = True
        self.start[opens], self.start[~opens] = offsets[:-1], feeds + 1
        closes = np.zeros(n, bool)
        closes[self.first[1:] - 1] = True
        self.end[closes], self.end[~closes] = offsets[1:], feeds
        solid = np.flatnonzero(~_SPACE[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        begin[a < b], end[a < b] = solid[a[a < b]], solid[b[a < b] - 1] + 1
        self.some = np.flatnonzero(lead[end] - lead[begin] >= least_chars)
        self.lower = LOWER[data]
        self.key = begin[self.some], end[self.some]
        self.hash = range_hashes(self.lower, *self.key)
        self.row = np.searchsorted(self.first, self.some, "right") - 1


def parts(rows: pa.Table, least_chars: int) -> Iterator[tuple[slice, Lines]]:
    """The chunk's rows in slices of bounded text, as lines."""
    data, offsets = text_view(rows["text"])
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield slice(at, to), Lines(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], least_chars)
        at = to


def keys(rows: pa.Table, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document id of every line of the chunk that has a key, in order."""
    own, hashed, doc = ids(rows), [np.empty(0, U)], [np.empty(0, np.int64)]
    for part, lines in parts(rows, least_chars):
        hashed.append(lines.hash)
        doc.append(own[part][lines.row])
    return np.concatenate(hashed), np.concatenate(doc)


def cells(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(hashed + U(k)) >> U(64 - bits) for k in range(CELLS)]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Mask of the entries that differ from the one before in some column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def seen_twice(asked: list[list[np.ndarray]], low: int, size: int) -> list[np.ndarray]:
    """Both filters of a range of cells, filled chunk by chunk; of each cell asked, whether it was seen twice."""
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    for cell, by_two in asked:
        at = (cell - U(low)).astype(np.int64)
        twice[at] |= once[at] | by_two.astype(bool)
        once[at] = True
    return [twice[(cell - U(low)).astype(np.int64)].astype(np.uint8) for cell, _ in asked]


def filters(all_: Corpus, least_chars: int, bits: int) -> DataFrame:
    """(chunk, kind, shard, body): the second filter's answers to each chunk; the kind is the number of the cell."""
    shards, width = all_.shards, (1 << bits) // all_.shards

    def sketch(rows: pa.Table, _: object) -> list:
        hashed, doc = keys(rows, least_chars)
        order = np.lexsort((doc, hashed))
        hashed = hashed[order][starts(hashed[order], doc[order])]
        sent = []
        for k, cell in enumerate(cells(hashed, bits)):
            cell, n = np.unique(cell, return_counts=True)
            sent += [(k * shards + at, x) for at, x in dealt(cell, bits, shards, (n >= 2).astype(np.uint8))]
        return sent

    def merge(rows: pa.Table) -> pa.Table:
        shard = int(rows["shard"][0].as_py())
        got = seen_twice([unpacked(x) for x in rows["body"].to_pylist()], shard % shards * width, width)
        kind = pa.array([shard // shards] * len(got), pa.int32())
        return pa.table({"chunk": rows["chunk"], "kind": kind, "shard": pa.array([shard % shards] * len(got), pa.int32()), "body": pa.array([packed(x) for x in got], pa.binary())})

    return all_.ask(sketch).groupBy("shard").applyInArrow(merge, "chunk int, kind int, shard int, body binary")


def suspects(rows: pa.Table, answers: pa.Table, least_chars: int, bits: int) -> tuple[np.ndarray, ...]:
    """(mask of the lines with a key, place of each masked line among the chunk's distinct suspects, their three words, ids by line)."""
    hashed, doc = keys(rows, least_chars)
    sure = np.ones(len(hashed), bool)
    for k, cell in enumerate(cells(hashed, bits)):
        _, back = np.unique(cell, return_inverse=True)
        sure &= told(answers, k)[back].astype(bool)
    digest, at = [], 0
    for _, lines in parts(rows, least_chars):
        mine = np.flatnonzero(sure[at : at + len(lines.hash)])
        at += len(lines.hash)
        view = memoryview(lines.lower)
        digest += [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lines.key[0][mine].tolist(), lines.key[1][mine].tolist(), strict=True)]
    two, three = np.frombuffer(b"".join(digest), U).reshape(-1, 2).T
    one, doc = hashed[sure], doc[sure]
    order = np.lexsort((three, two, one))
    one, two, three = one[order], two[order], three[order]
    new = starts(one, two, three)
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(new) - 1
    return sure, place, (one[new], two[new], three[new]), doc


def largest(place: np.ndarray, doc: np.ndarray, n: int, most: int) -> np.ndarray:
    """The `most` largest distinct ids of each of n places, in falling order; NONE where there are fewer."""
    order = np.lexsort((doc, place))[::-1]
    place, doc = place[order], doc[order]
    new = starts(place, doc)
    place, doc = place[new], doc[new]
    rank = np.arange(len(place)) - np.searchsorted(-place, -place)
    out = np.full((n, most), NONE)
    some = rank < most
    out[place[some], rank[some]] = doc[some]
    return out


def deduplicated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept): kept lines joined by line feeds. Keys of least_chars code points or
    more that least_docs (2 or more) documents hold stay in the largest id alone."""
    if least_docs < 2:
        raise ValueError("a repeat takes two documents")
    rows = corpus(docs, chunk_bytes)
    all_ = Corpus(rows.texts.groupBy("chunk", "doc_id", "text").agg(F.count("*").alias("copies")), rows.total, rows.shards)
    bits, shards = max(16, all_.bits - 4), all_.shards

    def candidates(rows: pa.Table, answers: pa.Table) -> list:
        _, place, words, doc = suspects(rows, answers, least_chars, bits)
        most = largest(place, doc, len(words[0]), least_docs)
        return dealt(words[0], 64, shards, words[1], words[2], *map(np.ascontiguousarray, most.T))

    def confirm(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
        """For each entry, the largest id of its key, NONE if the key is in too few documents."""
        one, two, three, *doc = (np.concatenate([x[i] for x in asked]) for i in range(3 + least_docs))
        order = np.lexsort((three, two, one))
        key = np.empty(len(one), np.int64)
        key[order] = np.cumsum(starts(one[order], two[order], three[order])) - 1
        every, many = np.concatenate(doc), np.tile(key, least_docs)
        most = largest(many[every != NONE], every[every != NONE], int(key.max(initial=-1)) + 1, least_docs)
        answer = np.where(most[:, -1] == NONE, NONE, most[:, 0])[key]
        return np.split(answer, np.cumsum([len(x[0]) for x in asked])[:-1])

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        sure, place, _, doc = suspects(rows, answers, least_chars, bits)
        keeper = told(answers, CELLS)
        gone = np.zeros(len(sure), bool)
        if len(place):
            gone[sure] = (keeper[place] != NONE) & (doc < keeper[place])
        n_lines, n_dropped, kept, at = [], [], [], 0
        for _, lines in parts(rows, least_chars):
            keep = np.ones(len(lines.start), bool)
            keep[lines.some[gone[at : at + len(lines.some)]]] = False
            at += len(lines.some)
            n_lines.append(np.diff(lines.first))
            n_dropped.append(run_sums(~keep, lines.first))
            view = lines.data.tobytes()
            bounds = zip(lines.start.tolist(), lines.end.tolist(), keep.tolist(), strict=True)
            whole = [view[a:b] if k else None for a, b, k in bounds]
            for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True):
                kept.append(b"\n".join(x for x in whole[a:b] if x is not None))
        digest = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table({"doc_id": rows["doc_id"], "copies": rows["copies"], "n_lines": np.concatenate(n_lines), "n_dropped": np.concatenate(n_dropped), "kept_sha256": digest, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    second = filters(all_, least_chars, bits)
    exact = answered(all_.ask(candidates, second), confirm, CELLS)
    out = all_.over(cut, "doc_id bigint, copies bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept string", second.unionAll(exact))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
