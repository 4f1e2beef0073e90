"""Substring dedup over windows of words, with a count-min prefilter.

1. Each chunk sketches its windows: DEPTH rows of cells, counts saturated at 2. Sketches are merged
   by ranges of cells; a cell's total is at least the count of every window in it. Width follows the
   size of the corpus (2**bits cells a row), so the share of false alarms stays put as it grows.
2. Only windows whose every cell totals two or more are grouped, by 128 bits: the hash of the sketch,
   which is not linear, and 64 bits of a BLAKE2b of their words, with the smallest doc_id of each. A
   window that occurs in two documents is always among them, so none is lost.
3. Each document drops the words covered by windows that also start in a smaller doc_id.

Null and empty texts have no windows. Rows with equal ids never remove from each other; a null id
counts as larger than all others. Texts of fewer than `width` words lose nothing. Extra columns are
ignored by deduplicated(), which returns the kept text as well.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunks import answered, corpus, dealt, ids, told
from tidemark.llm.textops import SLICE_BYTES, U, Words, covered, mix, run_sums, text_view

DEPTH = 2


def windows(rows: pa.Table, width: int) -> np.ndarray:
    """A hash of every window of the chunk, in order; only the sketch goes by it."""
    found = [words.windows(width)[1] for _, words in parts(rows)]
    return np.concatenate(found) if found else np.empty(0, U)


def digests(rows: pa.Table, width: int, some: np.ndarray) -> np.ndarray:
    """64 bits of a BLAKE2b of the words themselves, joined by one space, for the windows that the mask picks."""
    out, at = [], 0
    for _, words in parts(rows):
        where = words.windows(width)[0]
        first = where[some[at : at + len(where)]]
        at += len(where)
        if not len(first):
            continue
        size = words.end - words.start + 1
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(words.start - begin, size)
        text = np.append(words.data, np.uint8(32))[place]
        text[begin + size - 1] = 32
        view, begin_, end_ = memoryview(text), begin[first].tolist(), (begin + size - 1)[first + width - 1].tolist()
        out += [blake2b(view[a:b], digest_size=8).digest() for a, b in zip(begin_, end_, strict=True)]
    return np.frombuffer(b"".join(out), U)


def parts(rows: pa.Table) -> list[tuple[slice, Words]]:
    """The chunk's rows in slices of bounded text, as words."""
    data, offsets = text_view(rows["text"])
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield slice(at, to), Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def cells(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(hashed + U(row)) >> U(64 - bits) for row in range(DEPTH)]


def repeated(hashed: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """Mask of the windows whose cells all total two or more."""
    sure = np.ones(len(hashed), bool)
    for row, cell in enumerate(cells(hashed, bits)):
        _, back = np.unique(cell, return_inverse=True)
        sure &= told(answers, row)[back].astype(bool)
    return sure


def entries(rows: pa.Table, answers: pa.Table, width: int, bits: int, known: int | None = None) -> tuple[np.ndarray, ...]:
    """(mask of windows, place of each masked window among the entries, key, key2, smallest id). If the number of entries is
    known and there are as many hashes, every hash has one digest, and digests need not be made again."""
    hashed = windows(rows, width)
    sure = repeated(hashed, answers, bits)
    one = hashed[sure]
    counts = np.concatenate([np.maximum(0, w.counts - width + 1) for _, w in parts(rows)])
    doc = np.repeat(ids(rows), counts)[sure]
    order = np.lexsort((doc, one))
    two = np.zeros(len(one), U)
    if known is None or known != int((np.diff(one[order]) != 0).sum()) + (len(one) > 0):
        two = digests(rows, width, sure)
        order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(new) - 1
    return sure, place, one[new], two[new], doc[new]


def sum_cells(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
    keys, back = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([x[1] for x in asked]), minlength=len(keys)) >= 2
    return np.split(total[back].astype(np.uint8), np.cumsum([len(x[0]) for x in asked])[:-1])


def smaller_elsewhere(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each entry, whether the smallest id of its key is below the entry's own."""
    one, two, doc = (np.concatenate([x[i] for x in asked]) for i in range(3))
    order = np.lexsort((doc, two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = doc[order][new][np.cumsum(new) - 1]
    out = np.empty(len(one), np.uint8)
    out[order] = least < doc[order]
    return np.split(out, np.cumsum([len(x[0]) for x in asked])[:-1])


def deduplicated(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept words joined by one space."""
    all_ = corpus(docs)
    bits, shards = all_.bits, all_.shards

    def sketch(rows: pa.Table, _: object) -> list:
        sent = []
        for row, cell in enumerate(cells(windows(rows, width), bits)):
            cell, n = np.unique(cell, return_counts=True)
            sent += [(row * shards + k, x) for k, x in dealt(cell, bits, shards, np.minimum(n, 2).astype(np.uint8))]
        return sent

    def candidates(rows: pa.Table, answers: pa.Table) -> list:
        return dealt(*(lambda e: (e[2], 64, shards, e[3], e[4]))(entries(rows, answers, width, bits)))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        later = told(answers, DEPTH).astype(bool)
        sure, place, _, _, least = entries(rows, answers, width, bits, len(later))
        own, n_words, n_removed, digest, kept = ids(rows), [], [], [], []
        at = used = 0
        for part, words in parts(rows):
            n = np.maximum(0, words.counts - width + 1)
            mine = sure[at : at + n.sum()]
            which = np.flatnonzero(mine)
            entry = place[used : used + len(which)]
            at, used = at + len(mine), used + len(which)
            gone = later[entry] | (np.repeat(own[part], n)[which] > least[entry])
            start = words.windows(width)[0][which[gone]]
            drop = covered(len(words.start), start, start + width)
            n_words.append(words.counts)
            n_removed.append(run_sums(drop, words.first))
            texts = joined(words, ~drop)
            kept += texts
            digest += [hashlib.sha256(x).hexdigest() for x in texts]
        return pa.table({"doc_id": rows["doc_id"], "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept_sha256": digest, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    estimate = answered_by_row(all_.ask(sketch), shards)
    exact = answered(all_.ask(candidates, estimate), smaller_elsewhere, DEPTH)
    return all_.over(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string", estimate.unionAll(exact))


def answered_by_row(asked: DataFrame, shards: int) -> DataFrame:
    """Totals of the sketch's cells; the kind of an answer is the row of the sketch."""
    got = answered(asked, sum_cells, 0)
    return got.selectExpr("chunk", f"cast(shard div {shards} as int) as kind", f"shard % {shards} as shard", "body")


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row joined by one space."""
    data = np.append(words.data, np.uint8(32))
    row = words.row()
    follows = np.zeros(len(keep), bool)
    last = np.full(len(words.counts), -1)
    kept = np.flatnonzero(keep)
    last[row[kept]] = kept
    follows[kept] = last[row[kept]] != kept
    data[words.end[follows]] = 32
    mask = covered(len(data), words.start[kept], words.end[kept] + follows[kept])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[kept], weights=(words.end - words.start + follows)[kept], minlength=len(last)).astype(np.int64))])
    whole = data[mask].tobytes()
    return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
