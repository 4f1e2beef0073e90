"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of words with smallest period q that has at least max(`shortest`, `times` * q) words and that no
neighbouring word extends. Every word of a run occurs `times` times or more inside it. So:

1. Words that occur less often than that in their document cannot be in a run; they cut it into segments. In a shorter segment
   other words are too rare, which cut it again, until each segment left has only words that are frequent enough within it.
   The largest piece of a cut inherits the counts of the whole, less those of the others, which are the only ones to be
   counted again: a word is counted again only when its segment halves, n log n steps at worst.
2. What survives is scanned with lags. At scale w (1, 2, 4, ...) the lag of a place is the distance to the next place in the
   segment with the same w words. A run with w / 2 < q <= w has lag q at all its places but the last q + w - 1, since a
   primitive word of q <= w words does not meet itself sooner; and it has at least 4 q words, so there are such places. A
   stretch of equal lags is thus one run, whole: it starts where the stretch starts and ends q + w words after its last
   place. Names of 2 w words are made from two names of w words, exactly, and only of those that occur twice. All runs are
   found, in n log**2 n steps, whatever the length of the text.

Words are told apart by their bytes. A document is read in one piece, so the largest text bounds a task's memory. A null or
empty text has no words and no runs. Each row is a document of its own; rows may repeat. A null id stays null. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import _SPACE, covered, gathered, slices, word_spans

TIMES, SHORTEST = 4, 6
WORD = r"[^\x20\x09-\x0D]+"


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte range, equal for equal bytes."""
    bounds = np.zeros(2 * len(start) + 1, np.int64)
    bounds[1::2], bounds[2::2] = start, end
    column = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return column.take(pa.array(np.arange(1, 2 * len(start), 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


def pieces(lo: int, hi: int, cuts: list[int], shortest: int) -> list[tuple[int, int]]:
    edges = [lo - 1, *cuts, hi]
    return [(a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a - 1 >= shortest]


def split(words: list[int], times: int, shortest: int) -> list[tuple[int, int]]:
    """The segments that are left of a stretch of words when too rare ones cut it again and again."""
    where: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        where[word].append(i)
    counts = Counter(words)
    todo, done = [(0, len(words), counts, [w for w, n in counts.items() if n < times])], []
    while todo:
        lo, hi, counts, rare = todo.pop()
        if not rare:
            done.append((lo, hi))
            continue
        cuts = sorted(i for w in rare for i in inside(where[w], lo, hi))
        found = pieces(lo, hi, cuts, shortest)
        most = max(found, key=lambda x: x[1] - x[0], default=(lo, lo))
        for a, b in found:
            if (a, b) != most or 2 * (b - a) < hi - lo:
                own = Counter(words[a:b])
                todo.append((a, b, own, [w for w, n in own.items() if n < times]))
        if 2 * (most[1] - most[0]) >= hi - lo:
            gone = Counter(words[lo : most[0]])
            gone.update(words[most[1] : hi])
            for w, n in gone.items():
                counts[w] -= n
            todo.append((*most, counts, [w for w in gone if 0 < counts[w] < times]))
    return done


def inside(places: list[int], lo: int, hi: int) -> list[int]:
    """The ascending places within [lo, hi); there are few places of a rare word within, many perhaps outside."""
    return places[bisect_left(places, lo) : bisect_left(places, hi)]


def segments(word: np.ndarray, first: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the segments that survive. The first cut, in which most words go, is made for all rows at once."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, back, n = np.unique(row * (int(word.max(initial=0)) + 1) + word, return_inverse=True, return_counts=True)
    frequent = n[back] >= times
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = frequent[:-1] & (row[1:] == row[:-1]), frequent[1:] & (row[1:] == row[:-1])
    start, end = np.flatnonzero(frequent & ~before), np.flatnonzero(frequent & ~after) + 1
    long = end - start >= shortest
    found = [(a + x, a + y) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True) for x, y in split(word[a:b].tolist(), times, shortest)]
    return tuple(np.array(sorted(found), np.int64).reshape(-1, 2).T)


def runs(word: np.ndarray, start: np.ndarray, end: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs within the segments, by start, then period."""
    size = end - start
    segment = np.full(len(word), -1)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    segment[at] = np.repeat(np.arange(len(start)), size)
    name, found, w = np.full(len(word), -1), [], 1
    key = segment[at] * (int(word.max(initial=0)) + 1) + word[at]
    while len(at):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        some = (2 * lag > w) & (lag <= w)
        place, period = at[some], lag[some]
        opens = np.ones(len(place) + 1, bool)
        opens[1:-1] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
        head, tail = np.flatnonzero(opens[:-1]), np.flatnonzero(opens[1:])
        length = place[tail] - place[head] + period[tail] + w
        keep = length >= np.maximum(shortest, times * period[tail])
        found.append((place[head][keep], length[keep], period[tail][keep]))
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        number = np.empty(len(at), np.int64)
        number[order] = np.concatenate([[0], np.cumsum(~same)])
        name[at] = np.where(again, number, -1)
        old, at = at, at[again]
        at = at[at + w < len(word)]
        at = at[(name[at + w] >= 0) & (segment[at + w] == segment[at])]
        key = name[at] * (len(old) + 1) + name[at + w]
        name[old[~np.isin(old, at)]] = -1
        w *= 2
    begin, length, period = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(3))
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def reported(batches: Iterator[pa.RecordBatch], times: int, shortest: int, text: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        start, end, first = word_spans(data, offsets, ~_SPACE[data])
        word = names(data, start, end) if len(start) else np.empty(0, np.int64)
        begin, length, period = runs(word, *segments(word, first, times, shortest), times, shortest)
        row = np.searchsorted(first, begin, "right") - 1
        own = begin - first[row]
        best = np.lexsort((period, begin, -length, row))
        best = best[np.diff(row[best], prepend=-1) != 0]
        of = np.full(batch.num_rows, -1)
        of[row[best]] = best
        keep = ~covered(len(word), begin + period, begin + length)
        kept, bounds = gathered(data, start[keep], end[keep])
        edges = bounds[np.concatenate([[0], np.cumsum(keep)])[first]].tolist()
        view = memoryview(kept)
        collapsed = [bytes(view[a : max(a, b - 1)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        n = np.bincount(row, minlength=batch.num_rows)
        told = [f"{a},{b},{c}\n" for a, b, c in zip(own.tolist(), length.tolist(), period.tolist(), strict=True)]
        upto = np.concatenate([[0], np.cumsum(n)]).tolist()
        pick = lambda x: pa.array(x[of] if len(x) else np.zeros(len(of), np.int64), mask=of < 0)
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_runs": pa.array(n.astype(np.int64)),
            "start": pick(own),
            "length": pick(length),
            "period": pick(period),
            "exponent_milli": pick(1000 * length // np.maximum(period, 1)),
            "runs_sha256": pa.array([hashlib.sha256("".join(told[a:b]).encode()).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]),
            "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in collapsed]),
            "n_words": pa.array(np.diff(first)),
            "n_collapsed": pa.array(np.diff(np.concatenate([[0], np.cumsum(keep)])[first])),
        }
        if text:
            of_row = [list(zip(own[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns["runs"] = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in x] for x in of_row], shape)
            columns["collapsed"] = pa.array(collapsed, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(columns)


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_collapsed bigint"


def detect(docs: DataFrame, times: int = TIMES, shortest: int = SHORTEST, text: bool = True) -> DataFrame:
    """Per row of docs: its number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the
    collapsed text, in which a run keeps its first period; with `text`, the runs and the collapsed text themselves.
    `times` is 4 or more, which the scan of lags relies on."""
    if times < 4:
        raise ValueError("runs have four periods or more")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: reported(batches, times, shortest, text), SCHEMA + (", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if text else ""))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a repetition in each document whose h = crc32(decimal id) is divisible by 10: with g = floor(h / 10) and n
    words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); one space between
    words. A null id is left alone."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), word), " "))

    once = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), changed), 0)
    return F.when(h % 10 == 0, once).otherwise(text)
