"""Suffix-array dedup of byte strings, on a sample of suffixes chosen by content.

Every window of `width` bytes has one anchor: its smallest GRAM-byte piece under a fixed hash, the
leftmost of equals. Equal windows have equal anchors at equal places, and the windows of one anchor
are consecutive, so a document falls into segments (an anchor with the bytes of its windows) and
only anchors need to meet.

1. Chunks send their anchors' hashes to shards, which mark those seen twice or more and those seen
   more than HOT times.
2. Segments with marked anchors go to shards by anchor, equal ones of a chunk once, with the smallest
   doc_id. A hot anchor's windows go by their own hashes instead, so that its contexts spread.
3. In a chunk (for equal segments) and in a shard (for all windows of an anchor) suffixes are sorted by
   sort_suffixes, a mergesort: prefix polynomial hashes and binary search find the extension that two
   suffixes share, and the byte after it decides. What neighbours in the sorted order share (the LCP array) says which are
   equal over the whole width; those classes are verified on their bytes.
4. The answer says which windows of a segment also start in a smaller doc_id; covered bytes go.

Null and empty texts have no windows; texts shorter than `width` lose nothing; a null id counts as
larger than all others; rows with equal ids never remove from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunks import answered, corpus, dealt, ids, told
from tidemark.llm.textops import BASE, BYTE_CODE, TAIL, U, covered, eight, mix, powers, prefix_hashes, range_hashes, rolling, run_sums, text_view

GRAM, HOT, BLOCK, ENTRIES = 32, 4096, 1 << 16, 1 << 16


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a chunk as arrays: hash of the anchor, its place, first and last window start."""
    out, low, span = [(np.empty(0, U), *(np.empty(0, np.int64) for _ in range(3)))], U((1 << 20) - 1), width - GRAM + 1
    row_end = offsets[1:][np.diff(offsets) > 0]
    for at in range(0, max(0, len(data) - width + 1), BLOCK):
        piece = data[at : at + BLOCK + width - 1]
        n = len(piece) - width + 1
        hashed = rolling(BYTE_CODE[piece], GRAM)
        now, size = (hashed & ~low) | np.arange(len(hashed), dtype=U), 1
        while 2 * size <= span:
            now, size = np.minimum(now[:-size], now[size:]), 2 * size
        place = (np.minimum(now[:n], now[span - size : span - size + n]) & low).astype(np.int32)
        # windows that begin fewer than width bytes before a row's end are none
        ends = row_end[np.searchsorted(row_end, at, "right") : np.searchsorted(row_end, at + n + width - 1, "left")] - at
        inside = ~covered(n, np.clip(ends - width + 1, 0, n), np.clip(ends, 0, n))
        edge = np.ones(n + 1, bool)
        edge[1:n] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:] - 1
        first, last = first[inside[first]], last[inside[first]]
        own = place[first].astype(np.int64)
        out.append((mix(hashed[own] + U(GRAM)), own + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sort_suffixes(data: np.ndarray, start: np.ndarray, width: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, first width bytes) and the class of each one: equal exactly
    for equal group, width and bytes. width is one number within a group.

    All suffixes go through a mergesort whose comparison is extension(), equal ones too. In its order the extension that neighbours
    share (the LCP array) decides: neighbours that share the whole width are a class, which is then verified.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    prefix = prefix_hashes(BYTE_CODE[padded])
    order = merge_sorted(padded, prefix, start, width, group)
    head = np.ones(len(start), bool)
    left, right = order[:-1], order[1:]
    near = np.flatnonzero((group[left] == group[right]) & (width[left] == width[right]))
    head[near + 1] = extension(prefix, start[left[near]], start[right[near]], width[left[near]]) < width[left[near]]
    order, head = verified(padded, order, head, start, width, group)
    kind = np.empty(len(start), np.int64)
    kind[order] = np.cumsum(head) - 1
    return order, kind


def extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at x and y share, `most` at most: a binary search over the hashes of their prefixes."""
    known, most = np.zeros(len(x), np.int64), most.copy()
    up, down = powers(BASE, len(prefix))
    x_from, y_from, x_by, y_by = prefix[x], prefix[y], down[x], down[y]
    while len(open_ := np.flatnonzero(known < most)):
        half = (known[open_] + most[open_] + 1) // 2
        same = (prefix[x[open_] + half] - x_from[open_]) * x_by[open_] == (prefix[y[open_] + half] - y_from[open_]) * y_by[open_]
        known[open_[same]] = half[same]
        most[open_[~same]] = half[~same] - 1
    return known


def merge_sorted(padded: np.ndarray, prefix: np.ndarray, start: np.ndarray, width: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes by group and bytes: a bottom-up mergesort in all groups at once. A member of a left run finds its place
    by a binary search in the right run; those of the right run fill the places that are left."""
    order = np.lexsort((start, width, group))
    edge = np.ones(len(order), bool)
    edge[1:] = (group[order][1:] != group[order][:-1]) | (width[order][1:] != width[order][:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(order)))
    run = 1
    while len(first) and run < size.max():
        some = size > run
        of, step = spread(size[some])
        base, total = first[some][of], size[some][of]
        pair = step // (2 * run) * (2 * run)  # where the two runs begin within the group
        mine = np.flatnonzero((step - pair < run) & (pair + run < total))
        begin = base[mine] + pair[mine] + run
        low, high = begin.copy(), np.minimum(begin + run, base[mine] + total[mine])
        x = order[base[mine] + step[mine]]
        while len(open_ := np.flatnonzero(low < high)):
            half = (low[open_] + high[open_]) // 2
            a, b, w = start[x[open_]], start[order[half]], width[x[open_]]
            shared = extension(prefix, a, b, w)
            less = (shared < w) & (padded[b + shared] < padded[a + shared])
            low[open_[less]] = half[less] + 1
            high[open_[~less]] = half[~less]
        to = base[mine] + step[mine] + (low - begin)
        rest = np.flatnonzero((step - pair >= run) & (pair + run < total))
        new = order.copy()
        taken_ = np.zeros(len(order), bool)
        taken_[to] = True
        new[to] = x
        slots = base[np.concatenate([mine, rest])] + step[np.concatenate([mine, rest])]
        slots.sort()
        new[slots[~taken_[slots]]] = order[base[rest] + step[rest]]
        order, run = new, 2 * run
    return order


def verified(padded: np.ndarray, order: np.ndarray, head: np.ndarray, start: np.ndarray, width: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compares each suffix with the first of its class, eight bytes at a time; a class that collided is split."""
    if not len(order):
        return order, head
    lead = order[head][np.cumsum(head) - 1]
    other = np.flatnonzero(order != lead)
    x, y = order[other], lead[other]
    wrong = (group[x] != group[y]) | (width[x] != width[y])
    x, y, w = start[x], start[y], width[x]
    wide = np.concatenate([padded, np.zeros(8, np.uint8)])
    for k in range(0, int(w.max()) if len(w) else 0, 8):
        rest = np.clip(w - k, 0, 8)
        wrong |= ((eight(wide, np.minimum(x + k, len(padded))) ^ eight(wide, np.minimum(y + k, len(padded)))) & TAIL[rest]) != 0
    differs = np.zeros(len(order), bool)
    differs[other] = wrong
    if differs.any():
        which = np.cumsum(head) - 1
        for c in np.unique(which[differs]):
            at = np.flatnonzero(which == c)
            texts = [(int(group[i]), int(width[i]), padded[start[i] : start[i] + width[i]].tobytes()) for i in order[at]]
            turn = sorted(range(len(at)), key=texts.__getitem__)
            order[at] = order[at][turn]
            head[at[1:]] = [texts[turn[i]] != texts[turn[i - 1]] for i in range(1, len(at))]
    return order, head


def segments(rows: pa.Table, answers: pa.Table, width: int, bits: int) -> dict[str, np.ndarray]:
    """The chunk's segments with marked anchors: key, anchor's offset, start, length and row; `entry`:
    place among the distinct ones, which are `key_`, `offset_`, `length_`, `start_` and `least`."""
    data, offsets = text_view(rows["text"])
    code, place, first, last = anchors(data, offsets, width)
    _, back = np.unique(code >> U(64 - bits), return_inverse=True)
    mark = told(answers, 0)[back]
    code, place, first, last, mark = (x[mark > 0] for x in (code, place, first, last, mark))
    hot = mark == 2
    times = np.where(hot, last - first + 1, 1)
    step = spread(times)[1]
    single = np.repeat(hot, times)
    start = np.repeat(first, times) + np.where(single, step, 0)
    length = np.where(single, width, np.repeat(last - first, times) + width)
    offset = np.where(single, 255, np.repeat(place - first, times))
    key = np.repeat(code, times)
    if single.any():
        key[single] = window_codes(data, start[single], width)
    row = np.searchsorted(offsets, start, "right") - 1
    doc = ids(rows)[row]
    _, group = np.unique(mix(key) ^ mix(offset.astype(U) * U(131) + length.astype(U)), return_inverse=True)
    order, kind = sort_suffixes(data, start, length, group)
    least = smallest(kind, doc)
    rep = np.zeros(len(least), np.int64)
    rep[kind[::-1]] = np.arange(len(kind))[::-1]
    by = np.lexsort((start[rep], length[rep], offset[rep], key[rep]))
    entry = np.empty(len(by), np.int64)
    entry[by] = np.arange(len(by))
    rep = rep[by]
    return {"start": start, "length": length, "row": row, "doc": doc, "entry": entry[kind], "key_": key[rep], "offset_": offset[rep].astype(np.uint8), "length_": length[rep].astype(np.uint8), "start_": start[rep], "least": least[by]}


def window_codes(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    return range_hashes(data, start, start + width)


def taken(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the ranges one after another."""
    total = int(length.sum())
    at = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
    return data[at] if total else np.empty(0, np.uint8)


def mark_anchors(hot: int):
    def mark(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
        keys, back = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([x[1] for x in asked]), minlength=len(keys))
        marks = ((total >= 2).astype(np.uint8) + (total > hot))[back].astype(np.uint8)
        return np.split(np.minimum(marks, np.where(total[back] >= 2, 2, 0)).astype(np.uint8), np.cumsum([len(x[0]) for x in asked])[:-1])

    return mark


def smallest(kind: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest value of each kind."""
    out = np.full(int(kind.max()) + 1 if len(kind) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, kind, values)
    return out


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 n[0] times, 1 n[1] times, ..., and the count within each."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def match_segments(width: int):
    def match(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
        """For each segment a bit for each of its windows that also starts in a smaller doc_id. Anchors are taken some at a time, so
        that memory does not follow the size of the shard."""
        key, offset, length, doc, data = (np.concatenate([x[i] for x in asked]) for i in range(5))
        length = length.astype(np.int64)
        start = np.cumsum(length) - length
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.empty(0, np.int64)
        out, at = np.zeros(len(key), U), 0
        while at < len(key):
            to = int(np.append(edge, len(key))[np.searchsorted(edge, min(at + ENTRIES, len(key)), "left")])
            some = order[at:to]
            out[some] = matched(key[some], offset[some], length[some], doc[some], taken(data, start[some], length[some]), width)
            at = to
        return np.split(out, np.cumsum([len(x[0]) for x in asked])[:-1])

    return match


def matched(key: np.ndarray, offset: np.ndarray, length: np.ndarray, doc: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    start = np.cumsum(length) - length
    _, group = np.unique(key, return_inverse=True)
    _, kind = sort_suffixes(data, start, length, group * 256 + offset)
    least = smallest(kind, doc)
    out = np.where(least[kind] < doc, ~U(0), U(0))
    # anchors with several segments: the windows of one of each kind, sorted as suffixes
    one = np.unique(kind, return_index=True)[1]
    several = np.bincount(group[one], minlength=int(group.max()) + 1 if len(group) else 0) > 1
    one = one[several[group[one]]]
    of, step = spread(length[one] - width + 1)
    near = offset[one].astype(np.int64)[of] - step  # bytes of the window before its anchor
    _, same = sort_suffixes(data, start[one][of] + step, np.full(len(of), width), group[one][of] * 256 + near % 256)
    first = smallest(same, least[kind[one]][of])[same]
    place = np.full(len(least), -1)
    place[kind[one]] = np.arange(len(one))
    begin = np.append(0, np.cumsum(length[one] - width + 1))
    for w in range(int((length[one] - width + 1).max()) if len(one) else 0):
        at = place[kind]
        has = np.flatnonzero((at >= 0) & (w <= length - width))
        out[has] |= (first[begin[at[has]] + w] < doc[has]).astype(U) << U(w)
    return out


def deduplicated(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is binary, since a cut may
    fall inside a character. width lies between GRAM and GRAM + 63 bytes. Anchors that occur more than `hot` times go window by
    window; the rows are the same for any `hot`."""
    if not GRAM <= width < GRAM + 64:
        raise ValueError(f"width must be between {GRAM} and {GRAM + 63} bytes")
    all_ = corpus(docs)
    bits, shards = min(64, all_.bits + 8), all_.shards

    def sample(rows: pa.Table, _: object) -> list:
        code, n = np.unique(anchors(*text_view(rows["text"]), width)[0] >> U(64 - bits), return_counts=True)
        return dealt(code, bits, shards, np.minimum(n, 65535).astype(np.uint16))

    def candidates(rows: pa.Table, answers: pa.Table) -> list:
        s = segments(rows, answers, width, bits)
        data, length = text_view(rows["text"])[0], s["length_"].astype(np.int64)
        sent, ends = dealt(s["key_"], 64, shards, s["offset_"], s["length_"], s["least"]), np.append(0, np.cumsum(length))
        at, out = 0, []
        for shard, x in sent:
            to = at + len(x[0])
            out.append((shard, [*x, taken(data, s["start_"][at:to], length[at:to])]))
            at = to
        return out

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = text_view(rows["text"])
        s = segments(rows, answers, width, bits)
        of, step = spread(s["length"] - width + 1)
        bit = (told(answers, 1)[s["entry"]][of] >> step.astype(U)) & U(1) if len(of) else np.empty(0, U)
        gone = (bit > 0) | (s["doc"] > s["least"][s["entry"]])[of]
        start = s["start"][of][gone] + step[gone]
        drop = covered(len(data), start, start + width)
        begins = drop.copy()
        begins[1:] &= ~drop[:-1]
        edge = offsets[:-1][(offsets[:-1] < len(data))]
        begins[edge] = drop[edge]
        kept = data[~drop].tobytes()
        removed = run_sums(drop, offsets)
        to = np.append(0, np.cumsum(np.diff(offsets) - removed))
        texts = [kept[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": run_sums(begins, offsets), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts], "kept": pa.array(texts, pa.binary())})

    marked = answered(all_.ask(sample), mark_anchors(hot), 0)
    matched = answered(all_.ask(candidates, marked), match_segments(width), 1)
    return all_.over(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", marked.unionAll(matched))
