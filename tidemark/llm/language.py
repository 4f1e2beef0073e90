"""Language identification by unigrams over pieces, with all segmentations summed.

Each language has probabilities over the pieces of a fixed public vocabulary, all of them. A word, with the
vocabulary's mark of a word start, is worth the sum over all its segmentations of the product of its
pieces' probabilities, found by a forward pass over its characters, however many; a text is worth the
product of its words. Probabilities are fitted by expectation maximisation on a bounded sample: up to
`each` documents of at most `most` bytes per language, the first by a hash of the id, and their words of
at most LEARNED characters.

A text that is null or has no letter is `und` with score 0. Texts are lower-cased. Characters that
no piece covers have one probability in all languages. If nothing can be learned, all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.linear import held_out
from tidemark.llm.textops import U, code_points, mix, range_hashes, slices, text_view

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START, LEARNED, RARE, RESCALE = 0x2581, 64, 1e-6, 8
STEP, SPREAD = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Pieces:
    """Codes of the vocabulary's pieces, ascending, with their numbers, and the characters of the longest one."""

    code: np.ndarray
    near: np.ndarray
    longest: int

    @classmethod
    def of(cls, texts: set[str]) -> Pieces:
        code = np.unique(np.concatenate([list(codes(np.array([ord(c) for c in t], np.uint32), len(t)))[-1] for t in sorted(texts)]))
        if len(code) != len(texts):
            raise ValueError("two pieces have one code")
        near = np.zeros(1 << 24, bool)
        near[code >> U(40)] = True
        return cls(code, near, max(map(len, texts)))

    def numbers(self, points: np.ndarray) -> list[np.ndarray]:
        """For each number of characters, from 1: number of the piece of that size that starts at each place, or -1."""
        found = []
        for code in codes(points, self.longest):
            out = np.full(len(points), -1, np.int32)
            some = np.flatnonzero(self.near[code >> U(40)])
            at = np.minimum(np.searchsorted(self.code, code[some]), len(self.code) - 1)
            out[some] = np.where(self.code[at] == code[some], at, -1)
            found.append(out)
        return found


def codes(points: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Codes of the pieces of 1, 2, ..., longest characters that start at each place."""
    x = points.astype(U) + U(1)
    now = x
    for size in range(1, longest + 1):
        if size > 1:
            now = now[:-1] * STEP + x[size - 1 :]
        yield (now + U(size)) * SPREAD


def pieces(path: str = VOCABULARY) -> Pieces:
    """Read on the driver; the vocabulary's size is fixed."""
    return Pieces.of(piece_texts(path))


def piece_texts(path: str = VOCABULARY) -> set[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class Lattice:
    """Words as rows of characters, longest first, and the pieces that start at each of them."""

    def __init__(self, vocabulary: Pieces, points: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        self.order = np.argsort(-size, kind="stable")
        self.first, self.size = first[:-1][self.order], size[self.order]
        self.longest = int(size.max()) if len(size) else 0
        self.pieces = vocabulary.longest
        rank = np.empty(len(size), np.int32)
        rank[self.order] = np.arange(len(size), dtype=np.int32)
        row, left = np.repeat(rank, size), np.repeat(first[1:], size) - np.arange(first[-1] if len(size) else 0)
        end, found = np.arange(len(row)) - np.repeat(first[:-1], size), []
        for n, number in enumerate(vocabulary.numbers(points), 1):
            some = np.flatnonzero((number >= 0) & (left >= n)) if n > 1 else np.arange(len(row))
            found.append(((end[some] + n) * (self.pieces + 1) + n, row[some], number[some]))
        key, row, number = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        self.row, self.number, key = row[order], number[order], key[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        self.steps: list[list[tuple[int, int, int]]] = [[] for _ in range(self.longest + 1)]
        for k, a, b in zip(key[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True):
            self.steps[k // (self.pieces + 1)].append((k % (self.pieces + 1), a, b))

    def ending(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, piece numbers) of the pieces that end at a character; single ones without a piece have number -1."""
        for n, a, b in self.steps[end]:
            yield n, self.row[a:b], self.number[a:b]

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language, in the words' own order; p has a last row for characters
        without a piece. Only the forward values that a piece can reach are held, and rescaled now and then."""
        out, scale = np.empty((len(self.size), p.shape[1])), np.zeros((len(self.size), p.shape[1]))
        ring = [np.ones((len(self.size), p.shape[1]))]
        for end in range(1, self.longest + 1):
            rows, later = (int(np.searchsorted(-self.size, -e, "right")) for e in (end, end + 1))
            now = np.zeros((rows, p.shape[1]))
            for n, some, number in self.ending(end):
                now[some] += ring[n - 1][some] * p[number]
            ring = [now, *(x[:rows] for x in ring[: self.pieces - 1])]
            if end % RESCALE == 0:
                scale[:rows] += np.log(now)
                ring = [x / now for x in ring]
            out[later:rows] = np.log(ring[0][later:]) + scale[later:rows]
        logs = np.empty_like(out)
        logs[self.order] = out
        return logs

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under p (one language), words weighted by counts; for words of at most LEARNED characters."""
        lines, steps = np.arange(len(self.size)), [list(self.ending(end)) for end in range(1, self.longest + 1)]
        alpha = np.zeros((self.longest + 1, len(self.size)))
        alpha[0] = 1
        for end, found in enumerate(steps, 1):
            for n, rows, number in found:
                alpha[end, rows] += alpha[end - n, rows] * p[number, 0]
        beta = np.zeros_like(alpha)
        beta[self.size, lines] = 1
        total = counts[self.order] / alpha[self.size, lines]
        out = np.zeros(len(p))
        for end in range(self.longest, 0, -1):
            for n, rows, number in steps[end - 1]:
                use = p[number, 0] * beta[end, rows]
                out += np.bincount(number % len(p), weights=alpha[end - n, rows] * use * total[rows], minlength=len(p))
                beta[end - n, rows] += use
        return out


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a slice as code points (lower case, marked) with bounds, the
    number of the word at each place of the text and the bounds of the rows in those."""
    text = data.tobytes().decode("utf-8", "replace")
    lower = text.lower()
    if len(lower) != len(text):  # a few characters have longer lower cases; their offsets would move
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, place = code_points(data, offsets)
    solid = ~((points == 32) | ((points >= 9) & (points <= 13)))
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = place[:-1][place[:-1] < len(points)]
    begin[edge] = solid[edge]
    start = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | begin[1:]
    end = np.flatnonzero(stop) + 1
    _, one, back = np.unique(range_hashes(points.view(np.uint8), 4 * start, 4 * end), return_index=True, return_inverse=True)
    size = end - start
    size = size[one] + 1
    first = np.append(0, np.cumsum(size))
    at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    taken = np.where(at == 0, START, points[np.maximum(0, np.repeat(start[one], size) + at - 1)])
    return taken, first, back, np.searchsorted(start, place)


@dataclass(frozen=True)
class Model:
    pieces: Pieces
    languages: tuple[str, ...]
    p: np.ndarray

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        points, first, back, rows = words(data, offsets)
        each = np.zeros((len(first) - 1, len(self.languages)))
        at = 0
        while at < len(each):
            to = max(at + 1, min(at + (1 << 15), int(np.searchsorted(first, first[at] + (1 << 20), "right")) - 1))
            part = points[first[at] : first[to]]
            each[at:to] = Lattice(self.pieces, part, first[at : to + 1] - first[at]).logs(self.p)
            at = to
        total = np.zeros((len(back) + 1, each.shape[1]))
        np.cumsum(each[back], axis=0, out=total[1:])
        total = total[rows[1:]] - total[rows[:-1]]
        total -= total.max(axis=1, keepdims=True)
        shares = np.exp(total)
        shares /= shares.sum(axis=1, keepdims=True)
        plain, place = code_points(data, offsets)
        seen = np.append(0, np.cumsum(letters()[np.minimum(plain, 0x10FFFF)]))
        known = seen[place[1:]] > seen[place[:-1]]
        best = np.argmax(shares, axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, shares.max(axis=1), 0.0)


def train(docs: DataFrame, each: int = 300, most: int = 1 << 16, rounds: int = 3, path: str = VOCABULARY) -> Model | None:
    """Learns from up to `each` documents of at most `most` bytes of each lang that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most) & ~held_out(F.col("doc_id")))
    rank = F.row_number().over(W.partitionBy("own").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.select("doc_id", F.col("lang").alias("own")).withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "own").distinct()
    same = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").where("lang = own AND text IS NOT NULL").where(F.octet_length("text") <= most)
    rows = same.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text").toArrow()  # an id that repeats counts once
    by: dict[str, list[str]] = {}
    for lang, text in sorted(zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True)):
        by.setdefault(lang, []).append(text)
    if not by:
        return None
    vocabulary, languages, p = pieces(path), tuple(sorted(by)), []
    for lang in languages:
        points, first, back, _ = words(*text_view(pa.array(by[lang])))
        counts = np.bincount(back, minlength=len(first) - 1).astype(float)
        short = np.flatnonzero(np.diff(first) <= LEARNED + 1)
        points = np.concatenate([points[first[i] : first[i + 1]] for i in short] or [points[:0]])
        counts, first = counts[short], np.append(0, np.cumsum(np.diff(first)[short]))
        own = np.full((len(vocabulary.code) + 1, 1), 1 / len(vocabulary.code))
        own[-1] = RARE
        for _ in range(rounds):
            uses = np.zeros(len(own))
            for at in range(0, len(counts), 1 << 13):
                to = min(len(counts), at + (1 << 13))
                uses += Lattice(vocabulary, points[first[at] : first[to]], first[at : to + 1] - first[at]).expected(own, counts[at:to])
            own = (uses / max(1.0, uses[:-1].sum()) + 1e-12)[:, None]
            own[-1] = RARE
        p.append(own[:, 0])
    p = np.stack(p, axis=1)
    common = np.maximum(p.mean(axis=1, keepdims=True), RARE)
    p = 0.98 * p + 0.02 * common
    p[-1] = RARE
    return Model(vocabulary, languages, p)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the best language's share)."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if model is None:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            named, score = shared.value.judge(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    judged = rows.mapInArrow(judge, "doc_id bigint, lang_pred string, score double")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
