"""Periodic runs of words, and texts without their repetitions: seed and extend along diagonals.

A run of period q is a longest stretch of words of which those q apart are equal, of at least `least` words and three periods. On the
diagonal of lag q it agrees over its length less q, so over 16 words at least if `least` is 24, and over 2 * q. Seeds are
k-grams of just such an overlap that is sure to be there: k is 16 for periods up to 16, and 2, 4, ... times as much for periods of half of
it up to it. For each k, places of one k-gram in one document that follow each other are paired. That finds every run: if a k-gram
of a run came again nearer than q, with q <= k, both lags would be periods of a stretch of more than their sum, and so would be their
greatest common divisor. For the same reason no pair has a multiple of the smallest period as its lag.

A seed is extended to both sides as far as the words q apart agree. A table with the furthest word covered, for each lag of a document,
leaves out seeds that an extension has covered, so each diagonal is walked once.

k-grams are named exactly: words by a dictionary, longer ones by the pair of their halves. Only k-grams with both halves found twice can
be found twice, so the work falls fast with k. Memory follows a block of texts of about half a megabyte, or one longer text.

A text that is null or has no word has no run and an empty collapsed text. Repeated rows are judged like any other, null ids are kept;
an empty table gives an empty result. Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.words import stretches, text_blocks

LEAST, SEED = 24, 16
RUNS = "array<struct<start: long, length: long, period: long>>"
#: Words compared at a time while a seed is extended, and words joined at a time.
_STEP, _JOIN = 64, 1 << 16


class Vocabulary(dict):
    """Numbers for words, in the order of their first use."""

    def __init__(self):
        super().__init__()
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.next()
        return number

    def codes(self, text: str) -> np.ndarray:
        """The words of a text as numbers. Bytes are split at just the ASCII white space."""
        parts = [np.fromiter(map(self.__getitem__, part.encode().split()), np.int64) for _, part in stretches(text)]
        return np.concatenate(parts)


def agreeing(codes: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many words in a row from `at` on, in the direction of `step`, equal those `lag` further on."""
    size, total = _STEP, 0
    most = len(codes) - lag - at if step > 0 else at + 1
    while total < most:
        size = min(size, most - total)
        low = at + total if step > 0 else at - total - size + 1
        same = codes[low : low + size] == codes[low + lag : low + lag + size]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return total + int(same.argmin())
        total, size = total + size, size * 4
    return total


def seeds(codes: np.ndarray, starts: np.ndarray, k: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each k: places of a k-gram and the lags to its next place in the same document, at most k.

    `codes` are the words of all documents, end to end, and `starts` where each begins, with the end.
    """
    end = np.repeat(starts[1:], np.diff(starts))
    place, name, size = np.arange(len(codes)), codes, 1
    while len(place):
        # names of k-grams: pairs of the names of their halves, where both are there
        while size < k:
            names = np.full(len(codes) + size, -1)
            names[place] = name
            place = place[place + 2 * size <= end[place]]
            place = place[names[place + size] >= 0]
            _, name = np.unique(names[place] * (len(codes) + 1) + names[place + size], return_inverse=True)
            size *= 2
            place, name = repeated(place, name, end)
        order = np.lexsort((place, name))
        here, there = place[order][:-1], place[order][1:]
        pair = (name[order][:-1] == name[order][1:]) & (end[here] == end[there]) & (there - here <= k)
        pair &= there - here > (k // 2 if k > SEED else 0)
        yield k, here[pair], (there - here)[pair]
        k *= 2


def repeated(place: np.ndarray, name: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose name is found more than once in a document."""
    order = np.lexsort((place, name))
    place, name = place[order], name[order]
    twin = (name[1:] == name[:-1]) & (end[place[1:]] == end[place[:-1]])
    keep = (np.append(twin, False) | np.append(False, twin))[: len(place)]
    order = np.argsort(place[keep])
    return place[keep][order], name[keep][order]


def runs(codes: np.ndarray, starts: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period. `least` is 24 at least."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    covered: dict[tuple[int, int], int] = {}
    for _, place, lag in seeds(codes, starts):
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # a seed one word after another of its lag is covered by the extension of that one
        fresh = np.append(True, (np.diff(place) != 1) | (np.diff(lag) != 0))[: len(place)]
        place, lag = place[fresh], lag[fresh]
        doc = np.searchsorted(starts, place, "right") - 1
        for at, q, d in zip(place.tolist(), lag.tolist(), doc.tolist(), strict=True):
            first = int(starts[d])
            if at - first < covered.get((d, q), 0):
                continue
            own = codes[first : starts[d + 1]]
            at -= first
            begin = at - agreeing(own, q, at - 1, -1)
            stop = at + agreeing(own, q, at, 1)
            covered[d, q] = stop
            if stop - begin + q >= max(least, 3 * q):
                found[d].append((begin, stop - begin + q, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def joined(codes: np.ndarray, names: list[bytes]) -> str:
    parts = [b" ".join(map(names.__getitem__, codes[i : i + _JOIN].tolist())) for i in range(0, len(codes), _JOIN)]
    return b" ".join(parts).decode()


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`doc_id, runs, collapsed` of each row: its runs as structs of start, length and period, by start and period, and its words
    without what the runs repeat, joined by a space."""
    if least < LEAST:
        raise ValueError(f"runs of less than {LEAST} words may hold no seed")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch.column(1)):
                words = Vocabulary()
                codes = [words.codes(x) for x in texts]
                starts = np.concatenate(([0], np.cumsum([len(x) for x in codes])))
                found, names = runs(np.concatenate(codes), starts, least), list(words)
                clean = [joined(c[kept(len(c), r)] if r else c, names) for c, r in zip(codes, found, strict=True)]
                flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(texts)), pa.ListArray.from_arrays(at, fields), pa.array(clean, pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judged, f"doc_id long, runs {RUNS}, collapsed string")


def strongest(found: Column) -> Column:
    """Of an array of runs, the one with the greatest exact length/period; ties go to the smallest start, then period. Null if none."""

    def first(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (ahead > 0), run).otherwise(best)

    return F.aggregate(found, F.lit(None).cast(RUNS[6:-1]), first)


def runs_text(found: Column) -> Column:
    """`start,length,period` of each run, each with a line feed."""
    lines = F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")
