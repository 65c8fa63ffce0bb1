"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items of more than `LONGEST` words are cut into passages of just as many, each half over the one before it and the last at the item's
end, so any `LONGEST` / 2 words in a row lie whole in one of them, and none is short. All n-grams of a passage are its seeds, however many documents hold them:
a leak makes the n-grams it holds frequent, so frequency can't tell ordinary ones. Every place where a document holds a seed is
aligned, word by word, with the passage; the local alignment score, as a share of the score of an unchanged copy, tells copies, edited
ones too, from chance. Places that can't score enough are left out before that: of the words of a passage between the ends of an
alignment, each that the document lacks costs a penalty, so the best run of words, with `SAME` for each that the document holds and
the penalty for each other, is never below the score (`bound`).

The items are sent to all tasks in blocks of at most `block` words, so what is sent has a fixed size however large the benchmark
is; each block takes one pass.

Words are runs of letters, marks and digits in lower case. Null and empty texts hold nothing. Items of fewer words than a seed
take no part; of items with equal texts each is reported. Repeated rows are judged like any other, null ids are kept; an empty table or
benchmark finds nothing. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import keep_rows
from rollcall.llm.words import Words, blocks, text_blocks

SEED, LEAK, LONGEST, BLOCK = 3, 0.4, 200, 1 << 20
#: Scores of the alignment: a word that agrees, one that differs, one that one side lacks.
SAME, OTHER, GAP = 1.0, 0.5, 0.5
_FILTER_BITS = 22
#: Places of seeds, and words of passages, looked at at a time.
_PLACES, _CELLS = 1 << 18, 1 << 20
FOUND = "doc_id long, item_id long, score double"


@dataclass
class Passages:
    """Passages of test items, and the seeds that lead to them."""

    item: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    #: Sorted seed hashes, with the passage and the place in it of each; a seed may occur more than once.
    seed: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    passage: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    quick: np.ndarray = field(default_factory=lambda: np.zeros(1 << _FILTER_BITS, bool))
    #: Sorted distinct words of all passages; the passages' words as numbers of these, end to end, and where each passage starts.
    known: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def add(self, items: list[tuple[int, str]], n: int) -> Passages:
        seeds, owner, place = [], [], []
        for item, text in items:
            words = Words([text])
            size = len(words.hash)
            if size < n:
                continue
            grams, _, first = words.grams(n)
            last = max(0, size - LONGEST)
            for at in [*range(0, last, LONGEST // 2), last]:
                part = slice(at, min(at + LONGEST, size))
                mine = (first >= part.start) & (first <= part.stop - n)
                seeds.append(grams[mine])
                place.append(first[mine] - part.start)
                owner.append(np.full(mine.sum(), len(self.item)))
                self.item.append(item)
                self.words.append(words.hash[part])
        if seeds:
            self.set(np.concatenate(seeds), np.concatenate(owner), np.concatenate(place))
            self.known, self.codes = np.unique(np.concatenate(self.words), return_inverse=True)
            self.starts = np.concatenate(([0], np.cumsum([len(x) for x in self.words])))
        return self

    def set(self, seed: np.ndarray, passage: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(seed, kind="stable")
        self.seed, self.passage, self.place = seed[order], passage[order], place[order]
        self.quick = np.zeros(1 << _FILTER_BITS, bool)
        self.quick[(self.seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which grams are seeds."""
        maybe = np.flatnonzero(self.quick[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.seed):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.seed, grams[maybe]), len(self.seed) - 1)
        return maybe[self.seed[at] == grams[maybe]]


def align(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of `items` with the same row of `texts`; zeros agree with nothing."""
    width = texts.shape[1]
    slope = GAP * np.arange(width, dtype=np.float32)
    before = np.zeros((len(texts), width + 1), np.float32)
    best = np.zeros(len(texts), np.float32)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        step = before[:, :-1] + np.where((texts == word) & (word != 0), np.float32(SAME), np.float32(-OTHER))
        step = np.maximum(np.maximum(step, before[:, 1:] - np.float32(GAP)), np.float32(0))
        # a word of the text that the item lacks: the best earlier score less the gap
        step = np.maximum.accumulate(step + slope, axis=1) - slope
        before[:, 1:] = step
        np.maximum(best, step.max(axis=1), out=best)
    return best


def bound(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the alignment of each passage scores at most. `held`: whether the text holds each word, end to end; `sizes`: words of each passage."""
    most = int(sizes.max())
    step = np.zeros((len(sizes), most + 1), np.float32)
    step[:, 1:][np.arange(most) < sizes[:, None]] = np.where(held, np.float32(SAME), np.float32(-min(OTHER, GAP)))
    total = np.cumsum(step, axis=1)
    return (total - np.minimum.accumulate(total, axis=1)).max(axis=1)


def likely(passages: Passages, words: Words, codes: np.ndarray, todo: np.ndarray, leak: float) -> np.ndarray:
    """Which places may score `leak`, by the words of their text. Rows of `todo`: size, passage, text, and others; sorted by text and passage."""
    new = np.ones(len(todo), bool)
    new[1:] = (todo[1:, 1:3] != todo[:-1, 1:3]).any(axis=1)
    pairs = todo[new]
    good = np.zeros(len(pairs), bool)
    flag = np.zeros(len(passages.known) + 1, bool)
    first = np.flatnonzero(np.diff(pairs[:, 2], prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(pairs)), strict=True):
        text = pairs[a, 2]
        mine = codes[words.bounds[text] : words.bounds[text + 1]]
        flag[mine] = True
        flag[-1] = False
        for rows in blocks(pairs[a:b, 0].tolist(), _CELLS):
            part = pairs[a:b][rows]
            size = part[:, 0]
            where = np.repeat(passages.starts[part[:, 1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            good[a:b][rows] = bound(flag[passages.codes[where]], size) >= leak * SAME * size - 1e-3
        flag[mine] = False
    return good[np.cumsum(new) - 1]


def scores(passages: Passages, texts: list[str], n: int, leak: float) -> dict[tuple[int, int], float]:
    """Best score of each text and item that share a seed, if it may be `leak` or more."""
    words = Words(texts)
    grams, owner, first = words.grams(n)
    hit = passages.hits(grams)
    found: dict[tuple[int, int], float] = {}
    if not len(hit):
        return found
    codes = np.minimum(np.searchsorted(passages.known, words.hash), len(passages.known) - 1)
    codes[passages.known[codes] != words.hash] = len(passages.known)
    low, high = np.searchsorted(passages.seed, grams[hit]), np.searchsorted(passages.seed, grams[hit], side="right")
    sizes = np.diff(passages.starts)
    for some in blocks((high - low).tolist(), _PLACES):
        times = (high - low)[some]
        entry = np.repeat(low[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        text, at = np.repeat(owner[hit[some]], times), np.repeat(first[hit[some]], times)
        passage = passages.passage[entry]
        size = sizes[passage]
        slack = np.maximum(8, size // 2)
        begin = (at - passages.place[entry] - slack) // slack * slack  # places that lie close together are aligned once
        rows = np.unique(np.stack([text, passage, size, begin, slack], axis=1), axis=0)[:, [2, 1, 0, 3, 4]]
        rows = rows[likely(passages, words, codes, rows, leak)]
        aligned(passages, words, rows[np.argsort(rows[:, 0], kind="stable")], found)
    return found


def aligned(passages: Passages, words: Words, todo: np.ndarray, found: dict[tuple[int, int], float]) -> None:
    """Scores of the places, by text and item, into `found`. Rows of `todo`: size, passage, text, begin, slack."""
    for rows in blocks((todo[:, 0] * 4).tolist(), 1 << 18):
        part = todo[rows]
        most = int(part[:, 0].max())
        width = int((part[:, 0] + 3 * part[:, 4]).max())
        item = np.zeros((len(part), most), np.uint64)
        for i, p in enumerate(part[:, 1]):
            item[i, : len(passages.words[p])] = passages.words[p]
        where = part[:, 3, None] + np.arange(width)
        inside = (where >= words.bounds[part[:, 2]][:, None]) & (where < words.bounds[part[:, 2] + 1][:, None])
        window = np.where(inside, words.hash[np.clip(where, 0, len(words.hash) - 1)], np.uint64(0))
        for (size_, passage_, text_, *_), score in zip(part, align(item, window), strict=True):
            key = (int(text_), passages.item[passage_])
            found[key] = max(found.get(key, 0.0), float(score) / (SAME * size_))


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about `most` words."""
    rows = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    # a text of n bytes has (n + 1) / 2 words at most
    size = rows.agg(F.sum((F.octet_length("text") + 1) / 2).alias("n")).first()["n"] or 0
    count = int(-(-size // most))
    for k in range(count):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]


def leaks(docs: DataFrame, items: DataFrame, leak: float = LEAK, n: int = SEED, block: int = BLOCK) -> DataFrame:
    """`doc_id, item_id, score` of the documents that hold a test item."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for part in item_blocks(items, block):
        held = docs.sparkSession.sparkContext.broadcast(Passages().add(part, n))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for part, texts in text_blocks(batch.column(1)):
                    found = [(ids[part.start + t], i, s) for (t, i), s in scores(held.value, texts, n, leak).items() if s >= leak]
                    if found:
                        columns = zip(*found, strict=True)
                        kinds = (pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score"])

        out = out.unionByName(rows.mapInArrow(find, FOUND))
    return out


def clean(docs: DataFrame, items: DataFrame, leak: float = LEAK, n: int = SEED, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no test item."""
    out = docs
    for part in item_blocks(items, block):
        held = docs.sparkSession.sparkContext.broadcast(Passages().add(part, n))

        def clean_ones(texts: list[str], held=held) -> np.ndarray:
            good = np.ones(len(texts), bool)
            for (t, _), s in scores(held.value, texts, n, leak).items():
                good[t] &= s < leak
            return good

        out = keep_rows(out, clean_ones)
    return out
