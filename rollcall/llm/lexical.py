"""Ranked lexical search: impact vectors in buckets by length.

A document is a vector with an impact for each term, an item one with a weight for each of its terms; the score is their inner
product. Only the items' terms count in it, so a document's vector has no others. Each task sorts its vectors by length, longest
first, and cuts them into buckets. For an item and a bucket:

* the product of the item's length and of the longest vector's bounds every score of the bucket (Cauchy-Schwarz). Under the item's
  threshold, the bucket is left out;
* the item's terms go from the heaviest to the lightest. Those after the j-th can add no more than the sum of their weights times the
  largest impact in the bucket, nor than the product of the two lengths that are left. The first j terms beyond which that stays under the
  threshold are the focus: a vector without any of them can't reach it, and is never touched;
* vectors with a focus term have the exact sum over the focus, and the same two bounds, now with what is left of their own length,
  filter them;
* those that pass are scored again, over all terms, in 64-bit integers.

The threshold is the item's k-th best score so far. It starts from the `head` longest vectors of all documents (a first pass, which
only gives a bound and leaves nothing out) and rises inside each task. Scores equal to it pass, as a smaller id may win the tie. The tasks'
best k for each item then meet, so no vector is shuffled and no task has more than k rows for an item to give.

Items go to all tasks in blocks of at most about `block` terms, however many there are; documents become vectors once, of the terms
that any item asks for if these are at most `most_terms`, else of all.

A null or empty text has no term. Rows with one item id, null among them, are one item with the terms of all of them; items without a
known term find nothing. Each row of the documents is one of its own, repeated rows as well; null ids come after all others of equal score.
Empty tables give an empty result. Only ids and texts are read, so other columns and their names don't matter. Terms are told apart by
64-bit hashes (a chance of one in a million that two of six million terms share one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.words import Words, text_blocks
from rollcall.sources.lineage import cut_lineage

BUCKET, HEAD, BLOCK, MOST_TERMS = 1024, 4096, 1 << 20, 1 << 21
VECTORS = "doc_id long, n long, terms array<long>, tf array<int>"
FOUND = "item_id long, doc_id long, score long"


@dataclass
class Items:
    """A block of items. Their terms lie end to end, heaviest first inside an item: `code` (a place in `vocabulary`) and `weight`."""

    ids: pa.Array
    vocabulary: np.ndarray
    starts: np.ndarray
    code: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Items:
        """From rows of `item_id, terms`: structs of weight and term in descending order."""
        table = table.combine_chunks()
        pairs = table.column("terms").combine_chunks()
        term, sizes = pairs.flatten().field("term").to_numpy(), pairs.value_lengths().to_numpy()
        vocabulary, code = np.unique(term, return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return cls(table.column("item_id").combine_chunks(), vocabulary, starts, code, pairs.flatten().field("weight").to_numpy())

    def __post_init__(self) -> None:
        #: Of the terms from here to the end of the item: the sum of the squared weights.
        squares = np.concatenate(([0.0], np.cumsum(self.weight.astype(float) ** 2)))
        self.owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.squares_left = squares[self.starts[1:][self.owner]] - squares[:-1]


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and their terms with repeats."""

    documents: int
    terms: int

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of terms with `tf` occurrences in a document of `n` terms."""
        m = 100 - 90 + 90 * n * self.documents // max(self.terms, 1)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], ..., end[0] - 1, start[1], ..."""
    sizes = end - start
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(start - before, sizes)


class Best:
    """The k best of an item so far, as (score, id, id is null)."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
        """The threshold after it, 0 below k rows."""
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        first = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[first], ids[first], null[first]
        return int(self.score[-1]) if len(first) == self.k else 0


class Search:
    """Searches batches of vectors for a block of items; keeps the k best of each."""

    def __init__(self, items: Items, corpus: Corpus, k: int, threshold: np.ndarray, bucket: int = BUCKET):
        self.items, self.corpus, self.bucket = items, corpus, bucket
        self.threshold = threshold.astype(np.float64)
        self.best = [Best(k) for _ in range(len(items.ids))]
        #: How many pairs of vector and item were scored in full.
        self.scored = 0

    def vectors(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and impact of each known term, and the squared lengths of the rows."""
        n, terms, tf = (batch.column(c) for c in ("n", "terms", "tf"))
        row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
        flat, vocabulary = terms.flatten().to_numpy(), self.items.vocabulary
        code = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        known = vocabulary[code] == flat
        row, code = row[known], code[known]
        impact = self.corpus.impacts(n.to_numpy()[row], tf.flatten().to_numpy()[known].astype(np.int64))
        return row, code, impact, np.bincount(row, impact.astype(float) ** 2, batch.num_rows)

    def add(self, batch: pa.RecordBatch, least: float = 0.0) -> None:
        """Search the vectors of a batch whose squared length is at least `least`."""
        if not len(self.items.code) or not batch.num_rows:
            return
        row, code, impact, square = self.vectors(batch)
        order = np.argsort(-square, kind="stable")
        order = order[(square[order] > 0) & (square[order] >= least)]
        place = np.full(batch.num_rows, -1)
        place[order] = np.arange(len(order))
        at = place[row]
        sort = np.lexsort((at, code, at // self.bucket))
        sort = sort[at[sort] >= 0]
        at, code, impact = at[sort], code[sort], impact[sort]
        cuts = np.searchsorted(at // self.bucket, np.arange(-(-len(order) // self.bucket) + 1))
        column = batch.column("doc_id")
        ids, null = column.fill_null(0).to_numpy()[order], column.is_null().to_numpy(False)[order]
        for b, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            rows = slice(b * self.bucket, min((b + 1) * self.bucket, len(order)))
            self._bucket(at[low:high] - rows.start, code[low:high], impact[low:high], square[order[rows]], ids[rows], null[rows])

    def _bucket(self, at: np.ndarray, code: np.ndarray, impact: np.ndarray, square: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Terms of a bucket sorted by code: the vector, the code, the impact. `square` falls from the first vector on."""
        items, threshold = self.items, self.threshold
        lists = np.searchsorted(code, np.arange(len(items.vocabulary) + 1))
        largest = np.zeros(len(items.vocabulary), np.int64)
        held = np.flatnonzero(lists[1:] > lists[:-1])
        largest[held] = np.maximum.reduceat(impact, lists[held])
        sums = np.concatenate(([0], np.cumsum(items.weight * largest[items.code])))
        by_coordinate = sums[items.starts[1:][items.owner]] - sums[:-1]
        by_length = np.sqrt(items.squares_left * square[0]) * (1 + 1e-9)
        left = np.minimum(by_coordinate, by_length)  # from each term on; the bound of the whole item at its first
        reach = np.concatenate(([0], np.cumsum(left >= threshold[items.owner])))
        focus = reach[items.starts[1:]] - reach[items.starts[:-1]]
        for q in np.flatnonzero(focus):
            first, last = items.starts[q], items.starts[q + 1]
            stop = first + focus[q]
            codes = items.code[first:stop]
            found = ranges(lists[codes], lists[codes + 1])
            if not len(found):
                continue
            weight = np.repeat(items.weight[first:stop], lists[codes + 1] - lists[codes])
            score = np.zeros(len(square), np.int64)
            np.add.at(score, at[found], weight * impact[found])
            alive = score > 0
            if stop < last:
                used = np.bincount(at[found], impact[found].astype(float) ** 2, len(square))
                rest = np.sqrt(items.squares_left[stop] * np.maximum(square - used, 0)) * (1 + 1e-9) + 1
                alive &= score + np.minimum(rest, by_coordinate[stop]) >= threshold[q]
                codes = items.code[stop:last]
                found = ranges(lists[codes], lists[codes + 1])
                weight = np.repeat(items.weight[stop:last], lists[codes + 1] - lists[codes])
                pick = alive[at[found]]
                np.add.at(score, at[found][pick], (weight * impact[found])[pick])
            self.scored += int(alive.sum())
            alive = np.flatnonzero(alive & (score >= threshold[q]))
            if len(alive):
                threshold[q] = max(threshold[q], self.best[q].add(score[alive], ids[alive], null[alive]))

    def result(self) -> pa.RecordBatch:
        sizes = [len(b.score) for b in self.best]
        item = self.items.ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()))
        ids, null, score = (np.concatenate([getattr(b, c) for b in self.best]) if self.best else np.empty(0) for c in ("id", "null", "score"))
        return pa.RecordBatch.from_arrays(
            [item.cast(pa.int64()), pa.array(ids.astype(np.int64), pa.int64(), mask=null.astype(bool)), pa.array(score.astype(np.int64))], ["item_id", "doc_id", "score"]
        )


def item_terms(items: DataFrame) -> DataFrame:
    """`item_id, term`: the distinct terms of each item, as hashes."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch.column(1)):
                words = Words(texts, "term")
                ids = batch.column(0).slice(part.start, len(texts)).take(pa.array(words.text_of()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.hash.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(terms, "item_id long, term long").distinct()


def doc_vectors(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """`doc_id, n, terms, tf` of each row: how many terms it has, and the distinct ones (among the sorted `known`) with their counts."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch.column(1)):
                words = Words(texts, "term")
                term, owner = words.hash.view(np.int64), words.text_of()
                if known is None:
                    vocabulary, code = np.unique(term, return_inverse=True)
                else:
                    vocabulary, code = known, np.minimum(np.searchsorted(known, term), len(known) - 1)
                    hit = known[code] == term
                    code, owner = code[hit], owner[hit]
                pair, tf = np.unique(owner * len(vocabulary) + code, return_counts=True)
                starts = pa.array(np.searchsorted(pair, np.arange(len(texts) + 1) * max(len(vocabulary), 1)), pa.int32())
                term = vocabulary[pair % len(vocabulary)] if len(pair) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(texts)),
                        pa.array(words.counts, pa.int64()),
                        pa.ListArray.from_arrays(starts, pa.array(term, pa.int64())),
                        pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32())),
                    ],
                    ["doc_id", "n", "terms", "tf"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(vectors, VECTORS)


def weighted(terms: DataFrame, vectors: DataFrame, corpus: Corpus) -> DataFrame:
    """`item_id, terms`: structs of weight and term, heaviest first. Terms that no document has, or that weigh nothing, are left out."""
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    share = F.lit(2.0 * corpus.documents + 2) / (2 * F.col("df") + 1).cast("double")
    pairs = terms.join(df, "term").withColumn("weight", F.floor(1000 * F.log(share)).cast("long")).where("weight > 0")
    return pairs.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("weight", "term")), asc=False).alias("terms"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each item, with their rank."""
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(vectors: DataFrame, items: Items, corpus: Corpus, k: int, head: int) -> DataFrame:
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(items)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, corpus, k, np.zeros(len(shared.value.ids)))
        for batch in batches:
            square = search.vectors(batch)[3]
            yield pa.RecordBatch.from_arrays([pa.array(square[square > 0])], ["square"])

    def searched(threshold: np.ndarray, least: float):
        start = context.broadcast(threshold)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, corpus, k, start.value)
            for batch in batches:
                search.add(batch, least)
            yield search.result()

        return vectors.mapInArrow(run, FOUND)

    none = np.zeros(len(items.ids))
    longest = vectors.mapInArrow(lengths, "square double").orderBy(F.desc("square")).limit(head).agg(F.min("square")).first()[0]
    if longest is None:
        return searched(none, 0.0)
    firsts = best_of(searched(none, longest), k).where(F.col("rank") == k).select("item_id", "score").toArrow()
    known = dict(zip(firsts.column("item_id").to_pylist(), firsts.column("score").to_pylist(), strict=True))
    return searched(np.array([known.get(i, 0) for i in items.ids.to_pylist()]), 0.0)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, head: int = HEAD, block: int = BLOCK, most_terms: int = MOST_TERMS
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best rows of `docs` (`doc_id, text`) for each of `items` (`item_id, text`)."""
    terms = cut_lineage(item_terms(items))
    asked = terms.select("term").distinct()
    known = np.sort(asked.toArrow().column("term").to_numpy()) if asked.count() <= most_terms else None
    if known is not None and not len(known):
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    vectors = cut_lineage(doc_vectors(docs, known))
    total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = Corpus(*total)
    ready = cut_lineage(weighted(terms, vectors, corpus))
    size = ready.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = max(1, -(-size // block))
    parts = [Items.of(ready.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).toArrow()) for i in range(n)]
    return best_of(reduce(DataFrame.unionByName, [_search_block(vectors, x, corpus, k, head) for x in parts]), k)
