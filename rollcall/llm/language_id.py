"""Language identification by word-first backoff.

The model holds, for each language, log frequencies of words and of character n-grams (with the word's edges) of length 5
down to 1. A known word adds its log frequencies. An unseen word adds the mean of those of its known n-grams of the greatest
length at which it has any. The sums, with the languages' shares as a prior, give the score of a language between 0 and 1.

Words are runs of letters and marks in lower case, so figures, addresses and markup don't count. The model is learned from a sample of
about `sample` labelled documents of each language (the documented bound; drawn by hash of id and text) and is cut to the most frequent
entries of each language, equally many for all, so it is safe to send to all tasks: at most `words` + `grams` entries.

`recognised` asks whether the model can tell the language at all: a word is familiar if the model knows it or an n-gram of it of
`FAMILIAR` characters or more, and a document stays if enough of its words are. That does not depend on the number of languages.

Nulls, empty texts and texts without a letter (marks alone are none) get `und` with score 0. Without any labelled document, so do all. Without evidence the prior
decides; equal scores go to the language that sorts first. Repeated rows and null ids stay rows of their own; an empty table
gives an empty result. Only the id, the text and, for learning, the label are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.rows import keep_rows
from rollcall.llm.words import _tables, blocks, code_points, hash_spans, mix, powers, real_letters, spans, stretches, text_blocks
from rollcall.sources.lineage import cut_lineage

SAMPLE, WORDS, GRAMS, LONGEST = 2000, 200_000, 200_000, 5
#: Length from which a known n-gram makes a word familiar, and the share of familiar words that a document needs.
FAMILIAR, LEAST = 3, 0.5
UNKNOWN = "und"
_COUNTS = "lang string, size int, hash long, n long"


def words_of(part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of a text, and start, end and hash of its words."""
    lower, letters, *_ = _tables()
    points = lower[code_points(part)]
    inside = letters[points]
    start, end = spans(inside)
    return points, start, end, hash_spans(points, inside, start, end)


def grams(points: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words, edges included as a character, and the word of each."""
    size = end - start
    # each word with an edge before it, and an edge after the last
    where = np.concatenate(([0], np.cumsum(size + 1)))
    laid = np.zeros(where[-1] + 1, np.uint64)
    owner = np.repeat(np.arange(len(size)), size + 1)
    step = np.arange(where[-1]) - where[owner]
    real = step > 0
    laid[:-1][real] = points[(start[owner] + step - 1)[real]] + np.uint64(1)
    if len(laid) < n:
        return np.empty(0, np.uint64), owner[:0]
    first = np.flatnonzero(step + n <= size[owner] + 2) if n > 1 else np.flatnonzero(real)
    up, _ = powers(n + 1)
    total = np.full(len(first), n, np.uint64)
    for j in range(n):
        total += laid[first + j] * up[j + 1]
    return mix(total), owner[first]


@dataclass
class Model:
    """Languages, their log shares, and for each gram length (0: words) sorted hashes with log frequencies by language."""

    langs: list[str]
    prior: np.ndarray
    hashes: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def look_up(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the log frequencies of those."""
        table = self.hashes[size]
        if not len(table):
            return np.zeros(len(hashes), bool), np.empty((0, len(self.langs)))
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        known = table[at] == hashes
        return known, self.logs[size][at[known]]

    def evidence(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to each language, and whether it is familiar."""
        out = np.zeros((len(hashes), len(self.langs)))
        known, logs = self.look_up(0, hashes)
        out[known] = logs
        familiar = known.copy()
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            found, owner = grams(points, start[left], end[left], n)
            hit, logs = self.look_up(n, found)
            owner = owner[hit]
            times = np.bincount(owner, minlength=len(left))
            for k in range(len(self.langs)):
                total = np.bincount(owner, weights=logs[:, k], minlength=len(left))
                out[left, k] = total / np.maximum(times, 1)
            if n >= FAMILIAR:
                familiar[left[times > 0]] = True
            left = left[times == 0]
        return out, familiar

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language for each text, and whether it has a letter."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`scores`, and the share of each text's words that are familiar."""
        total = np.tile(self.prior, (len(texts), 1))
        letters = np.zeros(len(texts), bool)
        words, familiar = np.zeros(len(texts)), np.zeros(len(texts))
        origin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
        for at, part in stretches("\n".join(texts)):
            points, start, end, hashes = words_of(part)
            if not len(start):
                continue
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            text = np.searchsorted(origin, start + at, side="right") - 1
            real = np.concatenate(([0], np.cumsum(real_letters()[points])))
            letters[text[real[end] > real[start]]] = True
            if not self.langs:
                continue
            each, met = self.evidence(points, start[first], end[first], unique)
            words += np.bincount(text, minlength=len(texts))
            familiar += np.bincount(text, weights=met[back], minlength=len(texts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(text, weights=each[back, k], minlength=len(texts))
        weight = np.exp(total - total.max(axis=1, keepdims=True)) if self.langs else total
        return weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300), letters, familiar / np.maximum(words, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams by language: lang, size (0: words), hash, count."""
    for batch in batches:
        langs, column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            texts = [t for t, x in zip(column, langs, strict=True) if x == lang]
            for rows in blocks([len(x) for x in texts]):
                for _, part in stretches("\n".join(texts[rows])):
                    points, start, end, hashes = words_of(part)
                    if not len(start):
                        continue
                    unique, first, times = np.unique(hashes, return_index=True, return_counts=True)
                    found = [(0, unique, times)]
                    for n in range(1, LONGEST + 1):
                        gram, owner = grams(points, start[first], end[first], n)
                        kinds, back = np.unique(gram, return_inverse=True)
                        found.append((n, kinds, np.bincount(back, weights=times[owner], minlength=len(kinds))))
                    for n, kinds, counts in found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(kinds), pa.string()), pa.array(np.full(len(kinds), n, np.int32)),
                                pa.array(kinds.view(np.int64)), pa.array(counts.astype(np.int64)),
                            ],
                            ["lang", "size", "hash", "n"],
                        )


def learn(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """The model of the labelled documents of `docs` where `may_learn` holds."""
    labelled = docs.where(F.col("lang").isNotNull() & may_learn)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.empty(0), {}, {})
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.col("text").cast("string")), F.lit(1 << 30)) < share[F.col("lang").cast("string")] * float(1 << 30)
    drawn = labelled.where(draw & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counts = drawn.mapInArrow(_count, _COUNTS).groupBy("size", "hash", "lang").agg(F.sum("n").alias("n"))
    of_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    counts = cut_lineage(counts)
    is_word = (F.col("size") == 0).alias("is_word")
    often = Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "size", "hash")
    most = F.when(is_word, F.lit(words // len(langs))).otherwise(F.lit(most_grams // len(langs)))
    chosen = counts.withColumn("rank", F.row_number().over(often)).where(F.col("rank") <= most).select("size", "hash").distinct()
    whole = counts.join(chosen, ["size", "hash"]).groupBy("size", "hash").agg(of_lang.alias("by"))
    by = F.array(*[F.coalesce(F.try_element_at("by", F.lit(k)), F.lit(0)).cast("double") for k in langs]).alias("by")
    hashes, logs = {}, {}
    rows = whole.select("size", "hash", by).toArrow()
    size, hash_ = rows["size"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
    table = rows["by"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(size == n)
        mine = mine[np.argsort(hash_[mine])]
        hashes[n] = hash_[mine]
        total = table[mine].sum(axis=0) + 0.5 * (len(mine) + 1)
        logs[n] = np.log((table[mine] + 0.5) / total)
    shares = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(shares / shares.sum()), hashes, logs)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`docs`' columns `keep` with `lang_pred` and `score`, for every row. Only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for rows, mine in text_blocks(batch.column(batch.num_columns - 1)):
                names, best = [UNKNOWN] * len(mine), [0.0] * len(mine)
                if model.langs:
                    scores, letters = model.scores(mine)
                    first = scores.argmax(axis=1)
                    names = [model.langs[k] if x else UNKNOWN for k, x in zip(first, letters, strict=True)]
                    best = np.where(letters, scores.max(axis=1), 0.0)
                part = batch.slice(rows.start, rows.stop - rows.start)
                columns = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], out.names
                )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    out = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(predicted, out)


def recognised(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, with all columns, that have a letter and of whose words a share of `least` or more is familiar to the
    model. Without any label there is no model, and rows with a letter stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[str]) -> np.ndarray:
        model = held.value
        _, letters, familiar = model.judged(texts)
        return letters & (familiar >= least) if model.langs else letters

    return keep_rows(docs, good)
