"""Token counts with overlap resynchronisation.

Short texts are encoded at once. A huge text is encoded in overlapping chunks with offsets. Where
two chunks overlap, both are cut at a common token boundary that is proven stable, and their
tokens are spliced there; if the overlap has none, it is widened, up to the whole rest of the text.

A boundary is proven stable if it lies between a character that is no space and a single space before
another such character, and the vocabulary has no piece with a space after another character: then no
merge crosses it, whatever stands on either side. `Counter` proves that from the vocabulary and
encodes whole texts where it doesn't hold.

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows and null ids stay rows of their own; an empty table
gives an empty result. Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32_768, 512
_SPACE = "▁"
_STABLE = re.compile(rf"(?<=[^\s{_SPACE}]) (?=[^\s{_SPACE}])")


class Counter:
    """Counts tokens of texts with a sentencepiece model."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=model), chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(len(self.model)))
        self.proven = not any(_SPACE in piece.lstrip(_SPACE) for piece in pieces)

    def starts(self, text: str, at: int) -> list[int]:
        """Where the tokens of a part of a text that stands at `at` begin."""
        return [at + begin for begin, _ in self.model.encode(text, out_type="offset_mapping")["offsets"]]

    def long(self, text: str) -> int:
        """Tokens of a text in chunks."""
        total, first, at = 0, 0, 0  # tokens before `first` are counted; the chunk begins at `at`
        while True:
            meet, overlap = at + self.chunk, self.overlap
            while True:
                end = min(len(text), meet + overlap)
                left = [x for x in self.starts(text[at:end], at) if x >= first]
                if end == len(text):
                    return total + len(left)
                right = set(self.starts(text[meet:end], meet))
                common = right.intersection(left)
                splice = next((m.start() for m in _STABLE.finditer(text, meet + 1, end - 1) if m.start() in common), None)
                if splice is not None:
                    break
                overlap *= 4
            total += sum(x < splice for x in left)
            first, at = splice, meet

    def __call__(self, texts: list[str]) -> list[int]:
        huge = [self.proven and len(x) > self.chunk + self.overlap for x in texts]
        short = iter(self.model.encode([x for x, h in zip(texts, huge, strict=True) if not h], num_threads=1))
        return [self.long(x) if h else len(next(short)) for x, h in zip(texts, huge, strict=True)]


@lru_cache(2)
def counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for every row of `docs`, with the sentencepiece model at `model`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, text = batch.slice(at, 500).columns
                texts = [x or "" for x in text.to_pylist()]
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(x.encode()) for x in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
