"""Rows of documents, chosen by their whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.words import text_blocks


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, good: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows of `docs`, as they are, for whose texts `good` says true. It gets the texts of a block (null: empty)."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = np.ones(batch.num_rows, bool)
            for part, texts in text_blocks(batch.column(at)):
                verdict[part] = good(texts)
            yield batch.filter(pa.array(verdict))

    return docs.mapInArrow(kept, docs.schema)
