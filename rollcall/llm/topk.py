"""Exact top-k search by inner product: columnar branch and bound.

Vectors are laid out by block of dimensions. For a block of queries and a block of candidates, inner products are summed
dimension block by dimension block. After each, a pair can reach at most its sum so far plus the product of the norms of what
is left of both vectors; candidates that cannot reach the k-th best score known for a query are left out, and the rest is
moved together. All arithmetic is on integers, and the bounds are widened by more than their rounding error, so results are exact.

Queries and candidates are dealt to blocks of fixed size, and each pair of blocks is one group: memory depends on the
block sizes alone. Each group gives k rows for a query, of which the k best stay.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows without id. A row is a query's own
if it has its id; of rows with the same id, the smallest vector asks. Shorter vectors count as filled up with zeros. Scores beyond a long are given as the nearest long. Repeated
rows are candidates of their own; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a block, and dimensions in a block.
QUERIES, CANDIDATES, DIMENSIONS = 512, 4096, 16
FOUND = "query_id long, vec_id long, score decimal(38,0)"


def whole_vectors(rows: DataFrame, id_: str, vector: str, *also: str) -> DataFrame:
    """Rows that take part, with the integers floor(256 x) as doubles, which hold them exactly."""
    scaled = F.transform(vector, lambda x: _floor(x.cast("double") * 256))
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= 1e300))  # not so for NaN
    return rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_).cast("long").alias("vec_id"), scaled.alias("v"), *also
    )


def _floor(x: Column) -> Column:
    """From 2^53 on, a double is whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    sizes = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(rows), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def width(column: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc

    return pc.max(pc.list_value_length(column)).as_py() or 0


def remaining(m: np.ndarray, step: int) -> np.ndarray:
    """Norm of what is left of each row before each dimension block, and 0 at the end."""
    squares = np.add.reduceat(m * m, np.arange(0, m.shape[1], step), axis=1) if m.shape[1] else np.zeros((len(m), 0))
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(m), 1))], axis=1))


def search(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple]:
    """`(query id, candidate id, score)` of the k best candidates of each query, ties to the smaller id."""
    order = np.lexsort((c_ids, -np.einsum("ij,ij->i", c, c)))  # the longest first: good scores are known early
    c, c_ids = c[order], c_ids[order]
    ends = range(0, q.shape[1], step)
    columns = [np.ascontiguousarray(c[:, at : at + step]) for at in ends]
    left_q, left_c = remaining(q, step), remaining(c, step)
    head = min(len(c), max(8 * k, 64))
    first = q @ c[:head].T
    found = []
    for i, own in enumerate(q_ids):
        others = c_ids[:head] != own
        known = first[i][others]
        least = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
        alive = np.flatnonzero(c_ids != own)
        total = np.zeros(len(alive))
        for b, at in enumerate(ends):
            total = total + columns[b][alive] @ q[i, at : at + step]
            reach = total + left_q[i, b + 1] * left_c[alive, b + 1] * (1 + 1e-9) + 1
            keep = reach >= least
            if not keep.all():
                alive, total = alive[keep], total[keep]
        best = np.lexsort((c_ids[alive], -total))[:k]
        found += [(own, c_ids[alive[j]], int(total[j])) for j in best]
    return found


def search_large(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple]:
    """The same with whole numbers of any size, for blocks whose products a double can't hold."""
    whole = [[int(x) for x in row] for row in c]
    found = []
    for own, row in zip(q_ids, q, strict=True):
        mine = [int(x) for x in row]
        scores = [(-sum(a * b for a, b in zip(mine, other, strict=True)), id_) for other, id_ in zip(whole, c_ids, strict=True) if id_ != own]
        found += [(own, id_, -score) for score, id_ in sorted(scores)[:k]]
    return found


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding",
          queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best of all other rows for each row where `is_query` holds."""
    from decimal import Decimal

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            wide = max(width(left["v"]), width(right["v"]), 1)
            q, c = matrix(left["v"], wide), matrix(right["v"], wide)
            exact = wide * float(np.abs(q).max()) * float(np.abs(c).max()) < 2**53
            found = (search if exact else search_large)(q, left["vec_id"].to_numpy(), c, right["vec_id"].to_numpy(), k)
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        most = (1 << 63) - 1
        scores = [Decimal(max(-most - 1, min(most, x))) for x in s]
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(scores, pa.decimal128(38, 0))})

    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    across, down = -(-count["q"] // queries) or 1, -(-count["n"] // candidates) or 1
    asked = whole_vectors(rows.where(is_query), id_, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(across))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    )
    # dealt by place in the files and not by id: rows that share an id spread out as well
    place = F.pmod(F.monotonically_increasing_id(), F.lit(down)).cast("int")
    offered = whole_vectors(rows.withColumn("_cb", place), id_, vector, "_cb").withColumnRenamed("_cb", "cb").withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))
    )
    near = asked.groupBy("qb", "cb").cogroup(offered.groupBy("qb", "cb")).applyInArrow(pair, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")
    )
