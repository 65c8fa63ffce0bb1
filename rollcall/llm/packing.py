"""Packing of documents into sequences by minimum bin slack.

Documents become pieces of at most `capacity` tokens. What the packing needs to know of them is how many pieces of
each length there are: at most `capacity` numbers, however many documents. Bins are made from these: the longest
length left opens a bin, a bitset of reachable sums finds the fullest combination of lengths for the rest of it, and
the combination is taken out as often as the counts allow. If that needs more bins than all tokens together would fill, other
orders of the lengths are tried. Each step at least halves the count of a length, and the
distinct lengths in a bin add up to `capacity` at most, so the plan has a bound that hardly depends on the data
(`most_slots`), and is safe to send to all tasks.

Pieces find their places by rank within their length. Ranks are dealt out in salted groups, so a length that holds a third
of all pieces is ranked by many tasks; a group's first rank comes from counts.

Null and empty texts are one token (the closing id 0). Repeated rows and null ids are pieces of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.sources.lineage import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Orders in which lengths are tried, as long as there are more bins than all tokens together need.
TRIES = 16
SLOTS = "length int, first long, count long, times int, base int, bin long"


class Encoder:
    """Ids as `tokenizers` gives them for a byte-level BPE file.

    Texts of Latin letters, digits and punctuation go through tiktoken with the vocabulary and pattern of the same
    file, which gives the same ids (tested over all these characters) in a quarter of the time. Texts with any other
    character, or with the text of a special token, go to `tokenizers` itself.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*")

    def __init__(self, model: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(model)
        with open(model, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [x["content"] for x in parts["added_tokens"]]
        known = parts["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [i for i in range(256) if i not in set(plain)]
        byte = {chr(i): i for i in plain} | {chr(256 + n): i for n, i in enumerate(spare)}
        ranks = {bytes(byte[c] for c in word): i for word, i in known.items() if word not in self.special}
        self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def cut(docs: DataFrame, model: str, capacity: int) -> DataFrame:
    """A row for each piece. Only a first piece is shorter than `capacity`."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, text = batch.slice(at, 500).columns
                rows = []
                for doc, one in zip(ids.to_pylist(), text.to_pylist(), strict=True):
                    tokens = np.append(encode(one or ""), np.uint32(0)).astype("<u4")
                    ends = range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)
                    for k, end in enumerate(ends):
                        start = max(0, end - capacity) if k else 0
                        rows.append((doc, k, start, end - start, zlib.crc32(tokens[start:end].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def fullest(counts: dict[int, int], room: int, draw: random.Random | None = None) -> dict[int, int]:
    """How many of each length fill `room` best. Of several ways, the one with the lengths that come first: the longest, or with
    `draw` any order."""
    reach, seen = 1, []
    whole = (1 << room + 1) - 1
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    if draw is not None:
        draw.shuffle(lengths)
    for length in lengths:
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            seen.append((reach, length, take))
            reach |= reach << length * take & whole
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for before, length, take in reversed(seen):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + take
            total -= length * take
    return found


def combinations(counts: dict[int, int], capacity: int, draw: random.Random | None = None) -> Iterator[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins each fills, until `counts` is used up."""
    counts = dict(counts)
    while counts:
        first = max(counts)
        counts[first] -= 1
        found = fullest({k: n for k, n in counts.items() if n}, capacity - first, draw)
        counts[first] += 1
        found[first] = found.get(first, 0) + 1
        bins = min(counts[k] // n for k, n in found.items())
        yield found, bins
        for k, n in found.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]


def fewest(counts: dict[int, int], capacity: int, tries: int = TRIES) -> list[tuple[dict[int, int], int]]:
    """The combinations that need the fewest bins, of several tries; the first that needs no more than all tokens do."""
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: list[tuple[dict[int, int], int]] = []
    for i in range(tries):
        found = list(combinations(counts, capacity, random.Random(i) if i else None))
        if not i or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= least:
            break
    return best


def most_slots(capacity: int, pieces: int) -> int:
    """Rows of a plan: a combination for each halving of a length's count, of distinct lengths that add up to `capacity`."""
    return capacity * pieces.bit_length() * math.isqrt(2 * capacity)


def slots(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Rows of SLOTS: which ranks of a length go to which bins, and where."""
    rows, used, bin_ = [], dict.fromkeys(counts, 0), 0
    for found, bins in fewest(counts, capacity):
        base = 0
        for length in sorted(found, reverse=True):
            times = found[length]
            rows.append((length, used[length], times * bins, times, base, bin_))
            used[length] += times * bins
            base += length * times
        bin_ += bins
    return rows


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Each piece with its rank (from 0) among those of its length."""
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most `capacity` x `salts` groups, and `salts` for a length
    first = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("_inside", inside).join(first, ["length", "_salt"]).withColumn(
        "_rank", F.col("_first") + F.col("_inside")
    )


def pack(docs: DataFrame, model: str, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` for every piece of every row of `docs`."""
    spark = docs.sparkSession
    pieces = cut_lineage(cut(docs, model, capacity))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # full pieces are sequences of their own; their bins follow those of the plan
    full = counts.pop(capacity, 0)
    plan = slots(counts, capacity)
    assert len(plan) <= most_slots(capacity, sum(counts.values()))
    if full:
        plan.append((capacity, 0, full, 1, 0, max((r[5] + r[2] // r[3] for r in plan), default=0)))
    place = spark.createDataFrame(plan, SLOTS).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "count", "times", "base", "bin"))).alias("_slots")
    )
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked(pieces, salts).join(F.broadcast(place), "length")
    mine = F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["count"]))[0]
    at = F.col("_rank") - F.col("_slot.first")
    return rows.withColumn("_slot", mine).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("_slot.bin") + F.floor(at / F.col("_slot.times"))).cast("long").alias("sequence_id"),
        (F.col("_slot.base") + F.pmod(at, F.col("_slot.times")) * F.col("length")).cast("long").alias("offset"),
    )
