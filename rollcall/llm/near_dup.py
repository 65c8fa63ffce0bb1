"""Near-duplicates by ProbMinHash signatures, banding and verification.

Texts are sets of shingles of five words (words are runs without white space, in lower case; a shorter text is one shingle). Each
shingle is a Poisson process whose rate is its weight: its arrivals fall on random registers, and a register keeps the first to
arrive. Equal registers of two texts estimate their probability Jaccard similarity. How often a shingle occurs in a text doesn't
count: all weights are one, and then that equals the Jaccard similarity of the sets, by which pairs are verified. A text's
arrivals are followed only until the last of its registers is taken.

Registers in a band make a bucket. Inside a bucket, texts are compared with a centre, not with each other; those of
one component need no comparison. Centres change from round to round. After the last round, texts outside the component of their bucket's
centre meet all the others of the bucket that lie in other components: in small buckets as pairs, in large ones in blocks of fixed size,
each of which is compared inside a task and gives only the links that join components. So a group of copies costs a comparison for each
copy, and no pair that meets in a bucket is left out unless a chain of verified links joins it already. Pairs are verified by the exact
Jaccard similarity of their sets of shingles.

Exact copies are one node, found by hash before that. The result has a row for every row: `doc_id`, `copy_of` (smallest id with the
same text), `class_id` (smallest id of its group) and `keep` (the row has its group's id).

Null texts, texts without a word, and rows without id: texts without a word are only copies of equal texts; null texts and
rows without id are groups of their own. Rows that share an id are one document with several texts. An empty
table gives an empty result. Only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.rows import free_name
from rollcall.llm.words import Words, mix, text_blocks
from rollcall.sources.lineage import cut_lineage

SHINGLE, SIMILAR = 5, 0.8
#: With these, a pair of similarity 0.8 meets in no band with a probability of 7 in 100,000.
BANDS, ROWS = 24, 5
ROUNDS = 2
#: A bucket with more members is compared in blocks of so many members.
LARGE, SIDE = 64, 1024


def weighted(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each distinct shingle, by text and hash."""
    words = Words(texts, "spaced")
    hashes, owner, _ = words.grams(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        own = [mix(np.array([np.bitwise_xor.reduce(mix(words.hash[a:b] + np.arange(b - a, dtype=np.uint64))) + np.uint64(b - a)]))[0]
               for a, b in zip(words.bounds[short], words.bounds[short + 1], strict=True)]
        hashes, owner = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int, reach: float = 2.0) -> np.ndarray:
    """Registers of each text: the shingles that arrive first. Texts without shingles have zeros."""
    first = np.full(texts * registers, np.inf)
    taken = np.zeros(texts * registers, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=texts)
    # by then all registers are very likely taken; where they aren't, the search goes on below
    expected = registers * (np.log(registers) + 0.5772)
    limit = np.full(texts, np.inf)
    limit[total > 0] = reach * expected / total[total > 0]
    o, e, w = owner, element, weight.astype(float)
    t, turn = np.zeros(len(o)), 0
    while len(o):
        turn += 1
        chance = mix(e + np.uint64((turn * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
        t = t - np.log(((chance >> np.uint64(11)) + np.uint64(1)).astype(float) / 2.0**53) / w
        live = t <= limit[o]
        o, e, w, t, chance = o[live], e[live], w[live], t[live], chance[live]
        slot = o * registers + (mix(chance) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, t)
        now = t == first[slot]
        taken[slot[now]] = e[now]
        if turn % 4 == 0:  # nothing that arrives after a text's last register is taken can change it
            np.minimum(limit, first.reshape(texts, registers).max(axis=1), out=limit)
    out = taken.reshape(texts, registers)
    open_ = np.flatnonzero((total > 0) & np.isinf(first.reshape(texts, registers)).any(axis=1))
    if len(open_):
        mine = np.isin(owner, open_)
        out[open_] = signatures(np.searchsorted(open_, owner[mine]), element[mine], weight[mine], len(open_), registers, reach * 2)
    return out


def banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of the registers of each band."""
    cut = signature.reshape(len(signature), bands, rows)
    total = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + cut[:, :, r])
    return total


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """`doc_id, h1, h2` (hash of the text) and the buckets of every row with an id and a text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in text_blocks(batch.column("text")):
                owner, element, _ = weighted(texts)
                count = block.stop - block.start
                buckets = banded(signatures(owner, element, np.ones(len(owner)), count, bands * rows), bands, rows).view(np.int64)
                some = np.bincount(owner, minlength=count) > 0
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[some].ravel()))
                part = batch.slice(block.start, count)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["doc_id", "h1", "h2", "buckets"])

    text = F.col("text").cast("string")
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("other"), text).alias("h2"), text.alias("text")
    )
    return known.mapInArrow(sign, "doc_id long, h1 long, h2 long, buckets array<long>")


def shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`doc_id, shingles`: sorted distinct shingle hashes of the texts of the documents `ids`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in text_blocks(batch.column("text")):
                owner, element, _ = weighted(texts)
                ends = np.searchsorted(owner, np.arange(block.stop - block.start + 1))
                sets = [element[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                ids = batch.column("doc_id").slice(block.start, block.stop - block.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.join(ids, "doc_id", "left_semi").mapInArrow(cut, "doc_id long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sets of shingles are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(x.as_py(), y.as_py()) >= similar for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def open_buckets(members: DataFrame, groups: DataFrame | None, seed: int) -> DataFrame:
    """Members of the buckets that hold several groups, with the group and the bucket's centre."""
    if groups is None:
        rows = members.withColumn("root", F.col("doc_id"))
    else:
        rows = members.join(groups.select(F.col("a").alias("doc_id"), F.col("b").alias("found")), "doc_id", "left").select(
            "bucket", "doc_id", F.coalesce("found", "doc_id").alias("root")
        )
    rank = F.struct((F.xxhash64(F.lit(seed), "doc_id") if seed else F.lit(0)).alias("r"), F.col("doc_id"), F.col("root"))
    centres = rows.groupBy("bucket").agg(
        F.min(rank).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low < high").select("bucket", F.col("c.doc_id").alias("centre"), F.col("c.root").alias("centre_root"))
    return rows.join(centres, "bucket")


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def in_blocks(meet: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between different components of the members of large buckets, enough to join them."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links, root = [], {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        if left.num_rows and right.num_rows:
            mine, other = ([np.frombuffer(x.as_py(), np.uint64) for x in column] for column in (left["shingles"], right["shingles2"]))
            sizes = np.array([len(x) for x in other])
            words, codes = np.unique(np.concatenate([*mine, *other]), return_inverse=True)
            cut = np.cumsum([len(x) for x in mine])
            theirs, starts = codes[cut[-1] :], np.cumsum(sizes) - sizes
            ids, roots = right["doc_id2"].to_numpy(), right["root2"].to_numpy()
            for k, (doc, own) in enumerate(zip(left["doc_id"].to_pylist(), left["root"].to_pylist(), strict=True)):
                flag = np.zeros(len(words), np.int32)
                flag[codes[cut[k] - len(mine[k]) : cut[k]]] = 1
                both = np.add.reduceat(flag[theirs], starts)
                alike = both >= similar * (len(mine[k]) + sizes - both)
                for j in np.flatnonzero(alike & (roots != own)):
                    a, b = find(own), find(int(roots[j]))
                    if a != b:
                        root[a] = b
                        links.append((doc, int(ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def blocks_of(number: str) -> Column:
        return F.ceil(F.col(number) / SIDE).cast("int")

    spread = F.xxhash64(F.lit("block"), "doc_id")
    members = meet.withColumns({"i": F.pmod(spread, blocks_of("m")).cast("int"), "j": F.pmod(spread, blocks_of("n")).cast("int")})
    left = members.where("root <> centre_root").withColumn("j", F.explode(F.sequence(F.lit(0), blocks_of("n") - 1)))
    right = members.withColumn("i", F.explode(F.sequence(F.lit(0), blocks_of("m") - 1)))
    key = ["bucket", "i", "j"]
    names = [*key, "doc_id", "root"]
    near = left.select(*names).join(sets, "doc_id").select(*names, "shingles")
    far = right.select(*names).join(sets, "doc_id").select(*names, "shingles").toDF(*[f"{x}2" for x in (*names, "shingles")])
    return near.groupBy(*key).cogroup(far.groupBy(*[f"{x}2" for x in key])).applyInArrow(compare, "a long, b long").distinct()


def linked(docs: DataFrame, members: DataFrame, similar: float, rounds: int) -> DataFrame:
    """Components of the verified links between documents that share buckets."""
    meet = open_buckets(members, None, 0)
    meet = cut_lineage(meet.select("bucket", "doc_id", "root", "centre", "centre_root"))
    members = meet.select("bucket", "doc_id")
    sets = cut_lineage(shingled(docs, members.select("doc_id").distinct()))
    links, tried, groups = None, None, None
    for turn in range(rounds + 1):
        if turn:
            meet = cut_lineage(open_buckets(members, groups, turn))
            if meet.isEmpty():
                break
        if turn < rounds:
            pairs = pairs_of(meet.where("root <> centre_root").select(F.col("doc_id").alias("x"), F.col("centre").alias("y")))
        else:
            meet = meet.join(meet.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("root") != F.col("centre_root")).alias("m")), "bucket")
            # whatever lies in the centre's group meets the others; the others meet each other
            few = meet.where(F.col("n") <= LARGE)
            near, far = few.select("bucket", F.col("doc_id").alias("x"), F.col("root").alias("rx")), few.where(
                "root <> centre_root"
            ).select("bucket", F.col("doc_id").alias("y"), F.col("root").alias("ry"))
            pairs = pairs_of(near.join(far, "bucket").where("rx <> ry").select("x", "y"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        new = verified(pairs, sets, similar)
        if turn == rounds:
            new = new.unionByName(in_blocks(meet.where(F.col("n") > LARGE), sets, similar))
        new = cut_lineage(new)
        links = new if groups is None else new.unionByName(groups)
        tried = pairs if tried is None else tried.unionByName(pairs)
        groups = components(links)
    return groups


def classes(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, copy_of, class_id, keep` for every row of `docs`."""
    sums = cut_lineage(signed(docs, bands, rows))
    copies = cut_lineage(sums.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "buckets")).alias("first")).select(
        "h1", "h2", F.col("first.doc_id").alias("copy_of"), F.col("first.buckets").alias("buckets")
    ))
    members = copies.select(F.explode("buckets").alias("bucket"), F.col("copy_of").alias("doc_id"))
    same = sums.select("doc_id", "h1", "h2").join(copies.drop("buckets"), ["h1", "h2"]).select("doc_id", "copy_of")
    # a document with several texts holds their groups together
    twice = same.where("doc_id <> copy_of")
    several = sums.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("n")).where("n > 1").select("doc_id")
    tied = twice.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b"))
    groups = components(linked(docs, members, similar, rounds).unionByName(tied))
    whole = same.join(groups.select(F.col("a").alias("copy_of"), F.col("b").alias("root")), "copy_of", "left")
    found = whole.select("doc_id", "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    other = docs.where("doc_id is null or text is null").select(F.col("doc_id").cast("long").alias("doc_id"))
    alone = other.select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"))
    return found.unionByName(alone).withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame, **levels: float) -> DataFrame:
    """The rows of `docs`, with all columns, without those of which another row of the same group stays: of each group, one row
    of the document with the smallest id."""
    verdicts = cut_lineage(classes(docs.where("text is not null"), **levels).where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("keep").alias("keep")
    ))
    other = free_name(docs, "_dup_id")
    here = F.col("doc_id").cast("long") == F.col(other)
    gone = verdicts.where("not keep or rows > 1").select(F.col("doc_id").alias(other))
    twice = verdicts.where("keep and rows > 1").select(F.col("doc_id").alias(other))
    left = docs.join(gone, here & F.col("text").isNotNull(), "left_anti")
    if twice.isEmpty():
        return left
    return left.unionByName(docs.where("text is not null").join(twice, here, "left_semi").dropDuplicates(["doc_id"]))
