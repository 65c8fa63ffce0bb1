"""Language-model scores from a log-frequency Bloom filter.

Tokens are words between ASCII white space, with A-Z in lower case, and an end for each text. Documents are tokenised once, in blocks
of about `BLOCK` bytes, each with the hashes of its words and their counts in learning documents. Blocks send these, cut by
ranges of the hash, to the task of the range, which adds up the counts of all blocks and sends each block those of its own words. So every
block knows the exact count of each of its words, and no task holds the whole vocabulary.

The model is a bigram model. Unigrams are discounted by D, and what that leaves goes to the unknown word:
    P1(w) = (c(w) - D) / N, P1(unknown) = D V / N, with D from the numbers of words that occur once and twice.
Every bigram of the learning documents is held, from a count of one on. Counts are quantised to powers of `BASE`, and the filter holds a bigram
once for each level up to its own, so its count is read by probing level after level until one is missing. With counts c' read from it,
    P(w | h) = (c'(h w) - D + R(h) P1(w)) / (K(h) + R(h)), R(h) = the rest c(h) - K(h), at least `REST` c(h),
where c' is rounded down and K(h) is the sum of c'(h w) - D over all w, so the probabilities of all words add up to one at most, but for
false positives of the filter. A first word that nothing was learned to follow, and the first token of a text, have P1.

The filter is cut by ranges of a hash of the bigrams, as many as keep a range to about `RANGE` learned tokens or fewer, so no task holds more
of it, however large the corpus. Building and probing are tasks of their own. One task adds up the counts of a range and fills its part of the
filter; of the counts, nothing but the bits and the sums K leaves it. Another task is sent the bits and the bigrams of the blocks in that range, never
a count of a bigram, and reads the levels off by membership probes alone. The bigrams are shuffled once for both; counts travel apart from them. The sums K
come to the blocks by ranges of the words.

Words are told apart by 64-bit hashes. Null and empty texts are one end token. Rows without id count as learning documents and keep
their null id; repeated rows count each time. An empty table gives an empty result. If nothing may be learned, base and model scores come from zero
counts. Only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from rollcall.llm.words import Words, blocks, mix, text_blocks
from rollcall.sources.lineage import cut_lineage, new_folder, remove

#: Bytes of text in a block; learned tokens for each range of bigrams; ratio of two levels of a count.
BLOCK, RANGE, BASE = 4 << 20, 1 << 22, 1.25
#: Least share of a first word's count that other words keep.
REST = 0.3
#: Sums over bigrams are whole numbers of these parts of one, so that their order doesn't matter.
_UNIT = 1 << 20
#: Bits for an entry of the filter and probes of it: one false positive in a thousand.
BITS, PROBES, SEGMENT = 14.4, 10, 1 << 21
END = np.uint64(0x1D8E4E27C47D124F)
_BIGRAM, _FIRST = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def planes(values: np.ndarray) -> bytes:
    """Numbers as they travel: their first bytes, then the second ones and so on, compressed, after the length of that."""
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def from_planes(data: bytes, kind: type = np.uint64) -> np.ndarray:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def tokenised(docs: DataFrame, may_learn: Column, block: int) -> DataFrame:
    """Two rows for each block. `texts`: ids, whether each is held out, ends of the texts, tokens as numbers of the block's words and these numbers in
    the order of the words' hashes. `words`: the hashes, their counts in learning documents, and the sum of these."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, learn = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, texts in text_blocks(batch.column(2), block):
                hashes, counts = [], []
                for part in blocks([len(x) for x in texts]):
                    words = Words(texts[part], "ascii")
                    ends = words.bounds[1:]
                    hashes.append(np.insert(words.hash, ends, END))
                    counts.append(words.counts + 1)
                size = np.concatenate(counts)
                known, tokens, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                # the most frequent first, so that most numbers are small and the tables compress well
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                known, tokens = known[order], rank[tokens]
                own = np.repeat(np.array(learn[rows], bool), size)
                train = np.bincount(tokens[own], minlength=len(known)).astype(np.uint32)
                by_hash = np.argsort(known)
                row = dict.fromkeys(names, [None]) | {
                    "kind": ["words"], "block": [serial], "words": [known.tobytes()], "train": [planes(train)], "n": [int(own.sum())],
                }
                yield pa.RecordBatch.from_pydict(row, schema=_arrow)
                row = dict.fromkeys(names, [None]) | {
                    "kind": ["texts"], "block": [serial], "ids": [ids[rows]], "held": [[not x for x in learn[rows]]], "ends": [planes(np.cumsum(size))],
                    "tokens": [planes(tokens.astype(np.uint32))], "order": [planes(by_hash.astype(np.uint32))],
                }
                yield pa.RecordBatch.from_pydict(row, schema=_arrow)
                serial += 1

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(may_learn, F.lit(True)).alias("learn"), F.col("text").cast("string").alias("text")
    )
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64()]
    names = ["kind", "block", "ids", "held", "ends", "tokens", "order", "words", "train", "n"]
    _arrow = pa.schema(list(zip(names, kinds, strict=True)))
    return rows.mapInArrow(
        read,
        "kind string, block long, ids array<long>, held array<boolean>, ends binary, tokens binary, order binary, words binary, train binary, n long",
    )


def ranges(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted hashes that agree in their first `bits` bits."""
    if len(hashes):
        top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        cut = np.flatnonzero(np.diff(top)) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(top)), strict=True):
            yield int(top[a]), slice(a, b)


def _u64(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.uint64)


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known, back = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(known), np.uint64)
    np.add.at(total, back, counts)
    return known, total, back


def word_counts(blocks_: DataFrame, bits: int) -> DataFrame:
    """`block, part, counts, number`: the counts over all documents of a block's words in a range of hashes, in the order of the hashes, and of
    those that were learned the number among all learned words of the range. The first row of a range also has the number of words learned, and
    of those that occur once and twice."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, train in zip(*batch.columns, strict=True):
                hashes, counts = _u64(words), from_planes(train.as_py(), np.uint32)
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                parts = list(ranges(hashes, bits))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _ in parts], pa.int32()), "block": pa.array([block.as_py()] * len(parts), pa.int64()),
                    "words": pa.array([planes(hashes[s]) for _, s in parts], pa.binary()),
                    "train": pa.array([planes(counts[s]) for _, s in parts], pa.binary()),
                })

    def count(table: pa.Table) -> pa.Table:
        words, train = [from_planes(x.as_py()) for x in table["words"]], [from_planes(x.as_py(), np.uint32) for x in table["train"]]
        _, total, back = summed(np.concatenate(words), np.concatenate(train))
        ends = np.cumsum([len(x) for x in words])[:-1]
        counts, rank = np.split(total[back], ends), np.split((np.cumsum(total > 0) - 1)[back], ends)
        number = [n[c > 0].astype(np.uint32) for n, c in zip(rank, counts, strict=True)]
        first = [1] + [0] * (len(words) - 1)
        stats = {"v": int((total > 0).sum()), "once": int((total == 1).sum()), "twice": int((total == 2).sum())}
        return pa.table({
            "block": table["block"], "part": table["part"],
            "counts": pa.array([planes(x) for x in counts], pa.binary()), "number": pa.array([planes(x) for x in number], pa.binary()),
        } | {k: pa.array([x * v for x in first], pa.int64()) for k, v in stats.items()})

    dealt = blocks_.select("block", "words", "train").mapInArrow(deal, "part int, block long, words binary, train binary")
    return dealt.groupBy("part").applyInArrow(count, "block long, part int, counts binary, number binary, v long, once long, twice long")


class Block:
    """A block with the global counts of its words, and a number for each learned word. `offsets`: the number of the first word of each range."""

    def __init__(self, own: pa.Table, counts: pa.Table, offsets: np.ndarray):
        self.ids, self.held = own["ids"][0].as_py(), own["held"][0].as_py()
        self.ends = from_planes(own["ends"][0].as_py(), np.int64)
        self.tokens, self.order = (from_planes(own[x][0].as_py(), np.uint32).astype(np.int64) for x in ("tokens", "order"))
        parts = [int(i) for i in np.argsort(counts["part"].to_numpy())]
        known = np.concatenate([from_planes(counts["counts"][i].as_py()) for i in parts])
        self.counts, self.number = np.empty(len(self.order), np.uint64), np.zeros(len(self.order), np.uint64)
        self.counts[self.order] = known
        self.number[self.order[known > 0]] = np.concatenate([
            from_planes(counts["number"][i].as_py(), np.uint32) + offsets[counts["part"][i].as_py()] for i in parts
        ])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of learned words that are neighbours, as first * words + second; their number in learning documents, and the pair of each
        token that ends one (-1: none)."""
        learned = self.counts > 0
        second = np.ones(len(self.tokens), bool)
        second[0] = False
        second[self.ends[:-1]] = False
        second[1:] &= learned[self.tokens[1:]] & learned[self.tokens[:-1]]
        where = np.flatnonzero(second)
        known, back = np.unique(self.tokens[where - 1] * len(self.counts) + self.tokens[where], return_inverse=True)
        own = np.repeat(~np.array(self.held, bool), np.diff(self.ends, prepend=0))
        times = np.bincount(back[own[where]], minlength=len(known))
        at = np.full(len(self.tokens), -1, np.int64)
        at[where] = back
        return known, times, at

    def dealt(self, pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """A key of both words' numbers for each pair (the first word's come first), the order in which pairs are dealt, and its ranges: by a hash of both
        words, so that a frequent first word is spread, and inside a range by the key, so that it compresses."""
        keys = self.number[pairs // len(self.counts)] << np.uint64(32) | self.number[pairs % len(self.counts)]
        top = mix(keys) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        order = np.lexsort((keys, top))
        return keys, order, list(ranges(top[order] << np.uint64(64 - bits) if bits else top, bits))


def by_block(blocks_: DataFrame) -> GroupedData:
    return blocks_.select("block", "ids", "held", "ends", "tokens", "order").groupBy("block")


def bigrams(blocks_: DataFrame, counts: DataFrame, offsets: np.ndarray, bits: int) -> tuple[DataFrame, DataFrame]:
    """The bigrams of each block in a range, as two tables: `part, block, keys`, and `part, block, counts` in the order of the keys."""
    both = by_block(blocks_).cogroup(counts.select("block", "part", "counts", "number").groupBy("block"))

    def table(name: str) -> DataFrame:
        def deal(_key, own: pa.Table, counts: pa.Table) -> pa.Table:
            block = Block(own, counts, offsets)
            known, times, _ = block.pairs()
            keys, order, parts = block.dealt(known, bits)
            values = (keys if name == "keys" else times.astype(np.uint32))[order]
            return pa.table({
                "part": pa.array([p for p, _ in parts], pa.int32()), "block": pa.array([own["block"][0].as_py()] * len(parts), pa.int64()),
                name: pa.array([planes(values[s]) for _, s in parts], pa.binary()),
            })

        return both.applyInArrow(deal, f"part int, block long, {name} binary")

    return table("keys"), table("counts")


def built(keys: DataFrame, counts: DataFrame, offsets: np.ndarray, discount: float, coarse: int) -> DataFrame:
    """Two sorts of rows of a range. `part, bits`: its filter. `part, words, firsts, sums`: what the discounted bigrams of first words in a range
    of words (several ranges of the counts: those that agree but for `coarse` bits) add up to."""

    def build(_key, own: pa.Table, counts: pa.Table) -> pa.Table:
        own, counts = own.sort_by("block"), counts.sort_by("block")
        known, total, _ = summed(
            np.concatenate([from_planes(x.as_py()) for x in own["keys"]]), np.concatenate([from_planes(x.as_py(), np.uint32) for x in counts["counts"]])
        )
        known, total = known[total > 0], total[total > 0]
        exact = level(total.astype(float), 1.0)
        filter_ = Filter(max(1, math.ceil(int(exact.sum()) * BITS / SEGMENT)))
        for some in blocks(exact.tolist(), 1 << 20):
            filter_.add(entries(known[some] ^ _BIGRAM, exact[some]))
        first, of = np.unique(known >> np.uint64(32), return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, of, np.ceil((count_of(exact, 1.0) - discount) * _UNIT).astype(np.int64))
        range_ = (np.searchsorted(offsets, first, side="right") - 1) >> coarse
        cut = np.flatnonzero(np.diff(range_, prepend=-1))
        words = [slice(a, b) for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True)]
        return pa.table({
            "part": pa.array([own["part"][0].as_py()] * (1 + len(words)), pa.int32()),
            "bits": pa.array([filter_.bits.tobytes(), *[None] * len(words)], pa.binary()),
            "words": pa.array([None, *[int(range_[s.start]) for s in words]], pa.int32()),
            "firsts": pa.array([None, *[planes(np.diff(first[s].astype(np.uint32), prepend=np.uint32(0))) for s in words]], pa.binary()),
            "sums": pa.array([None, *[planes(sums[s]) for s in words]], pa.binary()),
        })

    return keys.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(build, "part int, bits binary, words int, firsts binary, sums binary")


def probed(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """`block, part, levels`: what the filter of a range gives for the bigrams of a block. Rows of `filters` that are no filter are passed on."""

    def probe(_key, own: pa.Table, filters: pa.Table) -> pa.Table:
        is_filter = pc.is_valid(filters["bits"])
        filter_ = Filter.of(filters.filter(is_filter)["bits"][0].as_py())
        mine = [from_planes(x.as_py()) for x in own["keys"]]
        known, back = np.unique(np.concatenate(mine), return_inverse=True)
        levels = np.split(filter_.levels(known ^ _BIGRAM).astype(np.uint8)[back], np.cumsum([len(x) for x in mine])[:-1])
        other = filters.filter(pc.invert(is_filter))
        n, m = len(levels), other.num_rows
        return pa.table({
            "block": pa.array([*own["block"].to_pylist(), *[None] * m], pa.int64()), "part": pa.array([*own["part"].to_pylist(), *[None] * m], pa.int32()),
            "levels": pa.array([*[planes(x) for x in levels], *[None] * m], pa.binary()),
            **{x: pa.array([*[None] * n, *other[x].to_pylist()], kind) for x, kind in (("words", pa.int32()), ("firsts", pa.binary()), ("sums", pa.binary()))},
        })

    return keys.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(
        probe, "block long, part int, levels binary, words int, firsts binary, sums binary"
    )


def masses(counts: DataFrame, sums: DataFrame, offsets: np.ndarray, coarse: int) -> DataFrame:
    """`block, part, counts, number`, and `mass`: what the discounted bigrams of each learned word add up to."""

    def add(_key, own: pa.Table, sums: pa.Table) -> pa.Table:
        out = own.select(["block", "part", "counts", "number"])
        first, total = np.empty(0, np.uint32), np.empty(0, np.int64)
        if sums.num_rows:
            first, back = np.unique(np.concatenate([np.cumsum(from_planes(x.as_py(), np.uint32), dtype=np.uint32) for x in sums["firsts"]]), return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, back, np.concatenate([from_planes(x.as_py(), np.int64) for x in sums["sums"]]))
        first, total = np.append(first.astype(np.uint64), np.uint64(1 << 63)), np.append(total, 0)
        mass = []
        for part, number in zip(own["part"].to_pylist(), own["number"], strict=True):
            mine = from_planes(number.as_py(), np.uint32) + offsets[part]
            at = np.searchsorted(first, mine)
            mass.append(planes(np.where(first[at] == mine, total[at] / _UNIT, 0.0).astype(np.float32)))
        return out.append_column("mass", pa.array(mass, pa.binary()))

    words = counts.select(F.shiftright("part", coarse).alias("words"), "block", "part", "counts", "number").groupBy("words")
    return words.cogroup(sums.groupBy("words")).applyInArrow(add, "block long, part int, counts binary, number binary, mass binary")


def level(counts: np.ndarray, least: float, up: bool = False) -> np.ndarray:
    """Levels of counts: 1 from `least` on; rounded down, or up."""
    exact = np.log(np.maximum(counts, least) / least) / math.log(BASE)
    return (np.ceil(exact - 1e-9) if up else np.floor(exact + 1e-9)).astype(np.int64) + 1


def count_of(levels: np.ndarray, least: float) -> np.ndarray:
    return least * BASE ** (levels - 1.0)


class Filter:
    """A Bloom filter in segments; a key lies in one of them."""

    def __init__(self, segments: int):
        self.bits = np.zeros((segments, SEGMENT // 8), np.uint8)

    @classmethod
    def of(cls, bits: bytes) -> Filter:
        """The filter that `bits` were taken from; it can only be probed."""
        made = cls(0)
        made.bits = np.frombuffer(bits, np.uint8).reshape(-1, SEGMENT // 8)
        return made

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = mix(keys)
        step = mix(keys ^ _BIGRAM)
        return (first % np.uint64(len(self.bits))).astype(np.int64), first >> np.uint64(20), step | np.uint64(1)

    def add(self, keys: np.ndarray) -> None:
        segment, first, step = self.places(keys)
        for i in range(PROBES):
            bit = ((first + step * np.uint64(i)) % np.uint64(SEGMENT)).astype(np.int64)
            np.bitwise_or.at(self.bits, (segment, bit >> 3), (1 << (bit & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        segment, first, step = self.places(keys)
        live = np.arange(len(keys))
        for i in range(PROBES):
            bit = ((first[live] + step[live] * np.uint64(i)) % np.uint64(SEGMENT)).astype(np.int64)
            live = live[(self.bits[segment[live], bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
        out = np.zeros(len(keys), bool)
        out[live] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each key are held, by probing one after the other."""
        out = np.zeros(len(keys), np.int64)
        live, now = np.arange(len(keys)), 1
        while len(live):
            live = live[self.has(at_level(keys[live], now))]
            out[live] = now
            now += 1
        return out


def at_level(keys: np.ndarray, level_: np.ndarray | int) -> np.ndarray:
    return mix(keys + np.asarray(level_, np.uint64) * _FIRST)


def entries(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Each key at each level up to its own."""
    each = np.repeat(keys, levels)
    number = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    return at_level(each, number)


def score(docs: DataFrame, may_learn: Column, block: int = BLOCK) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every row of `docs`."""
    spark = docs.sparkSession
    bits = math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    folder = new_folder(spark)
    rows = tokenised(docs, may_learn, block)
    rows.write.partitionBy("kind").parquet(folder)
    words = spark.read.schema(rows.schema).parquet(folder).where("kind = 'words'")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    counts = cut_lineage(word_counts(words, bits))
    remove(spark, f"{folder}/kind=words")  # half of the table, and of no more use
    own = spark.read.schema(rows.schema).parquet(folder).where("kind = 'texts'")
    found = {x: 0 for x in ("v", "once", "twice")}
    kinds = np.zeros(1 << bits, np.uint64)
    for row in counts.groupBy("part").agg(*[F.sum(x).alias(x) for x in found]).collect():  # a row for each range
        kinds[row["part"]] = row["v"]
        found = {x: n + row[x] for x, n in found.items()}
    offsets = np.cumsum(kinds) - kinds
    v, once, twice = (found[x] for x in ("v", "once", "twice"))
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    pair_bits = max(bits, math.ceil(math.log2(max(1, total / RANGE))))
    coarse = min(bits, 3)
    keys, times = bigrams(own, counts, offsets, pair_bits)
    read = cut_lineage(probed(keys, built(keys, times, offsets, discount, coarse)))
    none = F.lit(None).cast("binary")
    parts = masses(counts, read.where("block is null").select("words", "firsts", "sums"), offsets, coarse).withColumn("levels", none).unionByName(
        read.where("block is not null").select("block", "part", none.alias("counts"), none.alias("number"), none.alias("mass"), "levels")
    )

    def scored(_key, own: pa.Table, parts: pa.Table) -> pa.Table:
        of_words = parts.filter(pc.is_valid(parts["counts"]))
        of_pairs = parts.filter(pc.is_valid(parts["levels"])).sort_by("part")
        part = Block(own, of_words, offsets)
        c = part.counts.astype(float)
        base = np.log10((c + 0.1) / (total + 0.1 * (v + 1)))
        rest = discount * v / total if total and v else 1.0
        single = np.where(c > 0, (c - discount) / max(total, 1), rest)
        pairs, _, at = part.pairs()
        p = single[part.tokens]
        mass = np.zeros(len(c))
        mass[part.order[c[part.order] > 0]] = np.concatenate([from_planes(x.as_py(), np.float32) for x in of_words.sort_by("part")["mass"]])
        # the weight of P1 after each word: 1 where nothing was learned to follow
        rest = np.maximum(c - mass, REST * c)
        weight = np.where(mass > 0, rest / np.maximum(mass + rest, 1e-9), 1.0)
        levels = np.zeros(len(pairs), np.int64)
        levels[part.dealt(pairs, pair_bits)[1]] = np.concatenate([np.empty(0, np.uint8), *[from_planes(x.as_py(), np.uint8) for x in of_pairs["levels"]]])
        first = pairs // len(c)
        seen = np.where((levels > 0) & (mass[first] > 0), np.maximum(count_of(levels, 1.0) - discount, 0.0), 0.0)
        extra = np.append(np.minimum(seen, mass[first]) / np.maximum(mass[first] + rest[first], 1e-9), 0.0)
        starts = np.concatenate(([0], part.ends[:-1]))
        before = np.ones(len(p))
        before[1:] = weight[part.tokens[:-1]]
        before[starts] = 1.0
        p = p * before + extra[at]
        known = c[part.tokens] > 0
        return pa.table({
            "doc_id": pa.array(part.ids, pa.int64()), "held_out": pa.array(part.held, pa.bool_()),
            "n_tokens": pa.array(part.ends - starts), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(starts), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base[part.tokens], starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        })

    return by_block(own).cogroup(parts.groupBy("block")).applyInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
