"""Near-duplicates against a comparison of all pairs; signatures against probability Jaccard."""

import random

import numpy as np
import pytest

from rollcall.llm import near_dup, queries
from rollcall.llm.components import components
from tests.conftest import SF
from tests.llm.brute import groups, jaccard, shingles

SCHEMA = "doc_id long, text string, bucket string, keep string, copy_of int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "b", "k", 0) for i, t in rows], SCHEMA)


def found(spark, rows, **levels):
    return near_dup.classes(table(spark, rows), **levels).collect()


def words(draw, n):
    return [f"w{draw.randint(0, 4000)}" for _ in range(n)]


def edited(draw, text, changes):
    text = list(text)
    for i in draw.sample(range(len(text)), changes):
        text[i] = f"e{draw.randint(0, 10**6)}"
    return text


def test_registers_estimate_probability_jaccard():
    draw, texts = random.Random(1), []
    for _ in range(150):
        a = words(draw, draw.choice([40, 200])) * draw.choice([1, 2])
        texts += [" ".join(a), " ".join(edited(draw, a, max(1, len(a) // 40)))]
    owner, element, weight = near_dup.weighted(texts)
    registers = near_dup.signatures(owner, element, weight, len(texts), 256)
    for i in range(0, len(texts), 2):
        x, y = ({e: w for e, w in zip(element[owner == k].tolist(), weight[owner == k].tolist(), strict=True)} for k in (i, i + 1))
        exact = sum(1 / sum(max(x.get(u, 0) / x[t], y.get(u, 0) / y[t]) for u in {*x, *y}) for t in x.keys() & y.keys())
        assert abs((registers[i] == registers[i + 1]).mean() - exact) < 0.15


def test_copies_and_near_copies(spark):
    draw, rows = random.Random(2), []
    for k in range(60):
        base = words(draw, draw.choice([30, 120, 400]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(draw.randint(0, 3)):
            rows.append((len(rows), " ".join(edited(draw, base, draw.randint(0, max(1, len(base) // 60))))))
    draw.shuffle(rows)
    want = groups(dict(rows))
    got = found(spark, rows)
    assert {r.doc_id: r.class_id for r in got} == want
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    assert {r.doc_id: r.copy_of for r in got} == {i: first[t] for i, t in rows}
    assert all(r.keep == (r.doc_id == r.class_id) for r in got)


def test_chain_and_hot_group(spark):
    """A chain in which only neighbours are alike, and a large group of copies each with an edit of its own."""
    draw = random.Random(3)
    chain = [words(draw, 200)]
    for _ in range(12):
        chain.append(edited(draw, chain[-1], 3))
    base = words(draw, 150)
    rows = [(i, " ".join(t)) for i, t in enumerate(chain)] + [(100 + i, " ".join(edited(draw, base, 1))) for i in range(150)]
    sets = [shingles(t) for _, t in rows]
    assert jaccard(sets[0], sets[12]) < 0.8
    assert {r.doc_id: r.class_id for r in found(spark, rows)} == groups(dict(rows))


@pytest.mark.parametrize("rounds,large,side", [(0, 64, 1024), (1, 64, 1024), (3, 64, 1024), (0, 3, 7), (1, 3, 7), (0, 1, 100)])
def test_rounds_and_blocks_only_save_work(spark, monkeypatch, rounds, large, side):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "SIDE", side)
    draw = random.Random(4)
    base = words(draw, 150)
    rows = [(i, " ".join(edited(draw, base, draw.randint(1, 6)))) for i in range(60)]
    assert {r.doc_id: r.class_id for r in found(spark, rows, rounds=rounds)} == groups(dict(rows))


def test_edges(spark):
    rows = [(None, "same text of five words"), (None, None), (1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (6, "A  b"), (7, "b a"), (8, " "),
            (9, "same text of five words"), (9, "same text of five words"), (10, "z " * 100_000), (11, "z " * 100_001), (12, "solo"), (12, "duo")]
    got = sorted(((r.doc_id, r.class_id, r.keep) for r in found(spark, rows)), key=repr)
    want = [(None, None, True)] * 2 + [(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True),
            (9, 9, True), (9, 9, True), (10, 10, True), (11, 10, False), (12, 12, True), (12, 12, True)]
    assert got == sorted(want, key=repr)
    left = near_dup.deduplicate(table(spark, rows))
    assert left.columns == ["doc_id", "text", "bucket", "keep", "copy_of"]
    ids = sorted((r.doc_id or 0) for r in left.collect())
    assert ids == [0, 0, 1, 2, 3, 5, 7, 8, 9, 10, 12]
    assert near_dup.classes(table(spark, [])).count() == 0 and near_dup.deduplicate(table(spark, [])).count() == 0


def test_the_table(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.class_id for r in queries.op5_near_dup(spark, SF).collect()}
    want = groups({i: t for i, t in texts.items() if t is not None})
    assert got == {**want, **{i: i for i, t in texts.items() if t is None}}


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root) if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_registers():
    none = np.empty(0, np.int64)
    assert (near_dup.signatures(none, none.astype(np.uint64), none, 3, 8) == 0).all()


def test_how_often_a_line_repeats_does_not_matter(spark):
    """Sets that are alike, of texts in which a line occurs once and many times."""
    draw, rows = random.Random(6), []
    for k, (size, times) in enumerate([(200, 10), (200, 40), (500, 200), (300, 100)] * 3):
        base, line = words(draw, size), [f"line{k}w{i}" for i in range(12)]
        rows += [(2 * k, " ".join([*base, *line])), (2 * k + 1, " ".join([*base, *line * times]))]
    sets = [shingles(t) for _, t in rows]
    assert all(jaccard(a, b) >= 0.9 for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = {r.doc_id: r.class_id for r in found(spark, rows)}
    assert got == groups(dict(rows)) == {i: i // 2 * 2 for i, _ in rows}


def test_columns_with_the_names_used_inside(spark):
    rows = [(1, "one two three four five six", 7, 8), (2, "one two three four five six", 7, 8), (3, "other words that stand alone here", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dup_id long, _DUP_id_ long")
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
