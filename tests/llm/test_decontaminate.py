"""Decontamination: alignment against a plain version, planted copies, clean documents."""

import random

import numpy as np

from rollcall.llm import decontaminate as dc
from rollcall.llm import queries
from tests.conftest import SF

LEFT = "doc_id long, text string, score string"
RIGHT = "item_id long, text string"


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = dc.SAME if a[i - 1] == b[j - 1] and a[i - 1] else -dc.OTHER
            h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] - dc.GAP, h[i, j - 1] - dc.GAP)
    return h.max()


def test_alignment():
    draw = np.random.default_rng(1)
    items, texts = draw.integers(0, 6, (60, 12)).astype(np.uint64), draw.integers(0, 6, (60, 30)).astype(np.uint64)
    assert np.allclose(dc.align(items, texts), [plain_alignment(a, b) for a, b in zip(items, texts, strict=True)])


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "s") for i, t in docs], LEFT), spark.createDataFrame(items, RIGHT)


def test_planted_copies(spark):
    draw = random.Random(2)
    word = lambda: f"w{min(int(draw.expovariate(1 / 80)), 3000)}"
    items = [(i, " ".join(word() for _ in range(draw.randint(15, 60)))) for i in range(40)]
    docs, leaked = [], set()
    for i in range(400):
        text = [word() for _ in range(draw.randint(0, 300))]
        if i % 4 == 0:
            item, copy = draw.choice(items)
            copy = [w if draw.random() > 0.12 else word() for w in copy.split()]
            at = draw.randint(0, len(text))
            text[at:at] = [w.upper() + draw.choice(["", ",", "."]) for w in copy]
            leaked.add((i, item))
        docs.append((i, " ".join(text)))
    docs_, items_ = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.score for r in dc.leaks(docs_, items_).collect()}
    assert len(leaked & got.keys()) >= 0.97 * len(leaked)
    assert {d for d, _ in got} <= {d for d, _ in leaked}
    few = {(r.doc_id, r.item_id): r.score for r in dc.leaks(docs_, items_, block=200).collect()}
    assert few == got  # items sent in several blocks
    assert sorted(r.doc_id for r in dc.clean(docs_, items_).collect()) == sorted({i for i, _ in docs} - {d for d, _ in got})


def test_an_item_in_every_document_keeps_seeds(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
    docs = [(i, f"n{i} {items[0][1]} m{i}") for i in range(50)]
    assert dc.leaks(*frames(spark, docs, items)).count() == 50


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(900))
    items = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (4, "only two"), (None, "x y z u v"), (5, passage), (6, "愛 é Ü ñ 1")]
    docs = [(None, "so ONE, two three-four five!"), (10, None), (11, ""), (12, "only two"), (13, "one two three"), (14, passage[2000:3500]), (15, "É 愛 é ü Ñ 1"),
            (16, "one two three four five " * 30_000), (17, "p1 p2 nothing p3"), (15, "É 愛 é ü Ñ 1")]
    docs_, items_ = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_, items_, leak=0.7).collect()}
    assert got == {(None, 1), (14, 5), (15, 6), (16, 1)}
    left = dc.clean(docs_, items_, leak=0.7)
    assert left.columns == docs_.columns and sorted(r.doc_id for r in left.collect()) == [10, 11, 12, 13, 17]
    assert dc.leaks(docs_.limit(0), items_).count() == 0
    assert dc.leaks(docs_, items_.limit(0)).count() == 0 and dc.clean(docs_, items_.limit(0)).count() == len(docs)


def test_the_table_holds_exact_copies(spark):
    import re

    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r.item_id: norm(r.text) for r in queries.table(spark, SF, "benchmark").collect()}
    docs = {r.doc_id: norm(r.text) for r in queries.table(spark, SF, "documents").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert want and want <= got and {d for d, _ in got} == {d for d, _ in want}


def edited_copies(draw, items, docs, copies):
    """Documents of words that no item has; every fifth holds half an item, or all of it with a fifth to a quarter of its words changed, `copies` times."""
    rows, leaked = [], set()
    for i in range(docs):
        text = [f"x{draw.randint(0, 5000)}" for _ in range(80)]
        times = 1
        if i % 5 == 0:
            item, copy = draw.choice(items)
            copy = copy.split()
            if i % 2:
                copy = copy[: len(copy) // 2 + 1]
            else:
                for k in range(draw.randint(0, 3), len(copy), 4 if i % 4 else 5):
                    copy[k] = f"y{draw.randint(0, 5000)}"
            text[40:40] = copy
            times = copies
        for _ in range(times):
            leaked |= {(len(rows), item)} if i % 5 == 0 else set()
            rows.append((len(rows), " ".join(text)))
    return rows, leaked


def test_edited_and_partial_copies_in_small_tables(spark):
    draw = random.Random(6)
    items = [(i, " ".join(f"v{draw.randint(0, 2000)}" for _ in range(40))) for i in range(20)]
    for docs, copies in ((1, 1), (300, 1), (11, 2000)):
        rows, leaked = edited_copies(draw, items, docs, copies)
        got = {(r.doc_id, r.item_id) for r in dc.leaks(*frames(spark, rows, items)).collect()}
        assert got == leaked


def test_bound_is_never_below_the_score():
    draw = np.random.default_rng(7)
    items, texts = draw.integers(1, 12, (300, 12)).astype(np.uint64), draw.integers(1, 20, (300, 8)).astype(np.uint64)
    held = np.stack([np.isin(a, b) for a, b in zip(items, texts, strict=True)])
    most = dc.bound(held.ravel(), np.full(300, 12))
    assert (most >= dc.align(items, texts) - 1e-4).all() and (most < 6).any()


def test_ordinary_ngrams_of_items_are_no_leak(spark):
    items = [(i, f"which one of the {' '.join(f'v{i}q{k}' for k in range(20))} is the one of the two") for i in range(30)]
    docs = [(i, f"n{i} was one of the m{i} and which one of the k{i} is the one of the two or not") for i in range(200)]
    assert dc.leaks(*frames(spark, docs, items)).count() == 0


def test_passages_of_long_items_overlap_and_none_is_short(spark):
    for size in (201, 202, 203, 299, 300, 301, 399, 400, 401, 900):
        item = [f"p{i}" for i in range(size)]
        docs = [(at, " ".join(["a", "b", *item[at : at + 80], "c", "d"])) for at in range(0, size - 79, 7)]
        docs += [(10_000 + at, f"some words and {' '.join(item[at : at + 8])} and more") for at in (0, 100, 200, size - 8, size - 5)]
        got = {r.doc_id for r in dc.leaks(*frames(spark, docs, [(1, " ".join(item))])).collect()}
        assert got == {d for d, _ in docs if d < 10_000}
    straddling = [(1, " ".join(f"p{i}" for i in range(121, 279)))]  # 79 words on each side of the 200th
    assert dc.leaks(*frames(spark, straddling, [(1, " ".join(f"p{i}" for i in range(400)))])).count() == 1
