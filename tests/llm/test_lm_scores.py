"""Base scores against brute force; the filter; that the model is a probability and beats the base on held-out texts."""

import math
from collections import Counter

import numpy as np

from rollcall.llm import lm_scores, queries
from tests.conftest import SF
from tests.llm.brute import base_scores, lm_tokens, remainder

F = lm_scores.F


def test_base_scores_of_the_table(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    want = base_scores(texts, lambda i: remainder(i, 10) != 0)
    got = queries.op3_lm_scores(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 10) == 0, tokens, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_gives_back_levels():
    draw = np.random.default_rng(1)
    keys, levels = draw.integers(0, 1 << 63, 20_000).astype(np.uint64), draw.integers(1, 12, 20_000)
    made = lm_scores.entries(keys, levels)
    assert len(made) == levels.sum()
    filter_ = lm_scores.Filter(1)
    filter_.add(made)
    found = filter_.levels(keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    sent = lm_scores.Filter.of(filter_.bits.tobytes())
    assert (sent.levels(keys) == found).all()
    other = draw.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (filter_.levels(other) > 0).mean() < 0.01


def test_levels_bracket_counts():
    counts = np.arange(8, 5000)
    low, high = (lm_scores.count_of(lm_scores.level(counts, 8.0, up), 8.0) for up in (False, True))
    assert (low <= counts * (1 + 1e-9)).all() and (high >= counts * (1 - 1e-9)).all() and (high / low <= 1.2501).all()


def test_probabilities_add_up_to_one_at_most(spark):
    """Every word after a frequent one: scores of two-word texts, less that of the first word."""
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    chain = [" ".join(words[(k * 5 + i * (1 + draw.integers(0, 2))) % 12] for i in range(30)) for k in range(60)]
    rows = [(i, t, True) for i, t in enumerate(chain)] + [(1000 + i, f"w3 {w}", False) for i, w in enumerate([*words, "never"])]
    rows += [(2000, "w3", False), (3000, "w3 ", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    found = {r.doc_id: r.score for r in lm_scores.score(docs, F.col("learn")).collect()}
    # log P(w3) + log P(w | w3) + log P(end | w): take off what is not P(w | w3)
    alone = {r.doc_id: r.score for r in lm_scores.score(docs.where("learn").unionByName(
        spark.createDataFrame([(4000, "", False)], "doc_id long, text string, learn boolean")), F.col("learn")).collect()}
    assert alone[4000] < 0
    total = sum(10 ** found[1000 + i] for i in range(13)) + 10 ** found[2000]
    assert total <= 1.0001  # of all texts that begin with w3 and end after at most one more word


def test_edges(spark):
    rows = [(None, None, 1.0), (1, "", 1.0), (2, "A b É", 1.0), (3, "a " * 300_000, 1.0), (4, "x\x0by\x1cz", 1.0), (4, "x\x0by\x1cz", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm_scores.score(docs, F.lit(True), block=1000).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 1, 1), (1, 1, 1), (2, 3, 3), (3, 300_001, 300_001), (4, 3, 3), (4, 3, 3)]
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    none = lm_scores.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in none)
    assert lm_scores.score(docs.limit(0), F.lit(True)).count() == 0


def test_blocks_do_not_matter(spark):
    docs = queries.table(spark, SF, "documents")
    runs = [sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores.score(docs, F.col("doc_id") % 10 != 0, block=b).collect()) for b in (20_000, 8 << 20)]
    assert runs[0] == runs[1]


def plain_scores(texts, learn):
    """Scores of a model that holds every bigram, with counts rounded down to levels."""
    tokens = {i: lm_tokens(t) for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if learn(i) for w in t)
    pairs = Counter(p for i, t in tokens.items() if learn(i) for p in zip(t, t[1:], strict=False))
    total, once, twice = sum(c.values()), *(sum(n == k for n in c.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    held = {p: float(lm_scores.count_of(lm_scores.level(np.array([n]), 1.0), 1.0)[0]) - d for p, n in pairs.items()}
    mass = Counter()
    for (h, _), x in held.items():
        mass[h] += x
    single = lambda w: (c[w] - d) / total if c[w] else d * len(c) / total

    def p(h, w):
        if not mass[h]:
            return single(w)
        rest = max(c[h] - mass[h], lm_scores.REST * c[h])
        return (held.get((h, w), 0.0) + rest * single(w)) / (mass[h] + rest)

    return {i: math.log10(single(t[0])) + sum(math.log10(p(*x)) for x in zip(t, t[1:], strict=False)) for i, t in tokens.items()}


def test_every_bigram_is_held(spark):
    """Bigrams that occur once or twice, in learned and in held-out texts, against a plain model."""
    draw = np.random.default_rng(3)
    texts = {i: " ".join(f"w{int(x)}" for x in draw.exponential(60, 40)) for i in range(200)}
    texts |= {1000: "rare pair", 1001: "rare pair of words", 1002: "pair rare of", 1003: "never"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    learn = (F.col("doc_id") % 4 != 0) | (F.col("doc_id") == 1000)
    want = plain_scores(texts, lambda i: i % 4 != 0 or i == 1000)
    got = {r.doc_id: r.score for r in lm_scores.score(docs, learn, block=3000).collect()}
    far = [i for i in texts if not math.isclose(got[i], want[i], rel_tol=1e-5)]
    assert len(far) <= 0.2 * len(texts)  # false positives of the filter: one in a thousand bigrams
    assert all(math.isclose(got[i], want[i], rel_tol=0.1) for i in texts)
    assert got[1000] - got[1002] > 1


def test_the_probing_task_gets_bits_and_no_counts(spark):
    """One range: the levels come from the filter that another task built, and the bigrams are shuffled once for both."""
    draw = np.random.default_rng(4)
    keys, counts = np.sort(draw.integers(0, 1 << 62, 500).astype(np.uint64)), draw.integers(0, 40, 500).astype(np.uint32)
    own, times = (
        spark.createDataFrame([(p, b, bytearray(lm_scores.planes(x[b::2]))) for p in (0, 1) for b in (0, 1)], f"part int, block long, {name} binary")
        for x, name in ((keys, "keys"), (counts, "counts"))
    )
    filters = lm_scores.built(own, times, np.zeros(1, np.uint64), 0.5, 0)
    assert filters.columns == ["part", "bits", "words", "firsts", "sums"]
    read = lm_scores.probed(own, filters)
    assert "counts" not in read.columns
    got = {(r.part, r.block): lm_scores.from_planes(r.levels, np.uint8) for r in read.where("block is not null").collect()}
    for (_, block), levels in got.items():
        mine = counts[block::2]
        want = np.where(mine > 0, lm_scores.level(np.maximum(mine, 1).astype(float), 1.0), 0)
        assert (levels >= want).all() and (levels > want).mean() < 0.02
    assert len(got) == 4 and read.where("block is null").count() > 0


def test_bigrams_are_shuffled_once(spark):
    """The plan of a whole run holds the exchange of the bigrams once; the probing side reads it again."""
    plans = []
    cut = lm_scores.cut_lineage
    lm_scores.cut_lineage = lambda df: (plans.append(df), cut(df))[1]
    try:
        lm_scores.score(queries.table(spark, SF, "documents"), F.col("doc_id") % 10 != 0)
    finally:
        lm_scores.cut_lineage = cut
    plan = plans[-1]
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 3  # the bigrams, and the blocks and their words under the counts
