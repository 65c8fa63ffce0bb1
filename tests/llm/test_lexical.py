"""Ranked search against a plain version, its bounds, and its edges."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from rollcall.llm import lexical
from rollcall.llm.queries import ORACLE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """item -> (rank, doc, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in counts if c]
    n, total = len(full), sum(sum(c.values()) for c in full)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    found = {}
    for item, words in asked.items():
        weight = {w: floor(1000 * log((2 * n + 2) / (2 * df + 1))) for w in words if (df := sum(w in c for c in full))}
        scores = []
        for doc, c in counts:
            size = sum(c.values())
            m = 10 + 90 * size * n // max(total, 1)
            score = sum(x * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, x in weight.items() if w in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        found[item] = [(r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k])]
    return {i: x for i, x in found.items() if x}


def got(found):
    rows = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        rows.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return rows


def tables(spark, docs, items):
    docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(3)
    return docs, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


def random_docs(r, n):
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(2000)]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 200])))) for i in range(n)]


def test_random_texts(spark):
    r = random.Random(3)
    docs = random_docs(r, 300)
    docs += docs[:20] + [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[9][1])] * 2
    items = [(i, " ".join(t.split()[:25])) for i, t in random_docs(r, 25)] + [(50, docs[7][1]), (None, "w1 w2"), (None, "w3"), (60, "nowhere")]
    d, q = tables(spark, docs, items)
    want = plain(docs, items)
    assert got(lexical.search(d, q)) == want and 60 not in want and None in want
    # other heads, blocks of items and vectors of all terms give the same
    assert got(lexical.search(d, q, head=1, block=40)) == want
    assert got(lexical.search(d, q, most_terms=3, head=50)) == want
    assert got(lexical.search(d, q, k=3)) == plain(docs, items, 3)


def test_bounds_leave_vectors_out(spark):
    """Most vectors are never scored, though buckets are small and every document shares some word with the items."""
    r = random.Random(4)
    docs = [(i, " ".join(["all", *(f"r{r.randrange(400)}" for _ in range(20))])) for i in range(3000)]
    items = [(1, "all r1 r2 r3"), (2, docs[5][1])]
    d, q = tables(spark, docs, items)
    asked = lexical.item_terms(q)
    known = np.sort(asked.select("term").distinct().toArrow().column("term").to_numpy())
    vectors = lexical.doc_vectors(d, known)
    corpus = lexical.Corpus(len(docs), 21 * len(docs))
    block = lexical.Items.of(lexical.weighted(asked, vectors, corpus).toArrow())
    search = lexical.Search(block, corpus, 10, np.zeros(2), bucket=64)
    for batch in vectors.coalesce(1).toArrow().to_batches():
        search.add(batch)
    assert got(lexical.best_of(spark.createDataFrame(search.result().to_pandas()), 10)) == plain(docs, items)
    assert search.scored < 0.5 * 2 * len(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "Ää1 x\x00y Ä"), (5, "long " * 300_000), (5, "long"), (None, "long"), (-7, "long")]
    items = [(1, None), (2, "LONG ä"), (3, "X,Y Ää1"), (4, "")]
    d, q = tables(spark, docs, items)
    want = plain(docs, items)
    assert got(lexical.search(d, q)) == want and [x[1] for x in want[2]] == [5, -7, 5, None]
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    found = lexical.search(d.where("doc_id < 4"), q)
    assert got(found) == plain([x for x in docs if x[0] is not None and x[0] < 4], items)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    assert "op11_lexical_search" in ORACLE
