"""Runs of words against all lags of small texts, and their edges."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rollcall.llm import periodic, queries
from tests.conftest import SF


def plain_runs(words, least=24):
    """For every lag, the longest stretches of words that agree; those of a smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        at = 0
        while at < len(words) - q:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, 3 * q):
                found.setdefault((at, end + q - at), q)
            at = end
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def numbers(words):
    known = periodic.Vocabulary()
    return known.codes(" ".join(words))


def runs_of(words):
    codes = numbers(words)
    return periodic.runs(codes, np.array([0, len(codes)]))[0]


def random_words(r, n):
    """Words of few kinds, with repeated stretches of any period, some inside others."""
    words = [r.choice("abcdefgh") for _ in range(n)]
    for _ in range(r.randrange(4)):
        at, q = r.randrange(n), r.choice([1, 2, 3, 5, 8, 16, 17, 31, 33, 40, 64, 65])
        for i in range(at + q, min(n, at + r.randrange(2 * q, 6 * q + 30))):
            words[i] = words[i - q]
    return words


def test_runs_of_random_texts():
    r = random.Random(5)
    some = 0
    for _ in range(400):
        words = random_words(r, r.randrange(1, 400))
        got = runs_of(words)
        assert got == plain_runs(words)
        some += len(got)
    assert some > 150


def test_several_texts_at_once():
    r = random.Random(6)
    texts = [random_words(r, r.randrange(0, 300)) if i else [] for i in range(1, 60)] + [[]]
    known = periodic.Vocabulary()
    codes = [known.codes(" ".join(t)) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    assert periodic.runs(np.concatenate(codes), starts) == [plain_runs(t) for t in texts]


def test_a_period_with_repeats_inside():
    """All k-grams of 16 words come twice inside the period, so only longer ones pair places a period apart."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    period = a + b + a + c + b + c
    assert runs_of(period * 3 + ["end"]) == [(0, 720, 240)] == plain_runs(period * 3 + ["end"])
    # 120 words twice, three times: the smallest period counts
    assert runs_of((a + b + c) * 6) == [(0, 720, 120)]


def test_limits_of_length():
    words = [f"w{i}" for i in range(9)]
    assert runs_of(["x"] * 23) == [] and runs_of(["x"] * 24) == [(0, 24, 1)]
    assert runs_of((words * 3)[:26]) == [] and runs_of(words * 3) == [(0, 27, 9)]
    with pytest.raises(ValueError):
        periodic.collapse(None, least=20)


def test_each_diagonal_is_walked_once(monkeypatch):
    walks = []
    monkeypatch.setattr(periodic, "agreeing", lambda *a, f=periodic.agreeing: walks.append(a[1]) or f(*a))
    assert runs_of(["x", "y"] * 3000) == [(0, 6000, 2)] and walks == [2, 2]


def test_a_long_text():
    r = random.Random(7)
    period = [str(r.random()) for _ in range(9000)]
    words = ["a", "b"] + period * 3 + period[:10] + ["z"] * 50_000
    assert runs_of(words) == [(2, 27_010, 9000), (27_012, 50_000, 1)]


def test_edges(spark):
    rows = [
        (None, "a " * 30, 1), (1, None, 1), (2, "", 1), (3, " \t\n ", 1), (4, "one", 1), (5, "  b c  d", 1), (5, "  b c  d", 1),
        (6, "\r\nx\x0by " * 12 + "z", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(docs).collect())
    assert got == [
        (0, [(0, 30, 1)], "a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "one"), (5, [], "  b c d"), (5, [], "  b c d"),
        (6, [(0, 24, 2)], "x y z"),
    ]
    assert periodic.collapse(docs.limit(0)).count() == 0


def cycled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_all_lags(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert set(got) == set(texts)
    some = 0
    for i, text in texts.items():
        words = cycled(i, [w.decode() for w in (text or "").encode().split()])
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        some += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest()
    assert some >= 10


def test_query_edges(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3].collapsed_sha256 == got[4].collapsed_sha256 == got[3].runs_sha256 == empty and got[3].n_runs == 0 and got[3].start is None
    assert got[None].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()
