"""Quality rules: measures against a plain version, divergences, guards, edges."""

import random
import re
from math import log2, sqrt

import pytest
from pyspark.sql import functions as F

from rollcall.llm import quality, queries
from tests.conftest import SF


def plain(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    passages = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = {j for i, p in enumerate(passages) if passages.count(p) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


def test_measures(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)]
    texts += [None, "", " \n\t ", "a a a a", "x y z x y z q", "a\nb\na\n \na\r\n\n", "#*$%&|<> é ü \U0001f600 ##", "one", "a\x0bb\x0cc\rd"]
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {x.doc_id: tuple(x[c] for c in quality.MEASURES) for x in quality.judge(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def divergence(p, q):
    part = lambda a, b: a * log2(2 * a / (a + b)) if a else 0.0
    return sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2


def sentences(r, words, n):
    return " ".join("of the " + r.choice(words) + (" and " if i % 2 else ". ") for i in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    rows = [(i, sentences(r, ["house", "garden", "river", "stone"], r.randrange(60, 120)), "en") for i in range(80)]
    rows += [(100 + i, sentences(r, ["maison", "jardin"], 80).replace("of the", "de la"), "fr") for i in range(40)]
    rows += [(900, " | ".join(f"item{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), "en")]
    rows += [(901, rows[3][1].upper().replace(" ", "!! "), "en"), (902, rows[4][1].replace(" ", "### "), "en"), (903, rows[5][1], None), (904, rows[85][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


LIMITS = quality.Limits(repeated=101, common=8, least_reference=100)


def test_what_is_kept(spark, corpus):
    got = {r.doc_id: r.kept for r in quality.judge(corpus, LIMITS).collect()}
    assert {i for i, kept in got.items() if not kept} == {900, 901, 902, 904}


def test_divergences(spark, corpus):
    rows = quality.features(corpus)
    shares, words = quality.references(corpus, LIMITS)
    ref = {r.ref: r for r in shares.collect()}
    common = {(r.ref, r.word): r.q for r in words.collect()}
    assert 4 <= len([k for k in common if k[0] == "en"]) <= 8 and abs(sum(ref["en"][f"q_{c}"] for c in quality.BINS) - 1) < 1e-9
    for r in quality.compared(rows, shares, words, LIMITS).join(rows.select("doc_id", "counts_"), "doc_id").where("doc_id in (3, 110, 900, 903)").collect():
        chars = [r[c] for c in quality.BINS]
        assert abs(r.class_js - divergence([x / sum(chars) for x in chars], [ref[r.ref][f"q_{c}"] for c in quality.BINS])) < 1e-9
        mine = {x.word: x.n / r.letters_ for x in r.counts_}
        listed = [w for lang, w in common if lang == r.ref]
        p, q = [mine.get(w, 0.0) for w in listed], [common[r.ref, w] for w in listed]
        want = divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        assert abs(r.word_js - want) < 1e-9 and 0 <= sqrt(want) <= 1


def test_the_reference_does_not_follow_a_minority(spark, corpus):
    share = lambda docs: quality.references(docs, LIMITS)[0].where("ref = 'en'").first().q_sign
    odd = corpus.where("doc_id < 30").select(F.col("doc_id") + 2000, F.translate("text", "aeiou", "#####").alias("text"), "lang")
    assert share(corpus.union(odd)) == share(corpus) < 0.01


def test_guards(spark, corpus):
    few = spark.createDataFrame([(1000, "### " * 30, "en"), (1001, "### " * 60, "xx"), (1002, "a " * 49, "en"), (1003, None, None)], corpus.schema)
    got = {r.doc_id: r for r in quality.judge(corpus.union(few), quality.Limits(words=0, repeated=101, common=8, least_reference=100)).collect()}
    # too few characters, a language of too few words, too few words, nothing
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [True] * 4
    assert got[902].kept is False


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "", "en", 1), (1, "", "en", 1), (2, "word " * 100_000, "en", 1), (3, "a", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert got == [(0, 0, 0, True, False), (1, 0, 0, True, False), (1, 0, 0, True, False), (2, 100_000, 100_000, True, False), (3, 1, 0, True, False)]
    assert quality.judge(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    text = queries.op12_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_all_words_are_counted_by_compiled_code(spark, corpus):
    """No lambda, which Spark interprets, goes over the words of the texts for the references; the counts are the plain ones."""
    counts = quality.tallies(corpus, LIMITS)
    assert "lambda" not in counts._jdf.queryExecution().executedPlan().toString()
    texts = [r.text for r in corpus.where("lang = 'fr'").collect()]
    words = [w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())]
    assert counts.where("ref = 'fr' and kind = 0").agg(F.sum("n")).first()[0] == len(words)
    spaces = {}
    for t in texts:
        share = 1000 * len(re.findall(r"[ \t-\r]", t)) // len(t)
        spaces[share] = spaces.get(share, 0) + 1
    assert {r.key: r.n for r in counts.where(F.col("ref") == "fr").where(F.col("kind") == quality.BINS.index("space") + 1).collect()} == spaces
