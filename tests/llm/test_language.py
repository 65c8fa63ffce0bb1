"""Language identification: held-out accuracy, backoff, edges."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import language_id, queries
from tests.conftest import SF

SF_01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in queries.op1_language_id(spark, SF_01).collect()}
    langs = {r.doc_id: r.lang for r in queries.table(spark, SF_01, "documents").collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert len(found) == len(langs) and len(held) > 150
    assert np.mean([found[i].lang_pred == langs[i] for i in held if langs[i]]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_unseen_words_fall_back_to_grams(spark):
    docs = spark.createDataFrame(
        [(1, "the thing there", "en"), (2, "der dünne schuh", "de"), (3, None, "de"), (4, "no label", None)], "doc_id long, text string, lang string"
    )
    model = language_id.learn(docs, language_id.F.lit(True))
    assert model.langs == ["de", "en"]
    scores, letters = model.scores(["thein", "schün", "the", "", "123 !", "愛"])
    assert scores.argmax(axis=1)[:3].tolist() == [1, 0, 1] and letters.tolist() == [True, True, True, False, False, True]


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "", "en", 1), (2, "12 34", "en", 1), (3, "the " * 400_000, "en", 1), (4, "der und", "de", 1), (4, "der und", "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = language_id.learn(docs, language_id.F.lit(True))
    got = language_id.identify(docs.drop("lang_pred"), model, "doc_id").collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id is not None) == [(1, "und"), (2, "und"), (3, "en"), (4, "de"), (4, "de")]
    assert [(r.lang_pred, r.score) for r in got if r.doc_id is None] == [("und", 0.0)]
    kept = language_id.recognised(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 4]
    empty = docs.limit(0)
    nothing = language_id.learn(empty, language_id.F.lit(True))
    assert language_id.identify(empty, nothing, "doc_id").count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, nothing, "doc_id").collect()} == {"und"}
    assert language_id.recognised(docs, nothing).count() == 3


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, model, "doc_id").collect()} == {"a"}


def test_only_text_counts(spark):
    docs = queries.table(spark, SF, "documents")
    model = language_id.learn(docs, language_id.F.lit(True))
    plain = sorted(map(tuple, language_id.identify(docs, model, "doc_id").collect()))
    other = docs.withColumn("lang", language_id.F.lit("zz")).withColumn("source", language_id.F.lit(None).cast("string"))
    assert sorted(map(tuple, language_id.identify(other, model, "doc_id").collect())) == plain


def plain_scores(learned, text, words=200_000, grams=200_000):
    """The posterior by dictionaries: words by log frequency, unseen ones by their longest known n-grams."""
    word = re.compile(r"[^\W\d_]+")
    langs = sorted({lang for lang, _ in learned})
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for lang, t in learned:
        for w in word.findall(t.lower()):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams_of(w, n))
    known = [set().union(*(c[lang] for lang in langs)) for c in counts]
    total = [{lang: sum(c[lang].values()) + 0.5 * (len(k) + 1) for lang in langs} for c, k in zip(counts, known, strict=True)]
    log_of = lambda n, lang, x: math.log((counts[n][lang][x] + 0.5) / total[n][lang])
    sums = {lang: math.log(sum(x == lang for x, _ in learned) / len(learned)) for lang in langs}
    for w in word.findall(text.lower()):
        level = 0 if w in known[0] else next((n for n in range(5, 0, -1) if any(g in known[n] for g in grams_of(w, n))), None)
        if level is not None:
            met = [w] if level == 0 else [g for g in grams_of(w, level) if g in known[level]]
            for lang in langs:
                sums[lang] += sum(log_of(level, lang, x) for x in met) / len(met)
    weights = {lang: math.exp(x - max(sums.values())) for lang, x in sums.items()}
    return [weights[lang] / sum(weights.values()) for lang in langs]


def grams_of(word, n):
    """Edges count as a character, alone they are no gram."""
    edged = f"^{word}^"
    return list(word) if n == 1 else [edged[i : i + n] for i in range(len(edged) - n + 1)]


def test_scores_against_dictionaries(spark):
    learned = [("en", "the thing there thinks the same thing"), ("de", "der dünne schuh und der schuh"), ("en", "a shoe"), ("fr", "une chose étrange")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(learned)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True))
    texts = ["the shoe", "thinge dünner", "Chose un schuhe", "zzz", "", "étrangers und the", "x"]
    got, _ = model.scores(texts)
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(plain_scores(learned, text))


def test_marks_alone_are_no_letter(spark):
    docs = spark.createDataFrame([(1, "\u0301", "de"), (2, "e\u0301", "de"), (3, "\u0301\u0302 12", "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in language_id.identify(docs, model, "doc_id").collect()}
    assert got == {1: ("und", False), 2: ("de", True), 3: ("und", False)}


def test_small_languages_keep_their_words(spark):
    """Entries are taken by language, so many words of a large one don't push out those of a small one."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + (i * j) % 26)}" for j in range(50)) * 3, "aa") for i in range(60)]
    docs = spark.createDataFrame([*rows, (900, "petit mot rare", "bb")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True), words=40, most_grams=40)
    known, _ = model.look_up(0, language_id.words_of("petit mot rare")[3])
    assert known.all() and len(model.hashes[0]) <= 40


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word', cast(id as string), ' number ', cast(id as string)) as text", "'en' as lang")
    model = language_id.learn(docs, language_id.F.lit(True), sample=1000)
    mean = np.exp(model.logs[0]).max()
    assert len(model.hashes[0]) >= 2 and 0 < mean < 1
    some = docs.where("text = 'word7 number 7'")
    assert language_id.identify(some, model).first().lang_pred == "en"


def test_what_the_model_cannot_tell_goes(spark):
    learned = [(1, "the house and the garden of the man were there again", "en"), (2, "das haus und der garten des mannes waren wieder da", "de")]
    docs = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True))
    other = spark.createDataFrame(
        [(1, "the gardens of the houses", "en"), (2, "xqzjv wkqpt vvkxz qqjjz", "en"), (3, "漢字 仮名 交じり文", "de"), (4, "ΑΒΓ ΔΕΖ", None), (5, "den häusern", None)], docs.schema
    )
    assert sorted(r.doc_id for r in language_id.recognised(other, model).collect()) == [1, 5]
