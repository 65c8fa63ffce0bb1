"""Quality rules by distribution divergence, in built-in functions only.

Two histograms of a document are compared with references of its language, made from the whole table: of character classes (`CLASSES`,
spaces, and other letters as the rest), and of the language's `common` most frequent words (fewer where ties would decide), with all others as one more bin. A word here
is a run of letters in lower case. The reference of the classes is the median of the documents' shares (in steps of a thousandth,
brought to a sum of 1), so that a minority of odd texts does not move it; that of the words are shares of all the language's words. The comparison is the Jensen-Shannon distance: the square root of the divergence in bits, from 0
to 1. A document whose language isn't given is compared with every language, and the one it fits best counts.

A short text strays from its language by chance. A sample of n from a histogram of b bins has an expected divergence of about
(b - 1) / (8 n ln 2), which is added to the square of each limit. Besides, nothing is judged by its words below `least_words` of them,
nor by its classes below `least_chars` characters, nor against a language known from fewer than `least_reference` words.

Some plain measures come along (`measures`): words, their characters, symbols, repeated lines, words in repeated passages of three words.
Too few words or too many repeated ones fail a document whatever its histograms are.

Null and empty texts have no words and fail. Each row is judged by itself, repeated ones and those with a null id as well; an empty
table gives an empty result. Only id, text and language are read, so other columns and their names don't matter. Words and passages are
told apart by 64-bit hashes.

Texts are read twice, for the references and for the comparison, as the counts of all words of all documents would take about as much
disk as the texts. All arrays belong to one row; only words with their counts are combined over rows, inside the map tasks first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.sources.lineage import cut_lineage

#: Character classes as patterns. Spaces are what is in no word, signs are marks that are no stops.
CLASSES = {"capital": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:!?'\"()-]", "mark": r"[\p{P}\p{S}]"}
BINS = ["capital", "digit", "stop", "sign", "space", "letter"]
WORD = r"[^ \t-\r]+"
#: What is in no word.
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Limits:
    """What a document may show. Shares are in hundredths."""

    words: int = 50
    repeated: int = 50
    class_distance: float = 0.18
    word_distance: float = 0.3
    common: int = 32
    least_words: int = 50
    least_chars: int = 200
    least_reference: int = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def passages(words: Column) -> Column:
    """The hash of each three words in a row, of a column with the hashes of words."""
    three = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) > 2, let(words, three)).otherwise(F.array().cast("array<bigint>"))


def n_repeated(passages: Column) -> Column:
    """How many words lie in passages of three words that are found twice or more."""

    def starts(ordered: Column) -> Column:
        """Where repeated passages begin, of those in order of their hash and place."""
        twin = lambda x, j, other: F.coalesce(F.get(ordered, other)["hash"] == x["hash"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: twin(x, j, j - 1) | twin(x, j, j + 1)), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.transform(passages, lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
    # most texts repeat no passage, and a set tells that sooner than a sort
    some = F.size(F.array_distinct(passages)) < F.size(passages)
    return F.when(some, let(F.sort_array(placed), lambda s: let(starts(s), covered))).otherwise(F.lit(0).cast("long"))


def counted(ordered: Column) -> Column:
    """The distinct words as structs of `word` (a hash) and `n`, of a column with the hashes of all words in order."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j - 1) != F.get(s, j)))
        return let(first, lambda b: F.transform(
            b, lambda i, j: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("n"))
        ))

    return F.when(F.size(ordered) > 0, let(ordered, runs)).otherwise(F.array().cast("array<struct<word:bigint,n:int>>"))


def measures(text: Column) -> dict[str, Column]:
    """n_words, n_symbols, n_dup_lines, n_repeat_words of a text that is not null, with its words in the column `words_` and its
    passages in `passages_`."""
    full = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return {
        "n_words": F.size("words_").cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeated(F.col("passages_")),
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _texts(docs: DataFrame, words: bool = True) -> DataFrame:
    """`row_, doc_id, lang, text`, words (not with `words=False`) and words of letters, and the sizes of the classes."""
    text = F.col("text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"spoken_": found(F.lower(text), r"\p{L}+"), "length_": F.length(text).cast("long")})
    rows = rows.withColumns({c: F.regexp_count(text, F.lit(p)).cast("long") for c, p in CLASSES.items()})
    if words:
        rows = rows.withColumn("words_", found(text, WORD))
        rows = rows.withColumn("word_chars", F.aggregate("words_", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
    else:
        # the characters of words are those that are no spaces
        solid = reduce(lambda a, c: F.replace(a, F.lit(c), F.lit("")), SPACES, text)
        rows = rows.withColumn("word_chars", F.length(solid).cast("long"))
    rows = rows.withColumns({"sign": F.col("mark") - F.col("stop"), "space": F.col("length_") - F.col("word_chars")})
    return rows.withColumn("letter", reduce(lambda a, b: a - b, [F.col(c) for c in BINS[:-1]], F.col("length_")))


def features(docs: DataFrame) -> DataFrame:
    """`row_, doc_id, lang`, the measures, the sizes of the classes, `letters_` (how many words of letters) and `counts_`."""
    # by steps: a column that later ones read more than once stays a column, and Spark compiles what is not inside a lambda
    rows = _texts(docs).withColumns({"hashes_": hashes(F.col("words_")), "ordered_": F.sort_array(hashes(F.col("spoken_")))})
    rows = rows.withColumn("passages_", passages(F.col("hashes_")))
    rows = rows.withColumns({**measures(F.col("text")), "counts_": counted(F.col("ordered_"))})
    return rows.select("row_", "doc_id", "lang", *MEASURES, *BINS, F.size("spoken_").alias("letters_"), "counts_")


def tallies(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`ref, kind, key, n`: of each language how often each word occurs (kind 0, by its hash), and for each class (kind 1 up) how many
    documents that are long enough have each share, in thousandths. One aggregate over all documents, combined inside the map tasks."""
    # classes come first, as text, so that words are taken out of their array and hashed by compiled code
    chars, spoken = F.col("length_"), F.xxhash64("value")
    long = (chars >= limits.least_chars) & (chars > 0)
    steps = F.array(*[F.when(long, F.floor(1000 * F.col(c) / chars).cast("string")) for c in BINS])
    rows = _texts(docs, words=False).where(F.col("lang").isNotNull())
    rows = rows.select(F.col("lang").alias("ref"), F.posexplode(F.concat(steps, F.col("spoken_"))).alias("at", "value")).where("value is not null")
    of_class = F.col("at") < len(BINS)
    kind, key = F.when(of_class, F.col("at") + 1).otherwise(F.lit(0)), F.when(of_class, F.col("value").cast("long")).otherwise(spoken)
    return rows.groupBy("ref", kind.alias("kind"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def class_shares(counts: DataFrame) -> DataFrame:
    """`ref, q_<class>`: the median share of each class over the documents of a language."""
    by = Window.partitionBy("ref", "kind")
    held = counts.where("kind > 0").withColumns({"upto_": F.sum("n").over(by.orderBy("key")), "all_": F.sum("n").over(by)})
    medians = held.where(2 * F.col("upto_") >= F.col("all_")).groupBy("ref", "kind").agg((F.min("key") / 1000 + 0.0005).alias("share"))
    wide = medians.groupBy("ref").agg(*[F.max(F.when(F.col("kind") == i, F.col("share"))).alias(f"q_{c}") for i, c in enumerate(BINS, 1)])
    whole = reduce(lambda a, b: a + b, [F.col(f"q_{c}") for c in BINS])
    return wide.select("ref", *[(F.col(f"q_{c}") / whole).alias(f"q_{c}") for c in BINS])


def references(docs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Of each language: `ref, q_<class>`, `total_` (its words), `common_` (share of the common ones); and `ref, word, q` of these."""
    counts = cut_lineage(tallies(docs, limits))
    spoken = counts.where("kind = 0")
    sums = spoken.groupBy("ref").agg(F.sum("n").alias("total_"))
    by = Window.partitionBy("ref").orderBy(F.desc("n"))
    often = spoken.withColumn("rank", F.rank().over(by)).where(F.col("rank") <= limits.common)
    # words as frequent as the first one too many are left out, so that ties don't decide
    often = often.withColumn("upto_", F.count(F.lit(1)).over(by)).where(F.col("upto_") <= limits.common)
    words = cut_lineage(often.join(sums, "ref").select("ref", F.col("key").alias("word"), (F.col("n") / F.col("total_")).alias("q")))
    common = words.groupBy("ref").agg(F.sum("q").alias("common_"))
    shares = sums.join(class_shares(counts), "ref").join(common, "ref", "left").fillna(0.0, ["common_"])
    return cut_lineage(shares), words


def half(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def allowed(distance: float, bins: int, n: Column) -> Column:
    """The divergence up to which `n` draws from `bins` bins are near enough."""
    return F.lit(distance) ** 2 + (bins - 1) / (8 * F.log(F.lit(2.0)) * F.greatest(n, F.lit(1)))


def compared(rows: DataFrame, shares: DataFrame, words: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`rows` by document and language: with `class_js`, `word_js` (divergences in bits) and `fits`."""
    others = F.coalesce(shares.agg(F.array_sort(F.collect_list("ref"))).scalar(), F.array().cast("array<string>"))
    refs = F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(others)
    base = ["row_", "doc_id", *MEASURES, *BINS, "letters_"]
    pairs = rows.select(*base, "counts_", F.explode_outer(refs).alias("ref"))
    bins = pairs.select(*base, "ref", F.inline_outer("counts_")).join(words, ["ref", "word"], "left")
    p, q = F.col("n") / F.col("letters_"), F.col("q")
    sums = bins.groupBy(*base, "ref").agg(
        F.coalesce(F.sum(F.when(q.isNotNull(), half(p, q))), F.lit(0.0)).alias("held_"),
        F.coalesce(F.sum(F.when(q.isNotNull(), p)), F.lit(0.0)).alias("p_"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q_"),
    )
    both = sums.join(shares, "ref", "left")
    # a common word that the document lacks adds half its share
    lacking = F.greatest(F.col("common_") - F.col("q_"), F.lit(0.0)) / 2
    rest = half(F.greatest(1 - F.col("p_"), F.lit(0.0)), F.greatest(1 - F.col("common_"), F.lit(0.0)))
    chars = reduce(lambda a, b: a + b, [F.col(c) for c in BINS])
    class_js = reduce(lambda a, b: a + b, [half(F.col(c) / F.greatest(chars, F.lit(1)), F.col(f"q_{c}")) for c in BINS])
    both = both.withColumns({"class_js": class_js, "word_js": F.col("held_") + lacking + rest})
    unknown = F.col("total_").isNull() | (F.col("total_") < limits.least_reference)
    class_ok = (chars < limits.least_chars) | (F.col("class_js") <= allowed(limits.class_distance, len(BINS), chars))
    word_ok = (F.col("letters_") < limits.least_words) | (F.col("word_js") <= allowed(limits.word_distance, limits.common + 1, F.col("letters_")))
    return both.withColumn("fits", unknown | (class_ok & word_ok))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`doc_id`, the measures, `base_failed` and `kept` of each row of `docs` (`doc_id, text, lang`)."""
    shares, words = references(docs, limits)
    fitting = compared(features(docs), shares, words, limits).groupBy("row_", "doc_id", *MEASURES).agg(F.bool_or("fits").alias("fits"))
    few = F.col("n_words") < limits.words
    base_failed = few | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words"))
    return fitting.select("doc_id", *MEASURES, base_failed.alias("base_failed"), (~base_failed & F.col("fits")).alias("kept"))
