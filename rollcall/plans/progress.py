"""What each member has done: one aggregated row per member and fact table.

Every fact table is aggregated to one row per member before anything is joined to it, so
a member with very many rows is combined inside the map tasks and no join can be skewed.
The parts are joined by `left` on a grouping key; Catalyst drops the parts whose columns
a report does not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollcall.functions.values import ABSENT, PRESENT
from rollcall.model import Model, Rules


def topic_list(model: Model) -> Column:
    """All topics in order as one array value, for reports that show every topic for every member."""
    entry = F.struct("order_index", "topic_id", "name")
    return model.topics.agg(F.array_sort(F.collect_list(entry))).scalar()


def topic_total(model: Model) -> Column:
    return model.topics.agg(F.count(F.lit(1))).scalar()


#: Topics of one word of a bitmap.
WORD = 64


def with_bits(model: Model, rows: DataFrame) -> DataFrame:
    """`rows` with the bit of their `topic_id` in a bitmap over all topics in order (word, mask), null where it is no topic.

    The place comes from the list of all topics as one value, so that there is no join to plan.
    """
    entry = F.struct("order_index", "topic_id", "name")
    listed = model.topics.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda topic: topic["topic_id"])).scalar()
    placed = rows.withColumn("place", F.nullif(F.array_position(listed, F.col("topic_id")), F.lit(0).cast("bigint")) - 1)
    word = F.floor(F.col("place") / WORD).cast("int")
    return placed.withColumns({"word": word, "mask": F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")}).drop("place")


def n_words(model: Model) -> int:
    """How many words the bitmap of all topics has: a count of the topics, a small table."""
    return max(1, -(-model.topics.count() // WORD))


def session_topics(model: Model) -> DataFrame:
    """session_id, session_date, and the bit of the session's topic (word, mask), null when it is no topic of the model."""
    return with_bits(model, model.sessions.select("session_id", "session_date", "topic_id")).drop("topic_id")


def bitmap(words: int, held: Column | None = None) -> Column:
    """Aggregate: the bits (word, mask) of the rows where `held`, or of all, as an array of words."""
    mask = F.col("mask") if held is None else F.when(held, F.col("mask"))
    return F.array(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, mask)), F.lit(0).cast("bigint")) for w in range(words)])


def n_bits(bits: Column, words: int) -> Column:
    """The number of bits set in an array of that many words."""
    return sum((F.bit_count(bits[w]) for w in range(1, words)), F.bit_count(bits[0])).cast("bigint")


def has_bit(bits: Column, place: Column) -> Column:
    """Whether the topic at a place is in a bitmap; not so in one that is null."""
    word = F.get(bits, F.floor(place / WORD).cast("int"))
    return F.coalesce(F.getbit(word, place % WORD) == 1, F.lit(False))


def in_range(date: str, start: str | None, end: str | None) -> Column:
    """Both ends are included and optional."""
    within = F.lit(True)
    if start is not None:
        within = within & (F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        within = within & (F.col(date) <= F.lit(end).cast("date"))
    return within


def mark_counts(model: Model, start: str | None = None, end: str | None = None) -> DataFrame:
    """member_id, n_marks, n_present, n_absent: one aggregate over the marks of the sessions in the range."""
    sessions = model.sessions.where(in_range("session_date", start, end)).select("session_id")
    marks = model.marks.select("session_id", "member_id", "status").join(sessions, "session_id")
    return marks.groupBy("member_id").agg(*_counts())


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_marks"),
        F.count_if(F.col("status") == PRESENT).alias("n_present"),
        F.count_if(F.col("status") == ABSENT).alias("n_absent"),
    ]


def mark_facts(model: Model) -> DataFrame:
    """member_id, topic_bits, n_topics, n_marks, n_present, n_absent, last_present_on.

    One aggregate over the marks, combined inside the map tasks: `topic_bits` has a bit for each topic, in words of 64, set by
    `bit_or` where the member was present. No row is kept by member and topic, however many topics there are.
    """
    words, present = n_words(model), F.col("status") == PRESENT
    facts = (
        model.marks.select("session_id", "member_id", "status")
        .join(session_topics(model), "session_id")
        .groupBy("member_id")
        .agg(
            bitmap(words, present).alias("topic_bits"),
            *_counts(),
            F.max(F.when(present, F.col("session_date"))).alias("last_present_on"),
        )
    )
    return facts.withColumn("n_topics", n_bits(F.col("topic_bits"), words))


def newest_first(keys: list[str], *more: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("session_date"), *[F.desc(c) for c in more])


def recent_marks(model: Model, n: int, touched: DataFrame | None = None) -> DataFrame:
    """The `n` newest marks of every member (of the touched ones, when given).

    Spark limits the ranks inside the map tasks, so a member with very many marks sends
    `n` rows per task.
    """
    marks = model.marks.select("member_id", "session_id", "status", "marked_at")
    if touched is not None:
        marks = marks.join(touched.select("member_id").distinct(), "member_id", "left_semi")
    return (
        marks.join(model.sessions.select("session_id", "session_date"), "session_id")
        .withColumn("recency", F.row_number().over(newest_first(["member_id"], "marked_at")))
        .where(F.col("recency") <= n)
    )


def lapsed_members(model: Model, rules: Rules, touched: DataFrame | None = None) -> DataFrame:
    """member_id, lapsed: true when the newest `recent_n` marks exist and are all absent."""
    return (
        recent_marks(model, rules.recent_n, touched)
        .groupBy("member_id")
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(F.col("status") == ABSENT).alias("missed"),
        )
        .select(
            "member_id",
            ((F.col("checked") == rules.recent_n) & (F.col("missed") == rules.recent_n)).alias("lapsed"),
        )
    )


def latest_status(model: Model) -> DataFrame:
    """member_id, latest_status: the status of the newest mark."""
    return (
        model.marks.join(model.sessions.select("session_id", "session_date"), "session_id")
        .groupBy("member_id")
        .agg(F.max_by("status", F.struct("session_date", "marked_at")).alias("latest_status"))
    )


def outing_facts(model: Model) -> DataFrame:
    """member_id, n_outings. A bridge row is unique, so rows are counted."""
    return model.outing_members.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_outings"))


def last_outing(model: Model) -> DataFrame:
    """member_id, last_outing_on."""
    dates = model.outings.select("outing_id", "outing_date")
    return (
        model.outing_members.join(dates, "outing_id").groupBy("member_id").agg(F.max("outing_date").alias("last_outing_on"))
    )


def service_facts(model: Model) -> DataFrame:
    """member_id, n_services."""
    return model.service_members.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_services"))


def topic_coverage(model: Model) -> DataFrame:
    """member_id, n_topics for members present in at least one topic."""
    return mark_facts(model).where(F.col("n_topics") > 0).select("member_id", "n_topics")


_COUNTS = ["n_topics", "n_outings", "n_services"]


def profile(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Member columns plus topic_bits, attended, n_topics, last_present_on, lapsed, n_outings, n_services
    and total_topics, one row per member."""
    marks = mark_facts(model).select("member_id", "topic_bits", "n_topics", "last_present_on")
    joined = (
        model.members.join(marks, "member_id", "left")
        .join(lapsed_members(model, rules), "member_id", "left")
        .join(outing_facts(model), "member_id", "left")
        .join(service_facts(model), "member_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    rows = joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), zero) for c in _COUNTS},
            "lapsed": F.coalesce("lapsed", F.lit(False)),
            "total_topics": topic_total(model),
            "topics_": topic_list(model),
        }
    )
    held = F.filter("topics_", lambda topic, place: has_bit(F.col("topic_bits"), place))
    return rows.withColumn("attended", F.transform(held, lambda topic: topic["topic_id"])).drop("topics_")


def is_complete() -> Column:
    """On a profile row: present in every topic, with an outing and a service."""
    return (
        (F.col("n_topics") > 0)
        & (F.col("n_topics") == F.col("total_topics"))
        & (F.col("n_outings") > 0)
        & (F.col("n_services") > 0)
    )


def topic_entries(model: Model, profile_rows: DataFrame, entry: Callable[[Column, Column], Column]) -> DataFrame:
    """Add `topic_entries`: `entry(topic, attended)` for every topic in order.

    The matrix row is built from the member's bitmap and the topic list, so no member-by-topic product is ever shuffled, and a topic
    costs one look at a bit.
    """
    rows = profile_rows.withColumn("topics_", topic_list(model))
    return rows.withColumn("topic_entries", F.transform("topics_", lambda topic, place: entry(topic, has_bit(F.col("topic_bits"), place))))


def missing_topics(model: Model, profile_rows: DataFrame) -> DataFrame:
    """Add `missing`: the topics in order that the complement of the member's bitmap has."""
    rows = profile_rows.withColumn("topics_", topic_list(model))
    return rows.withColumn("missing", F.filter("topics_", lambda topic, place: ~has_bit(F.col("topic_bits"), place)))
