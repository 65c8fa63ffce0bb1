"""Session lists, mark logs, attendance summary and stage-2 views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import percentage
from rollcall.functions.values import ABSENT
from rollcall.model import MEMBER_COLUMNS, Model
from rollcall.operators.members import by_name
from rollcall.plans.progress import in_range, mark_counts


def list_sessions(model: Model, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions of a date range with their topic, newest first; a null topic is kept."""
    topics = model.topics.select("topic_id", F.col("name").alias("topic_name"))
    return (
        model.sessions.where(in_range("session_date", start, end))
        .join(topics, "topic_id", "left")
        .orderBy(F.desc("session_date"))
        .select(
            "session_id", F.col("session_date").cast("string").alias("session_date"),
            "day_of_week", "created_by", "created_at",
            F.when(F.col("topic_name").isNotNull(), F.col("topic_id")).alias("topic_id"), "topic_name",
        )
    )


def stage2_sessions(model: Model, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        model.stage2_sessions.where(in_range("session_date", start, end))
        .orderBy(F.desc("session_date"))
        .select(
            "session_id", F.col("session_date").cast("string").alias("session_date"),
            "day_of_week", "created_by", "created_at",
        )
    )


def _mark_log(
    model: Model, marks: str, sessions: str, session_id, session_date: str | None, ordered: bool
) -> DataFrame:
    log = getattr(model, marks)
    dates = getattr(model, sessions).select("session_id", "session_date", "day_of_week")
    if session_id is not None:
        log = log.where(F.col("session_id") == session_id)
    if session_date is not None:
        dates = dates.where(in_range("session_date", session_date, session_date))
    markers = model.markers.select(F.col("marker_id").alias("marked_by"), F.col("name").alias("marked_by_name"))
    rows = (
        log.join(dates, "session_id")
        .join(markers, "marked_by", "left")
        .join(model.members.select("member_id", "full_name"), "member_id")
    )
    if ordered:
        rows = rows.orderBy(F.desc("session_date"), "full_name", "member_id")
    return rows.select(
        "mark_id", "status", "marked_at", "session_id",
        F.col("session_date").cast("string").alias("session_date"), "day_of_week",
        "member_id", F.col("full_name").alias("member_name"), "marked_by_name",
    )


def list_marks(model: Model, session_id=None, session_date: str | None = None, ordered: bool = True) -> DataFrame:
    """The mark log, newest session first. `ordered=False` leaves out the sort of the whole log."""
    return _mark_log(model, "marks", "sessions", session_id, session_date, ordered)


def stage2_marks(model: Model, session_id=None, session_date: str | None = None, ordered: bool = True) -> DataFrame:
    return _mark_log(model, "stage2_marks", "stage2_sessions", session_id, session_date, ordered)


def attendance_summary(model: Model, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per level-1 member: marks in the range, present, absent, and the present percentage."""
    counts = mark_counts(model, start, end)
    rows = model.members.where(F.col("level") == 1).join(counts, "member_id", "left")

    def known(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0).cast("bigint"))

    return by_name(
        rows.select(
            "member_id",
            "full_name",
            known("n_marks").alias("total_sessions"),
            known("n_present").alias("present_count"),
            known("n_absent").alias("absent_count"),
            percentage(known("n_present"), known("n_marks")).alias("attendance_percentage"),
        )
    )


def stage2_members(model: Model) -> DataFrame:
    """Members on the roster, by name."""
    roster = model.stage2_roster.select("member_id")
    return by_name(model.members.join(roster, "member_id", "left_semi").select(*MEMBER_COLUMNS))


def stage2_member_by_id(model: Model, member_id) -> DataFrame:
    return stage2_members(model).where(F.col("member_id") == member_id)


def stage2_members_by_ids(model: Model, ids: DataFrame) -> DataFrame:
    return stage2_members(model).join(ids.select("member_id"), "member_id", "left_semi")


def _stage2_marked(model: Model) -> DataFrame:
    """Marks of the stage-2 sessions with their dates."""
    dates = model.stage2_sessions.select("session_id", "session_date")
    return model.stage2_marks.select("session_id", "member_id", "status", "marked_at").join(dates, "session_id")


def stage2_member_marks(model: Model) -> DataFrame:
    """The history of all roster members as it is stored: a row for each marked session."""
    roster = model.stage2_roster.select("member_id")
    rows = _stage2_marked(model).join(roster, "member_id", "left_semi")
    return rows.select("member_id", F.col("session_date").cast("string").alias("session_date"), "status", F.col("marked_at").cast("string").alias("marked_at"))


def stage2_member_absences(model: Model) -> DataFrame:
    """member_id, marked, implied_absences: how many sessions of a roster member have a mark, and how many have none and count as
    absent. With `stage2_member_marks` this is the whole history, without a row for each member and session."""
    marked = model.stage2_marks.join(model.stage2_sessions.select("session_id"), "session_id", "left_semi")
    counts = marked.groupBy("member_id").agg(F.count(F.lit(1)).alias("marked"))
    total = model.stage2_sessions.agg(F.count(F.lit(1))).scalar()
    rows = model.stage2_roster.select("member_id").join(counts, "member_id", "left")
    rows = rows.withColumn("marked", F.coalesce("marked", F.lit(0).cast("bigint")))
    return rows.withColumn("implied_absences", total - F.col("marked"))


def stage2_member_history(model: Model, ids: DataFrame) -> DataFrame:
    """Every stage-2 session for the roster members among `ids`; an unmarked one counts as absent.

    The dense list is made for the members asked for only; `stage2_member_marks` and
    `stage2_member_absences` are the form for all of them.
    """
    asked = model.stage2_roster.select("member_id").join(ids.select("member_id").distinct(), "member_id", "left_semi")
    dates = model.stage2_sessions.agg(F.array_sort(F.collect_list("session_date"))).scalar()
    entry = F.struct("session_date", "status", "marked_at")
    marked = _stage2_marked(model).join(asked, "member_id", "left_semi").groupBy("member_id").agg(F.collect_list(entry).alias("marked"))
    empty = F.array().cast("array<struct<session_date:date,status:string,marked_at:timestamp_ntz>>")
    unmarked = F.array_except("dates_", F.transform("marked", lambda m: m["session_date"]))
    filled = F.transform(
        unmarked,
        lambda d: F.struct(
            d.alias("session_date"), F.lit(ABSENT).alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("marked_at"),
        ),
    )
    return (
        asked.join(marked, "member_id", "left")
        .withColumn("dates_", dates)
        .withColumn("marked", F.coalesce("marked", empty))
        .select("member_id", F.inline(F.sort_array(F.concat("marked", filled), asc=False)))
        .withColumns({c: F.col(c).cast("string") for c in ["session_date", "marked_at"]})
    )
