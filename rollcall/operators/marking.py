"""Batch writes to sessions and marks.

A mark request is one row: `seq` (order of the batch), `batch_id`, `ord` (order inside the
batch), `session_date` (text), `member_id`, `status`, `marked_by`, `received_at`. A batch
is for one date, and one bad record rejects all of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import blank, calendar_date, day_name, first_reason, on_weekday, rotation_topic
from rollcall.functions.values import ABSENT, PRESENT
from rollcall.model import Calendar, Model, Rules
from rollcall.operators.outcome import Outcome
from rollcall.plans.keyed import flag_unknown, keep_last, upsert
from rollcall.plans.refresh import activity_refresh, moment, promote, with_topics
from rollcall.plans.standing import marks_changed, settle_touched
from rollcall.sources.lineage import cut_lineage

OFF_DAY = "sessions are only on the session weekday"


def session_date_reason(text: Column, calendar: Calendar, today: str | None) -> Column:
    """Why a date cannot be a session, null when it can. `today=None` allows future dates."""
    date = calendar_date(text)
    checks = [
        (blank(text), "session_date is required"),
        (date.isNull(), "session_date must be a valid date"),
        (~on_weekday(date, calendar), OFF_DAY),
    ]
    if today is not None:
        checks.append((date > F.lit(today).cast("date"), "the date is still to come"))
    return first_reason(*checks)


def topic_rotation(dates: DataFrame, topics: DataFrame, calendar: Calendar = Calendar()) -> DataFrame:
    """Add `topic_name` and `topic_id` for `session_date`; null off the weekday."""
    named = dates.withColumn("topic_name", rotation_topic(F.col("session_date"), calendar))
    return named.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_name", "left")


def _merge_sessions(
    model: Model, slot: str, wanted: DataFrame, as_of: str, calendar: Calendar, with_topics: bool
) -> DataFrame:
    """Upsert one row per date of `wanted` (session_date, ord, created_by) into `slot`."""
    stored = getattr(model, slot)
    rows = wanted.groupBy("session_date").agg(F.min_by("created_by", "ord").alias("created_by"))
    update = ["day_of_week"]
    if with_topics:
        rows = topic_rotation(rows, model.topics, calendar)
        update.append("topic_id")
    rows = rows.withColumns(
        {
            "session_id": F.col("session_date").cast("string"),
            "day_of_week": day_name(F.col("session_date")),
            "created_at": moment(as_of),
        }
    )
    return upsert(stored, rows.select(*stored.columns), ["session_date"], update)


def _upsert_sessions(
    model: Model, slot: str, requests: DataFrame, as_of: str, calendar: Calendar, today: str | None, with_topics: bool
) -> Outcome:
    checked = requests.withColumn("reason", session_date_reason(F.col("session_date"), calendar, today))
    accepted = checked.where(F.col("reason").isNull()).withColumn("session_date", calendar_date(F.col("session_date")))
    merged = _merge_sessions(model, slot, accepted, as_of, calendar, with_topics)
    rejected = checked.where(F.col("reason").isNotNull())
    return Outcome(model.with_tables(**{slot: merged}), rejected)


def upsert_sessions(
    model: Model, requests: DataFrame, as_of: str, today: str, calendar: Calendar = Calendar()
) -> Outcome:
    """`requests`: ord, session_date (text), created_by. Id and creator of a stored date stay."""
    model = with_topics(model, as_of)
    return _upsert_sessions(model, "sessions", requests, as_of, calendar, today, True)


def stage2_upsert_sessions(
    model: Model, requests: DataFrame, as_of: str, calendar: Calendar = Calendar()
) -> Outcome:
    """As `upsert_sessions` without topics, and future dates are allowed."""
    return _upsert_sessions(model, "stage2_sessions", requests, as_of, calendar, None, False)


def _record_reason(extra: list[tuple[Column, str]]) -> Column:
    return first_reason(
        (F.col("member_id").isNull() | blank(F.col("status")), "a record lacks its member or its status"),
        (~F.col("status").isin(PRESENT, ABSENT), "a status is neither present nor absent"),
        *extra,
    )


def _verdicts(records: DataFrame, calendar: Calendar, today: str | None) -> DataFrame:
    """batch_id, reason for every bad batch: its date first, else its earliest bad record.

    Bad records are combined to one row per batch by a partial aggregate, so a batch
    that holds much of the feed is not gathered in one place.
    """
    date_reason = session_date_reason(F.col("session_date"), calendar, today)
    bad = records.withColumn("date_reason", date_reason).where(
        F.col("date_reason").isNotNull() | F.col("record_reason").isNotNull()
    )
    return (
        bad.groupBy("batch_id")
        .agg(
            F.max("date_reason").alias("date_reason"),
            F.min_by("record_reason", F.when(F.col("record_reason").isNotNull(), F.col("ord"))).alias("record_reason"),
        )
        .select("batch_id", F.coalesce("date_reason", "record_reason").alias("reason"))
    )


def accept_marks(
    records: DataFrame, members: DataFrame, calendar: Calendar, today: str | None
) -> tuple[DataFrame, DataFrame]:
    """Records of sound batches, and the rejected batches with their reason."""
    flagged = flag_unknown(records, members, "member_id")
    flagged = flagged.withColumn("record_reason", _record_reason([(F.col("unknown"), "unknown member_id")]))
    verdicts = cut_lineage(_verdicts(flagged, calendar, today))
    return _sound(records, verdicts), verdicts


def accept_stage2_marks(records: DataFrame, roster: DataFrame, calendar: Calendar) -> tuple[DataFrame, DataFrame]:
    """As `accept_marks`, but a batch must name roster members only, each of them once.

    The feed is judged once: per batch and member, then per batch. The order of the checks is date, roster, records.
    """
    flagged = flag_unknown(records, roster, "member_id").withColumns(
        {"record_reason": _record_reason([]), "date_reason": session_date_reason(F.col("session_date"), calendar, None)}
    )
    bad_ord = F.when(F.col("record_reason").isNotNull(), F.col("ord"))
    per_member = flagged.groupBy("batch_id", "member_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("unknown").alias("unknown"),
        F.max("date_reason").alias("date_reason"),
        F.min(F.when(bad_ord.isNotNull(), F.struct(bad_ord.alias("ord"), "record_reason"))).alias("bad"),
    )
    outside = F.when((F.max("n") > 1) | F.bool_or("unknown"), F.lit("only stage-2 members can be marked"))
    verdicts = per_member.groupBy("batch_id").agg(
        F.coalesce(F.max("date_reason"), outside, F.min("bad")["record_reason"]).alias("reason")
    )
    verdicts = cut_lineage(verdicts.where("reason is not null"))
    return _sound(records, verdicts), verdicts


def _sound(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    sound = records.join(verdicts.select("batch_id"), "batch_id", "left_anti")
    return sound.withColumn("session_date", calendar_date(F.col("session_date")))


def latest_records(accepted: DataFrame) -> DataFrame:
    """The last accepted record per date and member."""
    slim = accepted.select("session_date", "member_id", "seq", "ord", "status", "marked_by", "received_at")
    return keep_last(slim, ["session_date", "member_id"], ["seq", "ord"])


@dataclass(frozen=True)
class Merge:
    """Marks of the touched sessions before and after a batch, and the others."""

    touched: DataFrame
    before: DataFrame
    after: DataFrame
    others: DataFrame

    @property
    def marks(self) -> DataFrame:
        return self.others.unionByName(self.after)


def merge_marks(stored: DataFrame, latest: DataFrame, sessions: DataFrame) -> Merge:
    """Upsert one record per date and member into the marks; a stored mark keeps its id.

    Stored marks of the batch's sessions and the records meet in one aggregate by mark; those of other sessions pass by. A store that
    keeps marks by session reads only the batch's sessions for the merge and leaves the others where they are; as one table, `marks`
    reads the stored ones once for either part.
    """
    rows = cut_lineage(
        latest.join(sessions.select("session_id", "session_date"), "session_date")
        .withColumnRenamed("received_at", "marked_at")
        .withColumn("mark_id", F.concat_ws("|", "session_id", F.col("member_id").cast("string")))
        .select(*stored.columns)
    )
    touched = rows.select("session_id").distinct()
    before = stored.join(touched, "session_id", "left_semi")
    keys, value = ["session_id", "member_id"], ["status", "marked_by", "marked_at"]
    both = before.withColumn("new_", F.lit(0)).unionByName(rows.withColumn("new_", F.lit(1)))
    merged = both.groupBy(*keys).agg(
        F.min_by("mark_id", "new_").alias("mark_id"), F.max_by(F.struct(*value), "new_").alias("row_")
    )
    after = merged.select(*keys, "mark_id", "row_.*").select(*stored.columns)
    return Merge(touched, before, after, stored.join(touched, "session_id", "left_anti").select(*stored.columns))


def settle_marks(model: Model, touched: DataFrame, as_of: str, rules: Rules = Rules()) -> Model:
    """Activity of the touched members, then promotion and roster."""
    refreshed = model.with_tables(members=activity_refresh(model, touched, rules))
    return promote(refreshed, as_of, rules)


def upsert_marks(
    model: Model, records: DataFrame, as_of: str, today: str, calendar: Calendar = Calendar(), rules: Rules = Rules()
) -> Outcome:
    """Take mark batches in; `rejected` has one row per batch that was turned away.

    The accepted records are computed once, since sessions, marks and members all read them. Where the model keeps a standing, it is
    changed by what the batch changes, and only the members it touches are looked at.
    """
    accepted, rejected = accept_marks(records, model.members, calendar, today)
    accepted = cut_lineage(accepted)
    stored, model = model, with_topics(model, as_of)
    sessions = cut_lineage(_merge_sessions(model, "sessions", _wanted_sessions(accepted), as_of, calendar, True))
    latest = latest_records(accepted)
    merge = merge_marks(model.marks, latest, sessions)
    marked = accepted.select("member_id")
    if model.standing is None or rules.recent_n > model.standing.recent_n:
        return Outcome(
            model.with_tables(sessions=sessions, marks=merge.marks), rejected, lambda after: settle_marks(after, marked, as_of, rules),
            {"marks": merge.touched}, {"marks": merge.after},
        )
    merge = replace(merge, after=cut_lineage(merge.after))
    standing, moved, buckets = marks_changed(
        model.standing, (merge.before, stored.sessions), (merge.after, sessions), latest.select("member_id", "session_date", "status")
    )
    return Outcome(
        model.with_tables(sessions=sessions, marks=merge.marks, standing=standing), rejected,
        touched={"marks": merge.touched, **{f"standing_{name}": keys for name, keys in buckets.items()}}, rows={"marks": merge.after},
        settle_rows=lambda after: settle_touched(after, moved.unionByName(marked), marked, as_of, rules),
    )


def _wanted_sessions(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        "session_date", F.struct("seq", "ord").alias("ord"), F.col("marked_by").alias("created_by")
    )


def stage2_upsert_marks(model: Model, records: DataFrame, as_of: str, calendar: Calendar = Calendar()) -> Outcome:
    accepted, rejected = accept_stage2_marks(records, model.stage2_roster, calendar)
    accepted = cut_lineage(accepted)
    sessions = cut_lineage(_merge_sessions(model, "stage2_sessions", _wanted_sessions(accepted), as_of, calendar, False))
    merge = merge_marks(model.stage2_marks, latest_records(accepted), sessions)
    changed = model.with_tables(stage2_sessions=sessions, stage2_marks=merge.marks)
    return Outcome(changed, rejected, touched={"stage2_marks": merge.touched}, rows={"stage2_marks": merge.after})
