"""Member lists, lookups and the per-member detail views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import values
from rollcall.functions.values import ABSENT, PRESENT
from rollcall.model import MEMBER_COLUMNS, Model, Rules
from rollcall.plans.refresh import State


def by_folded_name(df: DataFrame, collation: str | None = None) -> DataFrame:
    """Sort by name without case, then by name, then by id.

    Names compare by bytes; give a collation such as `UNICODE` for language order.
    """
    name = F.col("full_name")
    if collation is not None:
        name = F.collate(name, collation)
    return df.orderBy(F.lower(name), name, "member_id")


def by_name(df: DataFrame) -> DataFrame:
    return df.orderBy("full_name", "member_id")


def list_members(
    state: State,
    active: bool | None = None,
    include_promoted: bool = False,
    eligible_for_outing: bool = False,
    rules: Rules = Rules(),
    collation: str | None = None,
) -> DataFrame:
    """Members, optionally by activity, with level 1 only unless promoted ones are asked for."""
    rows = state.profile
    if active is not None:
        rows = rows.where(F.col("active") == active)
    if not include_promoted:
        rows = rows.where(F.col("level") == 1)
    if eligible_for_outing:
        rows = rows.where(F.col("n_topics") >= rules.min_topics)
    return by_folded_name(rows.select(*MEMBER_COLUMNS), collation)


def member_by_id(members: DataFrame, member_id) -> DataFrame:
    """Zero or one row; the filter reaches the scan."""
    return members.where(F.col("member_id") == member_id).select(*MEMBER_COLUMNS)


def members_by_ids(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Members whose id occurs in `ids`."""
    return members.join(ids.select("member_id"), "member_id", "left_semi").select(*MEMBER_COLUMNS)


def _held_topics(model: Model) -> Column:
    """All topics in order with the last date a session on them was held, as one array value."""
    held = model.sessions.groupBy("topic_id").agg(F.max("session_date").alias("held_on"))
    topics = model.topics.join(held, "topic_id", "left")
    entry = F.struct("order_index", "topic_id", "name", "held_on")
    return topics.agg(F.array_sort(F.collect_list(entry))).scalar()


def _present_dates(model: Model) -> DataFrame:
    """member_id, present: the sorted dates a member was present at, by topic. Combined by member and topic first."""
    by_topic = (
        model.marks.where(F.col("status") == PRESENT)
        .select("member_id", "session_id")
        .join(model.sessions.select("session_id", "session_date", "topic_id"), "session_id")
        .where(F.col("topic_id").isNotNull())
        .groupBy("member_id", "topic_id")
        .agg(F.sort_array(F.collect_list("session_date")).alias("dates"))
    )
    entries = F.collect_list(F.struct("topic_id", "dates"))
    return by_topic.groupBy("member_id").agg(F.map_from_entries(entries).alias("present"))


def _topic_progress(topic: Column, dates: Column) -> list[Column]:
    return [
        topic["topic_id"].alias("topic_id"),
        topic["name"].alias("name"),
        topic["order_index"].alias("order_index"),
        F.when(F.size(dates) > 0, F.lit(PRESENT)).otherwise(F.lit(ABSENT)).alias("status"),
        # the last date the topic was held at all, attended or not
        topic["held_on"].cast("string").alias("attended_on"),
        dates.cast("array<string>").alias("attended_dates"),
        F.array_max(dates).cast("string").alias("last_attended_on"),
    ]


def _progress_arrays(model: Model) -> DataFrame:
    """member_id, sessions: every topic with the member's dates, looked up by topic, as one array per member."""

    def progress(topic: Column) -> Column:
        dates = F.coalesce(F.try_element_at("present", topic["topic_id"]), F.array().cast("array<date>"))
        return F.struct(*_topic_progress(topic, dates))

    rows = model.members.select("member_id").join(_present_dates(model), "member_id", "left")
    return rows.withColumn("held_", _held_topics(model)).select("member_id", F.transform("held_", progress).alias("sessions"))


def member_topic_progress(model: Model) -> DataFrame:
    """Every topic for every member, with the sorted dates attended.

    `attended_on` is the last date the topic was held, whether or not the member came;
    `last_attended_on` is the last date the member came.
    """
    return _progress_arrays(model).select("member_id", F.inline("sessions"))


def _history(bridge: DataFrame, events: DataFrame, key: str, date: str) -> DataFrame:
    return bridge.join(events.select(key, date, "details"), key).select(
        "member_id", F.col(date), "details", F.col("added_at").alias("recorded_at")
    )


def member_outing_history(model: Model) -> DataFrame:
    rows = _history(model.outing_members, model.outings, "outing_id", "outing_date")
    rows = rows.orderBy("member_id", F.desc("outing_date"), F.desc("recorded_at"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ["outing_date", "recorded_at"]})


def member_service_history(model: Model) -> DataFrame:
    rows = _history(model.service_members, model.services, "service_id", "service_date")
    rows = rows.orderBy("member_id", F.desc("service_date"), F.desc("recorded_at"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ["service_date", "recorded_at"]})


def member_progress_counts(state: State) -> DataFrame:
    """member_id, attended_topics, outing_count, service_count, total_topics."""
    return state.profile.select(
        "member_id",
        F.col("n_topics").alias("attended_topics"),
        F.col("n_outings").alias("outing_count"),
        F.col("n_services").alias("service_count"),
        "total_topics",
    )


def promotion_status(state: State) -> DataFrame:
    """What each member still needs, as a list of messages and a one-line summary."""
    needed = F.greatest(F.col("total_topics") - F.col("n_topics"), F.lit(0).cast("bigint"))
    plural = F.when(needed == 1, F.lit("")).otherwise(F.lit(values.NEEDS_TOPICS_PLURAL))
    missing = F.array_compact(
        F.array(
            F.when(needed > 0, F.concat(F.lit(values.NEEDS_TOPICS), needed.cast("string"), F.lit(values.NEEDS_TOPICS_UNIT), plural)),
            F.when(F.col("n_outings") == 0, F.lit(values.NEEDS_OUTING)),
            F.when(F.col("n_services") == 0, F.lit(values.NEEDS_SERVICE)),
        )
    )
    promoted = F.col("level") >= 2
    return state.profile.select(
        "member_id",
        promoted.alias("promoted"),
        F.col("n_topics").alias("attended_topics"),
        "total_topics",
        F.col("n_outings").alias("outing_count"),
        F.col("n_services").alias("service_count"),
        missing.alias("missing"),
        F.when(promoted, F.lit(values.PROMOTED))
        .when(F.size(missing) > 0, F.array_join(missing, ", "))
        .otherwise(F.lit(values.ELIGIBLE))
        .alias("summary"),
    )


def _history_array(rows: DataFrame, date: str, name: str) -> DataFrame:
    """One array per member, newest first; a member has at most one row per event date."""
    entry = F.struct(
        F.col(date).cast("string").alias(date), F.col("recorded_at").cast("string").alias("recorded_at"), "details"
    )
    newest_first = F.sort_array(F.collect_list(entry), asc=False)
    return rows.groupBy("member_id").agg(newest_first.alias(name))


def member_details(state: State) -> DataFrame:
    """One row per member: the member, topic progress, both histories, promotion status."""
    model = state.model
    outings = _history(model.outing_members, model.outings, "outing_id", "outing_date")
    services = _history(model.service_members, model.services, "service_id", "service_date")
    status = promotion_status(state)
    status = status.select(
        "member_id", F.struct(*[c for c in status.columns if c != "member_id"]).alias("promotion_status")
    )

    def empty(date: str) -> Column:
        return F.array().cast(f"array<struct<{date}:string,recorded_at:string,details:string>>")

    return (
        model.members.select("member_id", F.struct(*MEMBER_COLUMNS).alias("member"))
        .join(_progress_arrays(model), "member_id", "left")
        .join(_history_array(outings, "outing_date", "outings"), "member_id", "left")
        .join(_history_array(services, "service_date", "services"), "member_id", "left")
        .join(status, "member_id", "left")
        .withColumn("outings", F.coalesce("outings", empty("outing_date")))
        .withColumn("services", F.coalesce("services", empty("service_date")))
    )
