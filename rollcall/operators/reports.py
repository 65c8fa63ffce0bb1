"""Reports over the refreshed state. Each is one pass over the member profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.model import Rules
from rollcall.operators.members import by_folded_name, by_name
from rollcall.plans import progress
from rollcall.plans.refresh import State


def inactive_report(state: State) -> DataFrame:
    """Level-1 inactive members with the last session they were present at.

    Session dates are unique, so the last present date names the session.
    """
    topic_names = state.model.topics.select("topic_id", F.col("name").alias("topic_name"))
    sessions = state.model.sessions.select(F.col("session_date").alias("last_present_on"), "topic_id")
    rows = (
        state.profile.where(~F.col("active") & (F.col("level") == 1))
        .select("member_id", "full_name", "phone", "last_present_on")
        .join(sessions.join(topic_names, "topic_id", "left"), "last_present_on", "left")
    )
    return by_name(
        rows.select(
            "member_id", "full_name", "phone", "topic_name",
            F.col("last_present_on").cast("string").alias("session_date"),
        )
    )


def eligible_report(state: State, status: str = "eligible", rules: Rules = Rules()) -> DataFrame:
    """Level-1 members with at least `min_topics` topics, or with fewer for `not_eligible`."""
    enough = F.col("n_topics") >= rules.min_topics
    rows = state.profile.where((F.col("level") == 1) & (~enough if status == "not_eligible" else enough))
    return by_name(rows.select("member_id", "full_name", "phone", F.col("n_topics").alias("attended_topics")))


def promoted_report(state: State) -> DataFrame:
    """Members who meet the promotion rule now, whatever level is stored."""
    return (
        state.profile.where(progress.is_complete())
        .select("member_id", "full_name", "phone", "promoted_at")
        .join(progress.last_outing(state.model), "member_id", "left")
        .orderBy(F.desc_nulls_last("promoted_at"), "full_name", "member_id")
        .select(
            "member_id", "full_name", "phone", "promoted_at",
            F.col("last_outing_on").cast("string").alias("outing_date"),
        )
    )


def missing_by_topic(state: State) -> DataFrame:
    """One row per topic and level-1 member who has not attended it.

    A list per topic could hold nearly every member, so the rows stay apart; within a
    topic they are in name order.
    """
    level1 = state.profile.where(F.col("level") == 1).select("member_id", "full_name", "phone", "topic_bits")
    rows = progress.missing_topics(state.model, level1)
    return (
        rows.select("member_id", "full_name", "phone", F.explode("missing").alias("topic"))
        .select("topic.topic_id", "topic.name", "topic.order_index", "member_id", "full_name", "phone")
        .orderBy("order_index", F.lower("full_name"), "full_name", "member_id")
    )


def missing_counts_by_topic(state: State) -> DataFrame:
    """Every topic with the number of level-1 members who have not attended it.

    A topic that all have attended has 0; with no level-1 member there are no rows.
    """
    rows = progress.topic_entries(
        state.model,
        state.profile.where(F.col("level") == 1).select("member_id", "topic_bits"),
        lambda topic, held: F.struct(
            topic["order_index"].alias("order_index"), topic["topic_id"].alias("topic_id"),
            topic["name"].alias("name"), (~held).alias("missing"),
        ),
    )
    return (
        rows.select(F.inline("topic_entries"))
        .groupBy("topic_id", "name", "order_index")
        .agg(F.count_if("missing").alias("missing_count"))
        .orderBy("order_index", "topic_id")
    )


def all_members_report(state: State) -> DataFrame:
    """Every member with the whole topic matrix row and the four status labels."""
    rows = progress.topic_entries(
        state.model,
        state.profile,
        lambda topic, held: F.struct(
            topic["topic_id"].alias("topic_id"),
            topic["name"].alias("name"),
            topic["order_index"].alias("order_index"),
            F.when(held, F.lit("Attended")).otherwise(F.lit("Not Attended")).alias("status"),
        ),
    )

    def label(condition, yes: str, no: str):
        return F.when(condition, F.lit(yes)).otherwise(F.lit(no))

    return by_folded_name(
        rows.where(F.col("total_topics") > 0).select(
            "member_id",
            "full_name",
            "phone",
            F.col("topic_entries").alias("topics"),
            label(F.col("n_outings") > 0, "Attended", "Not Attended").alias("outing"),
            label(F.col("n_services") > 0, "Done", "Not Done").alias("service"),
            label(F.col("active"), "Active", "Inactive").alias("activity_status"),
            label(F.col("level") >= 2, "Promoted", "Not Promoted").alias("promotion_status"),
        )
    )


def yet_to_outing(state: State, rules: Rules = Rules()) -> DataFrame:
    """Level-1 members with enough topics and no outing."""
    rows = state.profile.where(
        (F.col("level") == 1) & (F.col("n_topics") >= rules.min_topics) & (F.col("n_outings") == 0)
    )
    return by_name(rows.select("member_id", "full_name", "phone", F.col("n_topics").alias("attended_topics")))


def yet_to_service(state: State, level: int | None = None) -> DataFrame:
    """Members of any level (or of one, when given) with no service."""
    rows = state.profile.where(F.col("n_services") == 0)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    return by_name(rows.select("member_id", "full_name", "phone"))


def fixture_summary(state: State) -> DataFrame:
    """One row of eight counts over the members.

    "Every topic" here means present at every session the member has a mark for.
    """
    model = state.model
    attendance = progress.mark_counts(model).select(
        "member_id", (F.col("n_present") == F.col("n_marks")).alias("always_present")
    )
    rows = state.profile.join(attendance, "member_id", "left").withColumn(
        "always_present", F.coalesce("always_present", F.lit(True))
    )
    level1 = F.col("level") == 1
    every, outing, service = F.col("always_present"), F.col("n_outings") > 0, F.col("n_services") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col("member_type") == "studying").alias("studying"),
        F.count_if(F.col("member_type") == "working").alias("working"),
        F.count_if(level1 & F.col("active")).alias("active_level1"),
        F.count_if(level1 & ~F.col("active")).alias("inactive_level1"),
        F.count_if(F.col("level") >= 2).alias("promoted"),
        F.count_if(level1 & every & outing & ~service).alias("outing_only"),
        F.count_if(level1 & every & ~outing & service).alias("service_only"),
        F.count_if(level1 & ~every & outing & service).alias("both_missing_topics"),
    )
