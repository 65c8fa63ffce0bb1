"""The rule pipeline: topics, activity, promotion, stage-2 roster.

`prepare` is the state that the reports read. It is a lazy plan and writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.values import TOPICS
from rollcall.model import MEMBER_COLUMNS, Model, Rules
from rollcall.plans import progress
from rollcall.plans.keyed import insert_missing


@dataclass(frozen=True)
class State:
    """The profile of the members, and the tables it was read from with topics ensured."""

    model: Model
    profile: DataFrame

    def settled(self, as_of: str) -> Model:
        """The model with members as in the profile and the roster brought up to date."""
        members = self.profile.select(*MEMBER_COLUMNS)
        roster = roster_sync(self.model.stage2_roster, members, as_of)
        return self.model.with_tables(members=members, stage2_roster=roster)


def moment(text: str) -> Column:
    """A UTC moment such as `2026-06-01 09:00:00` as a timestamp without zone."""
    return F.lit(text).cast("timestamp_ntz")


def fixed_topics(spark: SparkSession, names: list[str] = TOPICS) -> DataFrame:
    """topic_id, name, order_index of the fixed topics."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("order_index"))
    rows = spark.range(1, len(names) + 1, numPartitions=1).select(F.col("id").cast("int").alias("order_index"))
    rows = rows.withColumn("name", name)
    return rows.select(F.concat(F.lit("topic:"), "name").alias("topic_id"), "name", "order_index")


def ensure_topics(topics: DataFrame, as_of: str, names: list[str] = TOPICS) -> DataFrame:
    """Merge the fixed topics in by name, refreshing `order_index`; other topics stay."""
    fixed = fixed_topics(topics.sparkSession, names).withColumn("created_at", moment(as_of))
    both = topics.withColumn("new_", F.lit(0)).unionByName(fixed.withColumn("new_", F.lit(1)))
    merged = both.groupBy("name").agg(
        F.min_by("topic_id", "new_").alias("topic_id"),
        F.max_by("order_index", "new_").alias("order_index"),
        F.min_by("created_at", "new_").alias("created_at"),
    )
    return merged.select(*topics.columns)


def with_topics(model: Model, as_of: str) -> Model:
    """`ensure_topics` on a model."""
    return model.with_tables(topics=ensure_topics(model.topics, as_of))


def _refreshed_active() -> Column:
    return F.when(F.col("level") == 1, ~F.col("lapsed")).otherwise(F.col("active"))


def _promoted(as_of: str) -> dict[str, Column]:
    newly = progress.is_complete() & (F.col("level") < 2)
    return {
        "level": F.when(newly, F.lit(2)).otherwise(F.col("level")),
        "promoted_at": F.when(newly, F.coalesce("promoted_at", moment(as_of))).otherwise(F.col("promoted_at")),
    }


def observe(model: Model, rules: Rules = Rules()) -> State:
    """The state as stored, without refreshing anything."""
    return State(model, progress.profile(model, rules))


def prepare(model: Model, as_of: str, rules: Rules = Rules()) -> State:
    """Topics, then activity, then promotion and roster."""
    model = with_topics(model, as_of)
    rows = progress.profile(model, rules)
    # both read the level from before the promotion
    return State(model, rows.withColumns({"active": _refreshed_active(), **_promoted(as_of)}))


def refresh(model: Model, as_of: str, rules: Rules = Rules()) -> Model:
    """The whole pipeline as a new model: topics, members, roster."""
    return prepare(model, as_of, rules).settled(as_of)


def promote(model: Model, as_of: str, rules: Rules = Rules()) -> Model:
    """Topics, promotion and roster, without the activity rule."""
    model = with_topics(model, as_of)
    return State(model, progress.profile(model, rules).withColumns(_promoted(as_of))).settled(as_of)


def activity_status(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Members with `active` recomputed for everyone at level 1."""
    rows = model.members.join(progress.lapsed_members(model, rules), "member_id", "left")
    rows = rows.withColumn("lapsed", F.coalesce("lapsed", F.lit(False)))
    return rows.withColumn("active", _refreshed_active()).select(*MEMBER_COLUMNS)


def activity_refresh(model: Model, touched: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Members with `active` recomputed for the touched ones; the others unchanged."""
    rows = model.members.join(progress.lapsed_members(model, rules, touched), "member_id", "left")
    active = F.when((F.col("level") == 1) & F.col("lapsed").isNotNull(), ~F.col("lapsed"))
    return rows.withColumn("active", F.coalesce(active, F.col("active"))).select(*MEMBER_COLUMNS)


def promotion_eligible(model: Model) -> DataFrame:
    """member_id of everyone who meets the whole promotion rule, at any level."""
    return progress.profile(model).where(progress.is_complete()).select("member_id")


def wanted_roster(members: DataFrame, as_of: str) -> DataFrame:
    """A roster row for every member at level 2 or above."""
    return members.where(F.col("level") >= 2).select(
        F.concat(F.lit("roster:"), F.col("member_id").cast("string")).alias("roster_id"),
        "member_id",
        moment(as_of).alias("added_at"),
    )


def roster_sync(roster: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """Add the roster rows that members lack; none is ever removed."""
    return insert_missing(roster, wanted_roster(members, as_of), ["member_id"])
