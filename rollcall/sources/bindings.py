"""A model derived from the test tables customer, events, orders and supplier.

Customers are members; their newest event of a day is their mark for that day's session; an order puts its customer
on the outing or the service of its day, by its priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.columns import day_name
from rollcall.functions.values import ABSENT, PRESENT, TOPICS
from rollcall.model import Calendar, Model, schemas
from rollcall.plans.keyed import keep_last
from rollcall.plans.refresh import fixed_topics, moment
from rollcall.sources.lineage import cut_lineage

CREATED = "2024-01-01 00:00:00"
AS_OF = "2024-02-01 09:00:00"
FIRST_DAY = "2024-01-01"
DAY_WITHOUT_TOPIC = "2024-01-15"

#: A session every day, topics rotating daily.
DAILY = Calendar(weekday=None, anchor=FIRST_DAY, start_index=6, cadence_days=1)

TYPE_OF_SEGMENT = {
    "BUILDING": "studying",
    "FURNITURE": "studying",
    "AUTOMOBILE": "working",
    "MACHINERY": "working",
    "HOUSEHOLD": "not_studying_not_working",
}

#: Every priority has a role, whatever the status of the order; an unknown one counts as a service.
OUTING_PRIORITIES = ["1-URGENT", "3-MEDIUM", "5-LOW"]

SCHEMAS = schemas(T.LongType())

READS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(READS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _conform(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table].fields])


def phone_of(number: Column, prefix: str = "900") -> Column:
    return F.format_string(f"{prefix}%07d", number)


def members(customer: DataFrame) -> DataFrame:
    segment = F.col("c_mktsegment")
    member_type = F.coalesce(*[F.when(segment == s, F.lit(t)) for s, t in TYPE_OF_SEGMENT.items()])
    nation = F.col("c_nationkey").cast("string")

    def for_type(kind: str, value: Column) -> Column:
        return F.when(F.col("member_type") == kind, value)

    rows = customer.withColumn("member_type", member_type).withColumns(
        {
            "member_id": F.col("c_custkey"),
            "full_name": F.col("c_name"),
            "email": F.lit(None),
            "phone": phone_of(F.col("c_custkey")),
            "age": F.lit(18) + F.col("c_custkey") % 40,
            "college_name": for_type("studying", F.concat(F.lit("College "), nation)),
            "branch": for_type("studying", F.concat(F.lit("Branch "), nation)),
            "semester": for_type("studying", F.col("c_custkey") % 8 + 1),
            "company_name": for_type("working", F.concat(F.lit("Company "), nation)),
            "designation": for_type("working", F.concat(F.lit("Role "), nation)),
            "experience": for_type("working", F.col("c_custkey") % 12),
            "description": for_type("not_studying_not_working", F.concat(F.lit("Preparing "), nation)),
            "active": F.lit(True),
            "level": F.when(F.col("c_custkey") % 10 == 3, 2).otherwise(1),
            "promoted_at": F.lit(None),
            "created_at": moment(CREATED),
        }
    )
    return _conform(rows, "members")


def topics(spark: SparkSession) -> DataFrame:
    return _conform(fixed_topics(spark).withColumn("created_at", moment(CREATED)), "topics")


def sessions(events: DataFrame) -> DataFrame:
    """One session per day that has events, on a daily rotation; one day has no topic."""
    days = events.select(F.col("ts").cast("date").alias("session_date")).distinct()
    position = F.pmod(F.date_diff("session_date", F.lit(FIRST_DAY).cast("date")) + DAILY.start_index, F.lit(len(TOPICS)))
    name = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (position + 1).cast("int"))
    with_topic = F.col("session_date") != F.lit(DAY_WITHOUT_TOPIC).cast("date")
    return _conform(
        days.withColumns(
            {
                "session_id": F.col("session_date").cast("string"),
                "day_of_week": day_name(F.col("session_date")),
                "topic_id": F.when(with_topic, F.concat(F.lit("topic:"), name)),
                "created_by": F.lit(None),
                "created_at": moment(CREATED),
            }
        ),
        "sessions",
    )


def status_of(event_type: Column) -> Column:
    return F.when(event_type.isin("purchase", "view"), F.lit(PRESENT)).otherwise(F.lit(ABSENT))


def marked_by(supplier: DataFrame) -> Column:
    total = supplier.agg(F.count(F.lit(1))).scalar()
    return (F.col("event_id") % total).cast("string")


def marks(events: DataFrame, supplier: DataFrame) -> DataFrame:
    """The newest event of a member on a day is the mark for that day."""
    days = events.select("event_id", "ts", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    newest = keep_last(days, ["user_id", "day"], ["ts", "event_id"])
    session_id = F.col("day").cast("string")
    return _conform(
        newest.withColumns(
            {
                "mark_id": F.concat_ws("|", session_id, F.col("user_id").cast("string")),
                "session_id": session_id,
                "member_id": F.col("user_id"),
                "status": status_of(F.col("event_type")),
                "marked_by": marked_by(supplier),
                "marked_at": F.col("ts"),
            }
        ),
        "marks",
    )


def role(priority: Column) -> Column:
    """`outing` or `service`."""
    return F.when(priority.isin(OUTING_PRIORITIES), F.lit("outing")).otherwise(F.lit("service"))


def _events_and_bridge(orders: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    chosen = orders.where(role(F.col("o_orderpriority")) == name)
    pairs = chosen.select(F.col("o_orderdate").cast("date").alias(f"{name}_date"), F.col("o_custkey").alias("member_id"))
    key = F.col(f"{name}_date").cast("string").alias(f"{name}_id")
    pairs = cut_lineage(pairs.distinct())
    bridge = pairs.select(key, "member_id", moment(CREATED).alias("added_at"))
    events = pairs.select(f"{name}_date").distinct().select(
        key, f"{name}_date", F.lit(None).alias("details"), F.lit(None).alias("created_by"),
        moment(CREATED).alias("created_at"),
    )
    return cut_lineage(_conform(events, f"{name}s")), _conform(bridge, f"{name}_members")


def from_test_tables(spark: SparkSession, sf_dir: str) -> Model:
    """The model of one folder of test tables.

    Sessions, marks and both bridges with their events are worked out of the raw tables
    once and written as tables, as a load job would; members and markers are projections.
    """
    customer, events, orders, supplier = (
        read_table(spark, sf_dir, name) for name in ["customer", "events", "orders", "supplier"]
    )
    member_rows = members(customer)
    session_rows = cut_lineage(sessions(events))
    mark_rows = cut_lineage(marks(events, supplier))
    outings, outing_members = _events_and_bridge(orders, "outing")
    services, service_members = _events_and_bridge(orders, "service")
    roster = member_rows.where(F.col("level") == 2).select(
        F.concat(F.lit("roster:"), F.col("member_id").cast("string")).alias("roster_id"),
        "member_id",
        moment(CREATED).alias("added_at"),
    )
    sundays = session_rows.where(F.dayofweek("session_date") == 1)
    stage2_marks = mark_rows.where(F.dayofweek(F.col("session_id").cast("date")) == 1)
    return Model(
        members=member_rows,
        topics=topics(spark),
        sessions=session_rows,
        marks=mark_rows,
        outings=outings,
        outing_members=outing_members,
        services=services,
        service_members=service_members,
        stage2_roster=_conform(roster, "stage2_roster"),
        stage2_sessions=_conform(sundays, "stage2_sessions"),
        stage2_marks=stage2_marks.join(roster.select("member_id"), "member_id", "left_semi").select(*mark_rows.columns),
        markers=_conform(
            supplier.select(F.col("s_suppkey").alias("marker_id"), F.col("s_name").alias("name")), "markers"
        ),
    )
