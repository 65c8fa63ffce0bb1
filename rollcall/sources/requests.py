"""Request tables for the write operators, derived from whole test tables.

All events are the feed that arrives on top of the marks of the morning; suppliers are applicants; the orders of a day
are requests to create, to replace and to delete outings and services.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.values import MEMBER_TYPES
from rollcall.sources.bindings import marked_by, phone_of, status_of


def is_morning() -> Column:
    return F.hour("ts") < 12


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def mark_records(events: DataFrame, supplier: DataFrame) -> DataFrame:
    """One batch per day and hour. Some records are bad on purpose: very
    high signups have an unknown status, the very highest errors an unknown member."""
    day = F.col("ts").cast("date")
    late = (F.col("event_type") == "signup") & (F.col("value") > 200)
    unknown = (F.col("event_type") == "error") & (F.col("value") > 260)
    return events.select(
        (F.date_diff(day, F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("bigint").alias("seq"),
        F.concat_ws("#", day.cast("string"), F.hour("ts").cast("string")).alias("batch_id"),
        F.col("event_id").alias("ord"),
        day.cast("string").alias("session_date"),
        F.when(unknown, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")).alias("member_id"),
        F.when(late, F.lit("late")).otherwise(status_of(F.col("event_type"))).alias("status"),
        marked_by(supplier).alias("marked_by"),
        F.col("ts").alias("received_at"),
    )


def stage2_mark_records(events: DataFrame, supplier: DataFrame, roster: DataFrame) -> DataFrame:
    """Records of roster members, with the highest errors of anyone as strays."""
    on_roster = roster.select(F.col("member_id").alias("user_id")).distinct().withColumn("on_roster", F.lit(True))
    stray = (F.col("event_type") == "error") & (F.col("value") > 200)
    wanted = events.join(on_roster, "user_id", "left").where(F.coalesce("on_roster", F.lit(False)) | stray)
    return mark_records(wanted.drop("on_roster"), supplier)


def session_requests(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Every day of the events and of the orders; a 31st is written in a wrong format."""
    days = events.select(F.col("ts").cast("date").alias("day")).union(orders.select(F.col("o_orderdate").cast("date")))
    days = days.distinct()
    wrong = F.date_format("day", "yyyy/MM/dd")
    return days.select(
        F.date_diff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("ord"),
        F.when(F.dayofmonth("day") == 31, wrong).otherwise(F.col("day").cast("string")).alias("session_date"),
        F.lit("planner").alias("created_by"),
    )


def applicants(supplier: DataFrame) -> DataFrame:
    """Suppliers as registration requests with phones in use, shared phones, and bad fields."""
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    kinds = F.array(*[F.lit(t) for t in [*MEMBER_TYPES, "retired"]])
    return supplier.select(
        F.col("s_suppkey").alias("ord"),
        (F.col("s_suppkey") + 1_000_000_000).alias("member_id"),
        F.when(nation == 24, F.lit("  ")).otherwise(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("full_name"),
        F.when(balance < 1000, phone_of(F.col("s_suppkey")))
        .when(balance < 3000, phone_of(nation, "800"))
        .otherwise(phone_of(F.col("s_suppkey"), " 700"))
        .alias("phone"),
        F.floor(balance / 100).cast("string").alias("age"),
        F.element_at(kinds, nation % 4 + 1).alias("member_type"),
        F.when(nation == 4, F.lit("")).otherwise(F.concat(F.lit("College "), nation.cast("string"))).alias("college_name"),
        F.concat(F.lit("Branch "), nation.cast("string")).alias("branch"),
        F.when(nation == 8, F.lit("two")).otherwise((nation % 9).cast("string")).alias("semester"),
        F.concat(F.lit("Company "), nation.cast("string")).alias("company_name"),
        F.when(nation != 5, F.concat(F.lit("Role "), nation.cast("string"))).alias("designation"),
        F.when(nation == 9, F.lit("-1")).otherwise(F.concat(nation.cast("string"), F.lit(".5"))).alias("experience"),
        F.when(nation != 6, F.concat(F.lit(" Preparing "), nation.cast("string"))).alias("description"),
    )


def patches(customer: DataFrame) -> DataFrame:
    """One patch per customer. By balance: no type, a type with its fields, or a type without."""
    balance, nation = F.col("c_acctbal"), _text("c_nationkey")
    segment = F.col("c_mktsegment")
    new_type = (
        F.when(segment.isin("BUILDING", "FURNITURE"), F.lit("working"))
        .when(segment.isin("AUTOMOBILE", "MACHINERY"), F.lit("not_studying_not_working"))
        .otherwise(F.lit("studying"))
    )
    typed, full = balance >= 2000, balance >= 5000

    def given(kind: str, value: Column) -> Column:
        return F.when(full & (new_type == kind), value)

    return customer.select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_nationkey") == 3, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("member_id"),
        F.when(balance < 6000, F.concat(F.lit("Renamed "), "c_name")).alias("full_name"),
        F.when(balance < 0, phone_of(F.col("c_custkey") + 1))
        .when(balance < 1000, phone_of(F.col("c_nationkey"), "600"))
        .when(balance < 1500, phone_of(F.col("c_custkey")))
        .alias("phone"),
        F.when(balance > 9000, F.lit("0")).when(balance > 7000, F.lit(" 44 ")).alias("age"),
        F.when(typed, new_type).alias("member_type"),
        F.when((F.col("c_nationkey") == 7) & (balance < 2000), F.lit("College without type"))
        .otherwise(given("studying", F.concat(F.lit("New College "), nation)))
        .alias("college_name"),
        given("studying", F.concat(F.lit("New Branch "), nation)).alias("branch"),
        given("studying", nation).alias("semester"),
        given("working", F.concat(F.lit("New Company "), nation)).alias("company_name"),
        F.lit(None).cast("string").alias("designation"),
        given("working", F.concat(nation, F.lit(".25"))).alias("experience"),
        F.when(typed & (new_type == "not_studying_not_working"), F.concat(F.lit(" Now "), nation, F.lit(" "))).alias(
            "description"
        ),
    )


def activity_requests(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """A status for every customer, none for one nation, and ids that do not exist."""
    known = customer.select(
        F.col("c_custkey").alias("ord"),
        F.col("c_custkey").alias("member_id"),
        F.when(F.col("c_nationkey") != 7, F.col("c_acctbal") >= 0).alias("active"),
    )
    strangers = supplier.select(
        F.col("s_suppkey") + 1_000_000_000, -1 - F.col("s_suppkey"), F.col("s_acctbal") >= 0
    )
    return known.union(strangers)


def member_ids_to_delete(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Customers with a negative balance, and ids that do not exist."""
    known = customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("member_id"))
    return known.union(supplier.select(-1 - F.col("s_suppkey")))


def _day() -> Column:
    return F.col("o_orderdate").cast("date")


def _day_ord(day: Column) -> Column:
    return F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def _later(day: Column) -> Column:
    """Twenty years on, when nothing is scheduled."""
    return F.add_months(day, 240)


def _order_days(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each day with orders and its customers, and the days."""
    pairs = orders.select(_day().alias("day"), F.col("o_custkey").alias("member_id"))
    return pairs, pairs.select("day").distinct()


def event_requests(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request for each day with orders, naming its customers. Every third day of a month asks for the day itself,
    the others for one twenty years on. Requests of a 1st also name a member that does not exist, those of a 2nd have no date.
    """
    pairs, days = _order_days(orders)
    of_month = F.dayofmonth("day")
    asked = F.when(of_month % 3 == 0, F.col("day")).otherwise(_later(F.col("day")))
    requests = days.select(
        _day_ord(F.col("day")).alias("ord"),
        F.when(of_month != 2, F.concat(asked.cast("string"), F.lit("T10:00:00Z"))).alias("event_date"),
        F.when(of_month > 10, F.concat(F.lit(" Day "), F.col("day").cast("string"))).otherwise(F.lit("  ")).alias("details"),
        F.lit("planner").alias("created_by"),
    )
    strangers = days.where(of_month == 1).select("day", F.lit(-1).cast("bigint").alias("member_id"))
    lines = pairs.union(strangers).select(_day_ord(F.col("day")).alias("ord"), "member_id")
    return requests, lines


def replace_requests(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request for each day with orders, naming its customers of any order. Some days move to another date, two kinds
    of them wrongly, and a 20th names an event that does not exist."""
    pairs, days = _order_days(orders)
    of_month = F.dayofmonth("day")
    requests = days.select(
        _day_ord(F.col("day")).alias("ord"),
        F.when(of_month == 20, F.lit("none")).otherwise(F.col("day").cast("string")).alias("event_id"),
        F.when(of_month == 13, _later(F.col("day")).cast("string"))
        .when(of_month == 14, F.lit("2050-01-01"))
        .when(of_month == 15, F.lit("soon"))
        .when(of_month == 16, F.date_add("day", 1).cast("string"))
        .when(of_month == 17, F.col("day").cast("string"))
        .alias("event_date"),
        F.when(of_month < 10, F.concat(F.lit("Replaced "), F.col("day").cast("string")))
        .when(of_month < 20, F.lit(" "))
        .alias("details"),
    )
    strangers = days.where(of_month == 28).select("day", F.lit(-1).cast("bigint"))
    return requests, pairs.union(strangers).select(_day_ord(F.col("day")).alias("ord"), "member_id")


def event_ids_to_delete(orders: DataFrame, key: str) -> DataFrame:
    """The days of orders up to a 15th, and for the others a day twenty years on, which is no event."""
    asked = F.when(F.dayofmonth(_day()) <= 15, _day()).otherwise(_later(_day()))
    return orders.select(asked.cast("string").alias(key)).distinct()


def members_before_profiles(members: DataFrame, customer: DataFrame) -> DataFrame:
    """Members as they were before the profile columns, with the older `institution_name`."""
    older = customer.select(
        F.col("c_custkey").alias("member_id"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("College "), _text("c_nationkey"))).alias("institution_name"),
    )
    kept = ["member_id", "full_name", "phone", "age", "member_type", "active", "level"]
    return members.select(*kept).join(older, "member_id")
