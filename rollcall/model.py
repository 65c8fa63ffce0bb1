"""Table schemas, rule parameters, and the set of tables that operators work on.

Timestamps are UTC wall-clock values (`timestamp_ntz`), so no result depends on the
session time zone. Ids may be of any type; operators never look inside them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Twenty digits before the point and eighteen after it; other numbers are turned away, not rounded.
EXPERIENCE = T.DecimalType(38, 18)

_TEXT, _INT, _DATE, _TIME = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()


def _struct(spec: list[tuple]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, "!" not in flag) for name, kind, flag in spec])


def schemas(member_id: T.DataType = _TEXT) -> dict[str, T.StructType]:
    """Schema of every table; `member_id` is the type of member ids."""
    session = [("session_id", _TEXT, "!"), ("session_date", _DATE, "!"), ("day_of_week", _TEXT, "!")]
    created = [("created_by", _TEXT, ""), ("created_at", _TIME, "!")]
    mark = [
        ("mark_id", _TEXT, "!"), ("session_id", _TEXT, "!"), ("member_id", member_id, "!"),
        ("status", _TEXT, "!"), ("marked_by", _TEXT, ""), ("marked_at", _TIME, "!"),
    ]

    def event(name: str) -> list[tuple]:
        return [(f"{name}_id", _TEXT, "!"), (f"{name}_date", _DATE, "!"), ("details", _TEXT, ""), *created]

    def bridge(name: str) -> list[tuple]:
        return [(f"{name}_id", _TEXT, "!"), ("member_id", member_id, "!"), ("added_at", _TIME, "!")]

    tables = {
        "members": [
            ("member_id", member_id, "!"), ("full_name", _TEXT, "!"), ("email", _TEXT, ""),
            ("phone", _TEXT, ""), ("age", _INT, ""), ("member_type", _TEXT, ""),
            ("college_name", _TEXT, ""), ("branch", _TEXT, ""), ("semester", _INT, ""),
            ("company_name", _TEXT, ""), ("designation", _TEXT, ""),
            ("experience", EXPERIENCE, ""), ("description", _TEXT, ""),
            ("active", T.BooleanType(), "!"), ("level", _INT, "!"),
            ("promoted_at", _TIME, ""), ("created_at", _TIME, "!"),
        ],
        "topics": [
            ("topic_id", _TEXT, "!"), ("name", _TEXT, "!"), ("order_index", _INT, "!"),
            ("created_at", _TIME, "!"),
        ],
        "sessions": [*session, ("topic_id", _TEXT, ""), *created],
        "marks": mark,
        "outings": event("outing"),
        "outing_members": bridge("outing"),
        "services": event("service"),
        "service_members": bridge("service"),
        "stage2_roster": [("roster_id", _TEXT, "!"), ("member_id", member_id, "!"), ("added_at", _TIME, "!")],
        "stage2_sessions": [*session, *created],
        "stage2_marks": mark,
        "markers": [("marker_id", _TEXT, "!"), ("name", _TEXT, "!")],
    }
    return {name: _struct(spec) for name, spec in tables.items()}


#: Unique keys of each table.
KEYS = {
    "members": [["member_id"]],
    "topics": [["topic_id"], ["name"]],
    "sessions": [["session_id"], ["session_date"]],
    "marks": [["mark_id"], ["session_id", "member_id"]],
    "outings": [["outing_id"], ["outing_date"]],
    "outing_members": [["outing_id", "member_id"]],
    "services": [["service_id"], ["service_date"]],
    "service_members": [["service_id", "member_id"]],
    "stage2_roster": [["roster_id"], ["member_id"]],
    "stage2_sessions": [["session_id"], ["session_date"]],
    "stage2_marks": [["mark_id"], ["session_id", "member_id"]],
    "markers": [["marker_id"]],
}

MEMBER_COLUMNS = [f.name for f in schemas()["members"].fields]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the activity and eligibility rules."""

    recent_n: int = 4
    min_topics: int = 4


@dataclass(frozen=True)
class Calendar:
    """When sessions are held (`weekday`: 1 is Sunday, None is any day) and how topics rotate."""

    weekday: int | None = 1
    anchor: str = "2026-05-31"
    start_index: int = 6
    cadence_days: int = 7


def standing_schemas(member_id: T.DataType = _TEXT) -> dict[str, T.StructType]:
    """Schema of the tables of a standing."""
    key = [("bucket", _INT, "!"), ("member_id", member_id, "!")]
    status = T.ArrayType(_struct([("session_date", _DATE, "!"), ("status", _TEXT, "!")]))
    return {
        "coverage": _struct([*key, ("topic_id", _TEXT, "!"), ("n_present", T.LongType(), "!")]),
        "tallies": _struct([*key, ("n_outings", T.LongType(), "!"), ("n_services", T.LongType(), "!")]),
        "recent": _struct([*key, ("recent", status, "!")]),
    }


@dataclass(frozen=True)
class Standing:
    """What the rules need of each member, kept up to date beside the tables (`plans.standing`)."""

    coverage: DataFrame
    tallies: DataFrame
    recent: DataFrame
    buckets: int
    recent_n: int

    def tables(self) -> dict[str, DataFrame]:
        return {"coverage": self.coverage, "tallies": self.tallies, "recent": self.recent}


#: Tables that a standing is read from.
STANDING_FROM = {"sessions", "marks", "outing_members", "service_members"}


@dataclass(frozen=True)
class Model:
    """One DataFrame per table. Operators take a Model and give results or a new Model.

    Dimensions (topics, sessions, outings, services, markers) are joined without hints:
    Spark broadcasts one whose size is under its threshold and shuffles it otherwise, with
    skewed partitions split.
    """

    members: DataFrame
    topics: DataFrame
    sessions: DataFrame
    marks: DataFrame
    outings: DataFrame
    outing_members: DataFrame
    services: DataFrame
    service_members: DataFrame
    stage2_roster: DataFrame
    stage2_sessions: DataFrame
    stage2_marks: DataFrame
    markers: DataFrame
    #: None where it is not kept; then the rules read all facts.
    standing: Standing | None = None

    @classmethod
    def table_names(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name != "standing"]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.table_names()}

    def with_tables(self, **tables: DataFrame | Standing | None) -> Model:
        """This model with some tables replaced. A standing that is read from one of them goes, unless the new one is given."""
        if "standing" not in tables and STANDING_FROM & set(tables):
            tables["standing"] = None
        return replace(self, **tables)
