"""Additive schema changes and backfills, and the versions of the schema that stored tables may have."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.model import schemas

#: Columns added to members over time.
ADDED_COLUMNS = ["college_name", "branch", "semester", "designation", "experience", "description"]


def migrate_add_columns(members: DataFrame, columns: list[str] = ADDED_COLUMNS) -> DataFrame:
    """Add the missing ones of `columns` as typed nulls; present ones are left alone."""
    kinds = schemas()["members"]
    absent = [c for c in columns if c not in members.columns]
    return members.withColumns({c: F.lit(None).cast(kinds[c].dataType) for c in absent})


def backfill_profile(members: DataFrame) -> DataFrame:
    """Fill an empty `college_name` of studying members from the older `institution_name`."""
    wanted = (F.col("member_type") == "studying") & F.col("college_name").isNull()
    return members.withColumn("college_name", F.when(wanted, F.col("institution_name")).otherwise(F.col("college_name")))


@dataclass(frozen=True)
class Change:
    """What a schema version changed in a table: columns that came, columns that went, and how rows from before get the new ones."""

    added: list[str] = field(default_factory=list)
    dropped: T.StructType = field(default_factory=T.StructType)
    fill: Callable[[DataFrame], DataFrame] = lambda rows: rows


#: By version and table, what changed from the version before.
CHANGES: dict[int, dict[str, Change]] = {
    2: {
        "members": Change(
            ADDED_COLUMNS, T.StructType([T.StructField("institution_name", T.StringType())]), lambda rows: backfill_profile(migrate_add_columns(rows))
        )
    },
}
SCHEMA_VERSION = max(CHANGES)


def columns_of(table: str, version: int, schema: T.StructType) -> T.StructType:
    """The schema of a table as it was in a version; `schema` is the present one."""
    for later in range(SCHEMA_VERSION, version, -1):
        if change := CHANGES[later].get(table):
            schema = T.StructType([*[f for f in schema.fields if f.name not in change.added], *change.dropped.fields])
    return schema


def upgrade(rows: DataFrame, table: str, version: int) -> DataFrame:
    """Rows of a table as they were in a version, with the columns of the present one."""
    for later in range(version + 1, SCHEMA_VERSION + 1):
        if change := CHANGES[later].get(table):
            rows = change.fill(rows).drop(*change.dropped.names)
    return rows
