"""Member-keyed layout: members and the facts about them in buckets by member.

Tables in equally many buckets by `member_id` are grouped and joined by member where they lie: `all_members_report` and the other reports
over the profile move no mark. A bucket is read by one task, so facts are laid out like this only where a key bounds what a member can
have: one mark a session, one row an outing or service.

The tables are external ones of the session's catalog, at paths under `root`; another session attaches them by their folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rollcall.model import Model, schemas

BY_MEMBER = ["members", "marks", "outing_members", "service_members", "stage2_roster", "stage2_marks"]
BUCKETS = 64


def _table(name: str) -> str:
    return f"rollcall_{name}_{uuid.uuid4().hex}"


def write_by_member(model: Model, root: str, buckets: int = BUCKETS) -> Model:
    """Write the model under `root`, members and their facts in buckets; gives the model as it is stored then."""
    spark, tables = model.members.sparkSession, {}
    for name, rows in model.tables().items():
        if name in BY_MEMBER:
            # dealt out as the buckets are, so each bucket is one sorted file
            dealt = rows.repartition(buckets, "member_id").write.mode("errorifexists").format("parquet")
            table = _table(name)
            dealt.bucketBy(buckets, "member_id").sortBy("member_id").option("path", f"{root}/{name}").saveAsTable(table)
            tables[name] = spark.table(table)
        else:
            rows.write.mode("errorifexists").parquet(f"{root}/{name}")
            tables[name] = spark.read.schema(rows.schema).parquet(f"{root}/{name}")
    return Model(**tables)


def attach(spark: SparkSession, root: str, buckets: int = BUCKETS, member_id: T.DataType = T.StringType()) -> Model:
    """The model that was written under `root` with as many buckets."""

    def table(name: str, schema: T.StructType) -> DataFrame:
        if name not in BY_MEMBER:
            return spark.read.schema(schema).parquet(f"{root}/{name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {(new := _table(name))} ({columns}) USING parquet CLUSTERED BY (member_id) SORTED BY (member_id) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{root}/{name}'"
        )
        return spark.table(new)

    return Model(**{name: table(name, schema) for name, schema in schemas(member_id).items()})


def detach(spark: SparkSession) -> None:
    """Take the tables that were written or attached out of the catalog; their files stay."""
    for table in spark.catalog.listTables(pattern="rollcall_*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
