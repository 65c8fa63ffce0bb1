"""Reading the base tables from a live PostgreSQL database over JDBC.

Stored names may differ from ours: give a `Stored` per table that says what the table is
called and what its columns are called. A read is split by ranges of the table's blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.model import Model, schemas


@dataclass(frozen=True)
class Stored:
    """Stored table name and, by our column name, the stored column name where it differs."""

    table: str
    columns: dict[str, str] = field(default_factory=dict)

    def column(self, ours: str) -> str:
        return self.columns.get(ours, ours)


#: Names as in `rollcall.model`.
SAME_NAMES = {name: Stored(name) for name in Model.table_names()}


def split_predicates(column: str, blocks: int, parts: int) -> list[str]:
    """Disjoint conditions that cover every row: ranges of the table's blocks, so each part reads its own blocks only. The last
    is open, for blocks added meanwhile."""
    cuts = sorted({max(1, blocks * i // parts) for i in range(1, parts)})
    if not cuts:
        return ["TRUE"]
    bounds = [f"{column} < '({cuts[0]},0)'::tid"]
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        upper = "" if high is None else f" AND {column} < '({high},0)'::tid"
        bounds.append(f"{column} >= '({low},0)'::tid{upper}")
    return bounds


def blocks_query(stored: Stored) -> str:
    return f"(SELECT pg_relation_size('{stored.table}'::regclass) / current_setting('block_size')::bigint AS blocks) AS t"


def source_query(table: str, stored: Stored) -> str:
    """The wanted columns only, so nothing private is read; ids as text, moments in UTC."""
    parts = ["ctid AS split_key"]
    for f in schemas()[table].fields:
        name, kind = stored.column(f.name), f.dataType.simpleString()
        casts = {"string": f"{name}::text", "timestamp_ntz": f"({name} AT TIME ZONE 'UTC')"}
        parts.append(f'{casts.get(kind, name)} AS "{f.name}"')
    return f"(SELECT {', '.join(parts)} FROM {stored.table}) AS t"


def read_table(
    spark: SparkSession, url: str, table: str, stored: Stored, properties: dict[str, str], parts: int = 32
) -> DataFrame:
    """One table, read by `parts` tasks. Needs the PostgreSQL JDBC driver on the class path."""
    blocks = int(spark.read.jdbc(url, blocks_query(stored), properties=properties).first()["blocks"])
    rows = spark.read.jdbc(
        url,
        source_query(table, stored),
        predicates=split_predicates("split_key", blocks, parts),
        properties={"preferTimestampNTZ": "true", **properties},
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas()[table].fields])


def read_model(
    spark: SparkSession, url: str, properties: dict[str, str], names: dict[str, Stored] = SAME_NAMES, parts: int = 32
) -> Model:
    return Model(**{t: read_table(spark, url, t, names[t], properties, parts) for t in Model.table_names()})
