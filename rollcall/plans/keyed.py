"""Keyed-table building blocks: keep-last, merge, claims.

All of them join a large stored table with an incoming one in the same way: the stored
side is first cut down by a semi join, which Spark broadcasts when the incoming side is
small and shuffles otherwise. A small batch therefore never moves the stored table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.sources.lineage import cut_lineage


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`.

    An aggregate rather than a window: it is combined inside the map tasks, so a key that
    holds much of the table sends one row per task.
    """
    row = F.struct(*[c for c in df.columns if c not in keys])
    last = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row_"))
    return last.select(*keys, "row_.*").select(*df.columns)


def matched_keys(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of `stored` that occur in `incoming`, as often as they are stored.

    The incoming keys are made distinct first, in the map tasks already, so one that
    fills much of a feed does not land on one task; of the stored side Spark can split
    a skewed partition.
    """
    return stored.select(*keys).join(incoming.select(*keys).distinct(), keys, "left_semi")


def flag_known(incoming: DataFrame, stored: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """`incoming` with a boolean column saying whether its key is in `stored`."""
    known = matched_keys(stored, incoming, keys).distinct().withColumn(flag, F.lit(True))
    return incoming.join(known, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unknown_keys(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Distinct keys of `incoming` that are not in `stored`, written as a table.

    They are few in sound data; written, their size is known, so that what is then joined
    to them need not be shuffled.
    """
    asked = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    return cut_lineage(asked.join(stored.select(key), key, "left_anti"))


def flag_unknown(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """`incoming` with `unknown`: its key is null or not in `stored`."""
    flagged = incoming.join(unknown_keys(incoming, stored, key).withColumn("unknown", F.lit(True)), key, "left")
    return flagged.withColumn("unknown", F.coalesce("unknown", F.col(key).isNull()))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Merge `incoming` (one row per key) into `stored`.

    A stored row with the same key takes the `update` columns and keeps the rest; a new
    key is appended.
    """
    changes = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in update], F.lit(True).alias("hit_"))
    merged = stored.join(changes, keys, "left").select(
        *[
            F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
            for c in stored.columns
        ]
    )
    added = incoming.join(matched_keys(stored, incoming, keys), keys, "left_anti")
    return merged.unionByName(added.select(*stored.columns))


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows of `incoming` (one per key) whose key is not stored."""
    added = incoming.join(matched_keys(stored, incoming, keys), keys, "left_anti")
    return stored.unionByName(added.select(*stored.columns))


def spread_key(key: Column, order: str) -> Column:
    """`key` as text, with a value of its own for each row that has none: rows without a key meet nothing in a
    join, and don't land on one task."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.concat(F.lit("!"), F.col(order).cast("string")))


def first_claims(df: DataFrame, key: str, order: str, owner: str) -> DataFrame:
    """`claimed_by`: for each given value of `key` (a `spread_key`), the owner of the earliest row."""
    return (
        df.where(F.col(key).startswith("="))
        .groupBy(key)
        .agg(F.min_by(owner, order).alias("claimed_by"))
    )


def last_given(column: str, order: str) -> Column:
    """Aggregate: the last value of `column` that is not null, by `order`."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
