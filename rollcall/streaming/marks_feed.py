"""Mark batches as a stream, judged and merged on read.

Every micro-batch appends its records, as they come, to a folder named by the micro-batch id, so a replayed micro-batch
replaces its own folder and nothing else. Records are judged when the log is read: a request batch is accepted or turned
away as a whole, over all micro-batches it came in, and against the members of that moment. The stored marks are not
rewritten per micro-batch; `current` merges the log into them, and `fold` publishes them as a version of the store that says how far the
log is folded in.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollcall.model import Calendar, Model, Rules
from rollcall.operators.marking import upsert_marks
from rollcall.operators.outcome import Outcome
from rollcall.sources import store
from rollcall.sources.lineage import cut_lineage

LATE = "the request batch was folded in before this record came"


def record_schema(member_id: T.DataType = T.StringType()) -> T.StructType:
    """Columns of a mark record."""
    text = T.StringType()
    return T.StructType(
        [
            T.StructField("seq", T.LongType()), T.StructField("batch_id", text), T.StructField("ord", T.LongType()),
            T.StructField("session_date", text), T.StructField("member_id", member_id),
            T.StructField("status", text), T.StructField("marked_by", text),
            T.StructField("received_at", T.TimestampNTZType()),
        ]
    )


def _folder(root: str, feed_batch: int) -> str:
    return f"{root}/records/feed_batch={feed_batch}"


def start_feed(records: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Start the stream. `trigger` as in `writeStream.trigger`, e.g. `availableNow=True`."""
    columns = [f.name for f in record_schema().fields]

    def take(batch: DataFrame, feed_batch: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(_folder(root, feed_batch))

    # so that the log can be read before the first micro-batch
    spark = records.sparkSession
    spark.createDataFrame([], records.select(*columns).schema).write.mode("ignore").parquet(_folder(root, -1))
    return (
        records.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def _log(spark: SparkSession, root: str, member_id: T.DataType) -> DataFrame:
    schema = T.StructType([*record_schema(member_id).fields, T.StructField("feed_batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/records")


def record_log(
    spark: SparkSession, root: str, after: int = -1, member_id: T.DataType = T.StringType()
) -> DataFrame:
    """Records of the micro-batches after `after`. `seq` puts request batches in the order in which they began to arrive."""
    log = _log(spark, root, member_id).where(F.col("feed_batch") > after)
    began = log.groupBy("batch_id").agg(F.min("feed_batch").alias("began"))
    return log.join(began, "batch_id").withColumn("seq", F.struct("began", "seq")).drop("feed_batch", "began")


def current(
    model: Model, root: str, as_of: str, today: str, calendar: Calendar = Calendar(), rules: Rules = Rules(), after: int = -1
) -> Outcome:
    """`model`, the latest one, with the log after a micro-batch merged in; `rejected` has the request batches turned away."""
    log = record_log(model.members.sparkSession, root, after, model.members.schema["member_id"].dataType)
    return upsert_marks(model, log, as_of, today, calendar, rules)


def last_feed_batch(spark: SparkSession, root: str) -> int | None:
    """The last micro-batch with records, null before the first."""
    log = spark.read.schema("batch_id string, feed_batch long").parquet(f"{root}/records").where("feed_batch >= 0")
    return log.agg(F.max("feed_batch")).first()[0]


# --- folding ------------------------------------------------------------------------------


def unfolded(spark: SparkSession, root: str, at: store.Version, upto: int, member_id: T.DataType) -> tuple[DataFrame, DataFrame]:
    """Records up to a micro-batch that a version doesn't have, with `feed_batch`; and the ids of request batches that it has but
    that got more records since.

    Records of request batches that the version left open are among the first, from micro-batches before it as well; only the folders
    since the earliest of these are read for them.
    """
    since = -1 if at.feed_batch is None else at.feed_batch
    log = _log(spark, root, member_id).where(F.col("feed_batch") <= upto)
    new = log.where(F.col("feed_batch") > since)
    if since < 0:
        return new, new.select("batch_id").where(F.lit(False))
    left = spark.read.schema("batch_id string, began long").parquet(at.feed_open)
    first = left.agg(F.min("began")).first()[0]
    ids = new.select("batch_id").distinct().join(left, "batch_id", "left_anti")
    late = cut_lineage(log.where(F.col("feed_batch") <= since).join(ids, "batch_id", "left_semi").select("batch_id").distinct())
    rows = new.join(late, "batch_id", "left_anti")
    if first is not None:
        before = log.where((F.col("feed_batch") <= since) & (F.col("feed_batch") >= first))
        rows = rows.unionByName(before.join(left, "batch_id", "left_semi"))
    return rows, late


def fold(
    spark: SparkSession, root: str, folder: str, version: int, as_of: str, today: str, calendar: Calendar = Calendar(),
    rules: Rules = Rules(), upto: int | None = None, grace: int | None = 1, member_id: T.DataType = T.StringType(), check: bool = True,
) -> Outcome:
    """Publish version `version` of the store in `folder`: the latest one with the feed under `root` folded in up to a micro-batch, the last
    by default.

    A request batch is open while one of the last `grace` micro-batches has records of it; None closes all. An open one and those
    that began after it are carried over: the version names them, and the next fold judges each as a whole, with all its records. So
    batches are applied in the order in which they began, wherever the folds are. A record for a batch that is folded in comes
    too late; its batch is listed in `rejected` with that reason, once more if need be, and what was folded in stays.
    """
    at = store.read_version(spark, folder, store.latest_version(spark, folder, before=version))
    last = last_feed_batch(spark, root) if upto is None else upto
    last = max(-1 if last is None else last, -1 if at.feed_batch is None else at.feed_batch)
    rows, late = unfolded(spark, root, at, last, member_id)
    began = F.min("feed_batch").alias("began")
    batches = cut_lineage(rows.groupBy("batch_id").agg(began, F.max("feed_batch").alias("last"), F.min("seq").alias("first")))
    place = F.struct("began", "first")
    still = batches.where(F.lit(False) if grace is None else F.col("last") > last - grace).agg(F.min(place).alias("place"))
    first_open = still.scalar()
    taken = batches.where(first_open.isNull() | (place < first_open))
    left = batches.join(taken.select("batch_id"), "batch_id", "left_anti").select("batch_id", "began")
    path = store.feed_folder(folder)
    left.write.mode("errorifexists").parquet(path)
    records = rows.join(taken.select("batch_id", "began"), "batch_id").withColumn("seq", F.struct("began", "seq")).drop("feed_batch", "began")
    model = store.load(spark, folder, at.version, member_id)
    outcome = upsert_marks(model, records, as_of, today, calendar, rules)
    store.publish_outcome(outcome, folder, version, ["sessions", "marks"], feed={"feed_batch": last, "feed_open": path}, check=check)
    return replace(outcome, rejected=outcome.rejected.unionByName(late.withColumn("reason", F.lit(LATE))))
