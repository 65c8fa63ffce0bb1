"""Snapshots, JSON export, the database reader's queries, and marks as a stream."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall.operators import logs, marking, registration
from rollcall.sources import database
from rollcall.sources.bindings import READS, SCHEMAS
from rollcall.sources.lineage import cut_lineage, scope, shared_folder
from rollcall.sources.store import export_json, latest_version, load, publish, publish_outcome
from rollcall.streaming import marks_feed
from tests.conftest import AS_OF, SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_snapshots(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    publish(seed, root, 1)
    first = load(spark, root)
    for name, table in seed.tables().items():
        assert rows(getattr(first, name)) == rows(table)
        assert getattr(first, name).columns == table.columns
    smaller = registration.delete_members(first, spark.createDataFrame([("m01",)], "member_id string")).model
    publish(smaller, root, 2, changed=registration.CASCADE)
    assert latest_version(spark, root) == 2
    second = load(spark, root)
    assert second.marks.count() == 392 and second.sessions.count() == 8
    # the older version can still be read
    assert load(spark, root, 1).marks.count() == 400
    assert len(list((tmp_path / "store" / "tables" / "sessions").iterdir())) == 1


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_a_published_version_is_never_written_again(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    publish(seed, root, 1)
    before = files(root)
    with pytest.raises(FileExistsError):
        publish(seed.with_tables(topics=seed.topics.limit(4)), root, 1, changed=["topics"])
    with pytest.raises(FileNotFoundError):
        publish(seed, root, 0, changed=["topics"])
    assert files(root) == before and load(spark, root).topics.count() == 8


def record(seq, batch, ord_, day, member, status="present"):
    return (seq, batch, ord_, day, member, status, None, datetime(2026, 6, 1, 8))


def test_a_batch_of_one_record_writes_one_session(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    publish(seed, root, 1)
    stored = load(spark, root)
    schema = marks_feed.record_schema()
    one = spark.createDataFrame([record(1, "b", 1, "2026-05-24", "m03", "absent")], schema)
    folder = Path(shared_folder(spark), "rollcall")
    kept = set(folder.iterdir()) if folder.exists() else set()
    with scope(spark):
        publish_outcome(marking.upsert_marks(stored, one, AS_OF, "2026-06-01"), root, 2, ["sessions", "marks"])
    assert set(folder.iterdir()) == kept  # nothing is left of what was stored on the way
    written = [p for p in (tmp_path / "store" / "tables" / "marks").iterdir()]
    assert sorted(len([x for x in p.iterdir() if x.is_dir()]) for p in written) == [1, 8]
    after = load(spark, root)
    assert after.marks.count() == 400
    changed = after.marks.join(stored.marks, stored.marks.columns, "left_anti").collect()
    assert [(r.session_id, r.member_id, r.status) for r in changed] == [("2026-05-24", "m03", "absent")]
    assert rows(load(spark, root, 1).marks) == rows(seed.marks)


def test_a_date_filter_prunes_the_stored_marks(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    publish(seed, root, 1)
    plan = logs.list_marks(load(spark, root), session_date="2026-05-24")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert logs.list_marks(load(spark, root), session_date="2026-05-24").count() == 50


def test_missing_snapshot(spark, tmp_path):
    with pytest.raises(Exception):
        load(spark, str(tmp_path / "nothing"))


def test_export_json(spark, seed, tmp_path):
    export_json(logs.list_sessions(seed), str(tmp_path / "out"))
    lines = [json.loads(line) for f in Path(tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 8 and {"session_id", "topic_name"} <= set(lines[0])


def test_cut_lineage(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    cut = cut_lineage(df)
    assert rows(cut) == rows(df) and "Range" not in cut._jdf.queryExecution().executedPlan().toString()
    assert shared_folder(spark)


def test_database_queries():
    stored = database.Stored("people", {"member_id": "id", "member_type": "kind"})
    sql = database.source_query("members", stored)
    assert sql.startswith("(SELECT ctid AS split_key, ") and sql.endswith(" FROM people) AS t")
    assert 'id::text AS "member_id"' in sql and 'kind::text AS "member_type"' in sql and 'age AS "age"' in sql
    assert "(created_at AT TIME ZONE 'UTC') AS \"created_at\"" in sql and "password" not in sql
    assert "ctid AS split_key" in sql and "'people'::regclass" in database.blocks_query(stored)
    assert database.split_predicates("c", 10, 3) == [
        "c < '(3,0)'::tid", "c >= '(3,0)'::tid AND c < '(6,0)'::tid", "c >= '(6,0)'::tid"
    ]
    assert database.split_predicates("c", 0, 1) == ["TRUE"] and len(database.split_predicates("c", 1, 4)) == 2


KIND = SCHEMAS["members"]["member_id"].dataType


def feed_files(spark, folder, parts):
    """The feed in order as files; each bound lies inside a request batch, whose even records come first."""
    schema = marks_feed.record_schema(KIND)
    feed = entry.Tables(spark, SF).feed.select(*schema.names)
    seqs = sorted(r.seq for r in feed.select("seq").distinct().collect())
    bounds = [-1, *[seqs[len(seqs) * k // parts] for k in range(1, parts)], seqs[-1] + 1]
    for low, high in zip(bounds, bounds[1:], strict=False):
        begun = f"(seq > {low} or seq = {low} and ord % 2 = 1)"
        feed.where(f"{begun} and (seq < {high} or seq = {high} and ord % 2 = 0)").coalesce(1).write.mode("append").parquet(folder)
    return schema


def run_feed(spark, folder, schema, root):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    marks_feed.start_feed(stream, root, availableNow=True).awaitTermination()


def test_micro_batches_give_the_same_as_one_batch(spark, tmp_path):
    t = entry.Tables(spark, SF)
    folder, root = str(tmp_path / "in"), str(tmp_path / "feed")
    schema = feed_files(spark, folder, 3)
    run_feed(spark, folder, schema, root)
    assert marks_feed.last_feed_batch(spark, root) == 2
    after = marks_feed.current(t.morning, root, entry.AS_OF, entry.TODAY, entry.DAILY)
    whole = marking.upsert_marks(t.morning, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY)
    assert rows(after.rejected) == rows(whole.rejected)
    assert rows(after.changed.marks) == rows(whole.changed.marks)
    # nothing new: a second run adds no micro-batch, and a replayed one replaces its own folder
    run_feed(spark, folder, schema, root)
    assert marks_feed.last_feed_batch(spark, root) == 2
    # folding: publish, then read only later micro-batches
    store = str(tmp_path / "store")
    publish(t.morning, store, 1)
    publish_outcome(after, store, 2, ["sessions", "marks"])
    folded = load(spark, store, member_id=KIND)
    log = marks_feed.record_log(spark, root, after=2, member_id=KIND)
    assert log.count() == 0 and rows(folded.marks) == rows(after.changed.marks)
    assert rows(folded.members) == rows(whole.model.members)
    assert folded.outings.count() == t.morning.outings.count()


def test_a_request_batch_over_two_micro_batches_is_judged_as_one(spark, seed, tmp_path):
    schema, folder, root = marks_feed.record_schema(), str(tmp_path / "in"), str(tmp_path / "feed")
    halves = [
        [record(1, "good", 1, "2026-05-24", "m03", "absent"), record(2, "bad", 1, "2026-05-24", "m04", "absent"), record(3, "late", 1, "2026-05-24", "m99")],
        [record(1, "good", 2, "2026-05-24", "m05", "absent"), record(2, "bad", 2, "2026-05-24", "m06", "maybe")],
    ]
    for part in halves:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        run_feed(spark, folder, schema, root)
    log = marks_feed.current(seed, root, AS_OF, "2026-06-01")
    assert {r.batch_id for r in log.rejected.collect()} == {"bad", "late"}
    changed = log.changed.marks.join(seed.marks, seed.marks.columns, "left_anti")
    assert sorted(r.member_id for r in changed.collect()) == ["m03", "m05"]
    # a member created after the feed began is known when the log is read
    new = seed.members.limit(1).withColumn("member_id", F.lit("m99")).withColumn("phone", F.lit("1"))
    grown = marks_feed.current(seed.with_tables(members=seed.members.unionByName(new)), root, AS_OF, "2026-06-01")
    assert {r.batch_id for r in grown.rejected.collect()} == {"bad"} and grown.changed.marks.where("member_id = 'm99'").count() == 1


def test_a_feed_without_a_micro_batch_is_empty(spark, seed, tmp_path):
    schema, folder, root = marks_feed.record_schema(), tmp_path / "in", str(tmp_path / "feed")
    folder.mkdir()
    run_feed(spark, str(folder), schema, root)
    assert marks_feed.last_feed_batch(spark, root) is None
    outcome = marks_feed.current(seed, root, AS_OF, "2026-06-01")
    assert outcome.rejected.count() == 0 and rows(outcome.changed.marks) == rows(seed.marks)


def test_the_stream_reads_a_folder_of_files(spark, tmp_path):
    """Every table as a folder of parts, as large tables are."""
    for name in READS:
        entry.read_table(spark, SF, name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    streamed, whole = (entry.queries()[n](spark, str(tmp_path)) for n in ("stream_upsert_marks", "upsert_marks"))
    assert rows(streamed) == rows(whole) and whole.count() == entry.queries()["upsert_marks"](spark, SF).count()


def test_scopes_remove_what_they_stored(spark):
    folder = Path(shared_folder(spark), "rollcall")
    before = set(folder.iterdir()) if folder.exists() else set()
    with scope(spark):
        cut = cut_lineage(spark.range(3))
        with scope(spark):
            cut_lineage(cut)
        assert cut.count() == 3
    assert (set(folder.iterdir()) if folder.exists() else set()) == before
