"""Versions of the store: claims, deleted keys, schema versions, the gate, folds of a feed, the layout by member."""

import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall.model import schemas
from rollcall.operators import events, marking, quality, registration, reports
from rollcall.operators.migrations import ADDED_COLUMNS
from rollcall.plans import refresh, standing
from rollcall.sources import claims, layout, lineage, store
from rollcall.streaming import marks_feed
from tests.conftest import AS_OF, SF
from tests.seed import mark_row, model_from, seed_rows

TODAY = "2026-06-01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    for name, table in a.tables().items():
        assert rows(table) == rows(getattr(b, name)), name


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


# --- claims ---------------------------------------------------------------------------------


def test_one_of_two_claims_wins(spark, tmp_path):
    path, won, start = str(tmp_path / "claims" / "1.json"), [], threading.Barrier(8)

    def claim(i):
        start.wait()
        won.append((claims.put(spark, path, {"version": i}), i))

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [i for ok, i in won if ok]
    assert len(won) == 8 and len(winners) == 1 and claims.read(spark, path) == {"version": winners[0]}
    assert claims.names(spark, str(tmp_path / "claims")) == ["1.json"]


def test_two_publishers_of_a_version(spark, seed, tmp_path):
    """Both pass the first look; the one that comes second gets an error and leaves nothing."""
    root = str(tmp_path)
    store.publish(seed, root, 1)
    before = {p for p in Path(root).rglob("*") if p.is_file()}
    late = store._Publication(spark, root, 2)
    late.table("topics", seed.topics)
    more = seed.topics.unionByName(seed.topics.limit(1).withColumns({"topic_id": F.lit("new"), "name": F.lit("New")}))
    store.publish(seed.with_tables(topics=more), root, 2, changed=["topics"])
    with pytest.raises(FileExistsError):
        try:
            late.commit()
        except Exception:
            late.give_up()
            raise
    assert store.load(spark, root).topics.count() == 9 and store.load(spark, root, 1).topics.count() == 8
    assert before < {p for p in Path(root).rglob("*") if p.is_file()}
    assert len(list((tmp_path / "tables" / "topics").iterdir())) == 2 and len(list((tmp_path / "manifest").iterdir())) == 2


def test_a_claim_without_content_is_no_version(spark, seed, tmp_path):
    root = str(tmp_path)
    store.publish(seed, root, 1)
    (tmp_path / "versions" / "2.json").touch()
    assert store.latest_version(spark, root) == 1 and store.load(spark, root).members.count() == 50
    with pytest.raises(FileExistsError):
        store.publish(seed, root, 2)
    store.publish(seed, root, 3)
    assert store.versions(spark, root) == [1, 3]


# --- deleted keys ---------------------------------------------------------------------------


def test_deleted_members_are_written_as_keys(spark, seed, tmp_path):
    root = str(tmp_path)
    store.publish(seed, root, 1, check=False)
    whole = size(tmp_path / "tables")
    ids = spark.createDataFrame([("m01",), ("m30",), ("none",)], "member_id string")
    deletion = registration.delete_members(store.load(spark, root), ids)
    store.publish_outcome(deletion.outcome, root, 2, registration.CASCADE)
    assert size(tmp_path / "tables") - whole < 0.2 * whole
    same(store.load(spark, root), deletion.model)
    same(store.load(spark, root, 1), seed)
    # an id that comes back keeps its new rows only
    new = seed.members.where("member_id = 'm01'").withColumn("full_name", F.lit("Again"))
    kept = store.load(spark, root)
    store.publish(kept.with_tables(members=kept.members.unionByName(new)), root, 3, changed=["members"])
    after = store.load(spark, root)
    assert after.members.where("member_id = 'm01'").first().full_name == "Again" and after.marks.where("member_id = 'm01'").count() == 0
    # written whole again: the same rows without keys to look up
    assert store.compact(spark, root, 4) == ["marks", "outing_members", "service_members", "stage2_marks", "stage2_roster"]
    same(store.load(spark, root, 4), after)
    assert "LeftAnti" not in store.load(spark, root, 4).marks._jdf.queryExecution().executedPlan().toString()


def test_marks_after_a_deletion_stay(spark, seed, tmp_path):
    """A folder written after the keys is not touched by them, one written before is, also when it is shared by later versions."""
    root = str(tmp_path)
    store.publish(seed, root, 1)
    ids = spark.createDataFrame([("m05",)], "member_id string")
    store.publish_outcome(registration.delete_members(store.load(spark, root), ids).outcome, root, 2, registration.CASCADE)
    back = store.load(spark, root)
    store.publish(back.with_tables(members=seed.members), root, 3, changed=["members"])
    one = [(1, "b", 1, "2026-05-24", "m05", "present", None, datetime(2026, 6, 1, 8))]
    records = spark.createDataFrame(one, marks_feed.record_schema())
    outcome = marking.upsert_marks(store.load(spark, root), records, AS_OF, TODAY)
    store.publish_outcome(outcome, root, 4, ["sessions", "marks"])
    got = store.load(spark, root).marks.where("member_id = 'm05'").collect()
    assert [r.session_id for r in got] == ["2026-05-24"] and store.load(spark, root).marks.count() == 393


def test_deleted_events_are_written_as_keys(spark, seed, tmp_path):
    root = str(tmp_path)
    kept = standing.with_standing(seed, AS_OF, buckets=4)
    store.publish(kept, root, 1, check=False)
    ids = spark.createDataFrame([("2026-05-24",)], "outing_id string")
    outcome = events.delete_events(store.load(spark, root), events.OUTINGS, ids, AS_OF)
    store.publish_outcome(outcome, root, 2, ["outings", "outing_members"])
    after = store.load(spark, root)
    same(after, outcome.model)
    assert rows(after.standing.tallies) == rows(standing.read_standing(after, buckets=4).tallies)


# --- a standing in the store ----------------------------------------------------------------


def test_a_batch_writes_members_that_change(spark, seed, tmp_path):
    root, full = str(tmp_path / "a"), str(tmp_path / "b")
    kept = standing.with_standing(seed, AS_OF, buckets=4)
    store.publish(kept, root, 1, check=False)
    store.publish(kept.with_tables(standing=None), full, 1, check=False)
    one = [(1, "b", i, f"2026-05-{17 + 7 * (i % 3):02d}", m, "present", None, datetime(2026, 6, 1, 8)) for i, m in enumerate(["m16", "m27", "m44", "m27"])]
    records = spark.createDataFrame([(s, f"{b}{i}", i, *rest) for s, b, i, *rest in one], marks_feed.record_schema())
    for where in (root, full):
        store.publish_outcome(marking.upsert_marks(store.load(spark, where), records, AS_OF, TODAY), where, 2, ["sessions", "marks"])
    after, plain = store.load(spark, root), store.load(spark, full)
    same(after, plain)
    assert [rows(t) for t in after.standing.tables().values()] == [rows(t) for t in standing.read_standing(after, buckets=4).tables().values()]
    lines = store.read_lines(spark, store.read_version(spark, root, 2))
    written = [line for line in lines if line["keys"] is None and line.written == 2 and line.table == "members"]
    assert sum(line.rows for line in written) < 5
    # a version without a standing drops the stored one, the next with one writes it whole
    store.publish(after.with_tables(marks=after.marks), root, 3, changed=["marks"])
    assert store.load(spark, root).standing is None
    again = standing.with_standing(store.load(spark, root), AS_OF, buckets=4)
    more = marking.upsert_marks(again, records.withColumn("status", F.lit("absent")), AS_OF, TODAY)
    store.publish_outcome(more, root, 4, ["sessions", "marks"])
    last = store.load(spark, root)
    assert [rows(t) for t in last.standing.tables().values()] == [rows(t) for t in standing.read_standing(last, buckets=4).tables().values()]


# --- schema versions ------------------------------------------------------------------------


def test_an_older_schema_is_read_as_the_present_one(spark, seed, tmp_path):
    root = str(tmp_path)
    old = seed.members.withColumn("institution_name", F.when(F.col("member_type") == "studying", F.lit("Old College"))).drop(*ADDED_COLUMNS)
    store.publish(seed.with_tables(members=old), root, 1, schema=1)
    first = store.load(spark, root)
    assert first.members.columns == schemas()["members"].names
    got = {(r.member_type, r.college_name, r.branch) for r in first.members.collect()}
    assert got == {("studying", "Old College", None), ("working", None, None)}
    # members of both schemas side by side, then all by the present one
    ids = spark.createDataFrame([("m01", True)], "member_id string, active boolean").withColumn("ord", F.lit(1))
    store.publish_outcome(registration.delete_members(first, ids.select("member_id")).outcome, root, 2, registration.CASCADE)
    assert store.load(spark, root).members.count() == 49
    assert "members" in store.compact(spark, root, 3) and rows(store.load(spark, root, 3).members) == rows(store.load(spark, root, 2).members)
    assert {line.schema for line in store.read_lines(spark, store.read_version(spark, root, 3)) if line.table == "members"} == {2}


# --- the gate -------------------------------------------------------------------------------


BROKEN = {
    "doubled": ("marks", [mark_row("2026-05-24", "m01", "present", datetime(2026, 5, 24))], [("marks", "unique mark_id", 1), ("marks", "unique session_id, member_id", 1)]),
    "unknown": ("marks", [mark_row("2026-05-24", "nobody", "present", datetime(2026, 5, 24))], [("marks", "member_id in members", 1)]),
    "status": ("marks", [], [("marks", "status", 1)]),
    "phone": ("members", [], [("members", "unique phone", 49)]),
    "empty": ("topics", [], [("sessions", "topic_id in topics", 8)]),
}


@pytest.mark.parametrize("name", list(BROKEN))
def test_a_model_that_breaks_a_rule_is_refused(spark, seed, tmp_path, name):
    table, more, want = BROKEN[name]
    data = seed_rows()
    changed = {"phone": {"phone": "1"}, "status": {"status": "maybe"}}.get(name, {})
    some = {"phone": 50, "status": 1}.get(name, 0)
    data[table] = [] if name == "empty" else [{**row, **(changed if i < some else {})} for i, row in enumerate(data[table])] + more
    root = str(tmp_path)
    with pytest.raises(store.ConstraintError) as error:
        store.publish(model_from(spark, data), root, 1)
    assert error.value.violations == want
    assert not [p for p in Path(root).rglob("*.parquet")] and store.versions(spark, root) == []
    store.publish(model_from(spark, data), root, 1, allow={(t, rule) for t, rule, _ in want} | quality.OF_MARKERS)
    assert store.versions(spark, root) == [1]


def test_a_version_that_takes_referred_keys_away_is_refused(spark, seed, tmp_path):
    root = str(tmp_path)
    store.publish(seed, root, 1)
    with pytest.raises(store.ConstraintError) as error:
        store.publish(seed.with_tables(members=seed.members.where("member_id <> 'm02'")), root, 2, changed=["members"])
    assert ("marks", "member_id in members", 8) in error.value.violations
    with pytest.raises(store.ConstraintError):
        gone = registration.delete_members(store.load(spark, root), spark.createDataFrame([("m02",)], "member_id string"))
        store.publish_outcome(gone.outcome, root, 2, ["members"])
    assert store.versions(spark, root) == [1]
    store.publish(seed.with_tables(topics=seed.topics), root, 2, changed=["topics"])


def test_keys_are_read_in_one_scan(spark, seed):
    found = quality.constraint_check(seed)
    assert found.count() == 51 and found.where("violations > 0").count() == 0
    keys = quality._keys(seed.marks, quality._rules("marks"))
    text = keys._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and text.count("Exchange hashpartitioning") == 1


def test_keys_that_tell_of_no_violation_are_not_written(spark, seed):
    """Unique keys that no table refers to are most of all keys; they are written if they are found again."""
    rules = [r for name in ("marks", "members") for r in quality._rules(name)]
    twice = seed.marks.unionByName(seed.marks.limit(1))
    first = twice.groupBy("mark_id").count().where("count > 1").first().mark_id
    told = quality._telling(quality._keys(twice, quality._rules("marks")).unionByName(quality._keys(seed.members, quality._rules("members"))), rules)
    by_rule = {}
    for r in told.collect():
        by_rule.setdefault(r.rule, []).append((r.key, r.n))
    assert by_rule["marks: unique mark_id"] == [(first, 2)] and len(by_rule["marks: unique session_id, member_id"]) == 1
    assert len(by_rule["members: unique member_id"]) == seed.members.count() and "members: unique phone" not in by_rule
    parts = spark.createDataFrame([("1", "23"), ("12", "3"), ("1:2", "3"), (None, "3"), ("-", "3"), ("3", None)], "a string, b string")
    assert parts.select(quality._text(["a", "b"])).distinct().count() == 6


def test_what_is_sent_to_all_tasks_is_bounded(spark, seed, tmp_path, monkeypatch):
    """More dead keys than may be sent are shuffled, however small their files are, and the rows are the same."""
    root = str(tmp_path)
    store.publish(standing.with_standing(seed, AS_OF), root, 1, check=False)
    ids = spark.createDataFrame([("m01",), ("m02",), ("m30",)], "member_id string")

    def joins():
        plan = store.load(spark, root).marks
        wanted = rows(plan)
        return wanted, "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()

    store.publish_outcome(registration.delete_members(store.load(spark, root), ids).outcome, root, 2, registration.CASCADE)
    few = joins()
    monkeypatch.setattr(lineage, "SENT_ROWS", 2)
    many = joins()
    assert few[0] == many[0] and few[1] and not many[1]
    gone = seed.outings.select("outing_id")
    deletion = events.delete_events(store.load(spark, root), events.OUTINGS, gone, AS_OF)
    store.publish_outcome(deletion, root, 3, ["outings", "outing_members"])
    after = store.load(spark, root)
    assert after.outings.count() == 0 and after.outing_members.count() == 0 and rows(after.marks) == few[0]


# --- folds ----------------------------------------------------------------------------------


def feed_parts(spark, t, folder, schema, bounds):
    """The feed in order; each bound splits a request batch."""
    hours = F.col("seq") + F.when(F.col("ord") % 2 == 1, 1).otherwise(0)
    for low, high in zip([-1, *bounds], [*bounds, 10**6], strict=True):
        yield t.feed.select(*schema.names).where((hours > low) & (hours <= high)).coalesce(1).write.mode("append").parquet(folder)


def test_folds_at_every_position_give_one_big_batch(spark, tmp_path):
    t = entry.Tables(spark, SF)
    kind = t.model.members.schema["member_id"].dataType
    schema = marks_feed.record_schema(kind)
    folder, feed, root = str(tmp_path / "in"), str(tmp_path / "feed"), str(tmp_path / "store")
    store.publish(t.morning, root, 1, check=False)
    rejected = []
    for version, _ in enumerate(feed_parts(spark, t, folder, schema, [250, 500]), 2):
        marks_feed.start_feed(spark.readStream.schema(schema).parquet(folder), feed, availableNow=True).awaitTermination()
        outcome = marks_feed.fold(spark, feed, root, version, entry.AS_OF, entry.TODAY, entry.DAILY, member_id=kind, check=False)
        rejected += rows(outcome.rejected)
        about = store.read_version(spark, root, version)
        assert about.feed_batch == version - 2 and spark.read.parquet(about.feed_open).count() > 0
    last = marks_feed.fold(spark, feed, root, 5, entry.AS_OF, entry.TODAY, entry.DAILY, grace=None, member_id=kind, check=False)
    rejected += rows(last.rejected)
    whole = marking.upsert_marks(t.morning, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY)
    after = store.load(spark, root, member_id=kind)
    assert rows(after.marks) == rows(whole.changed.marks) and rows(after.sessions) == rows(whole.changed.sessions)
    assert sorted(rejected) == rows(whole.rejected)
    assert spark.read.parquet(store.read_version(spark, root, 5).feed_open).count() == 0


def test_open_batches_and_late_records(spark, seed, tmp_path):
    schema, folder, feed, root = marks_feed.record_schema(), str(tmp_path / "in"), str(tmp_path / "feed"), str(tmp_path / "store")
    store.publish(seed, root, 1, check=False)

    def record(seq, batch, ord_, member, status="absent"):
        return (seq, batch, ord_, "2026-05-24", member, status, None, datetime(2026, 6, 1, 8))

    parts = [
        [record(1, "a", 1, "m03"), record(2, "b", 1, "m04"), record(3, "c", 1, "m05")],
        [record(2, "b", 2, "m06", "maybe"), record(4, "d", 1, "m04", "present")],
        [record(1, "a", 2, "m07"), record(5, "e", 1, "m08")],
    ]
    want = [([], set()), (["m03"], set()), (["m03", "m05"], {"a", "b"}), (["m03", "m05", "m08"], set())]
    for version, part in enumerate([*parts, None], 2):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
            marks_feed.start_feed(spark.readStream.schema(schema).parquet(folder), feed, availableNow=True).awaitTermination()
        outcome = marks_feed.fold(spark, feed, root, version, AS_OF, TODAY, grace=1 if part else None, check=False)
        changed = store.load(spark, root).marks.join(seed.marks, seed.marks.columns, "left_anti").where("status = 'absent'")
        members, turned_away = want[version - 2]
        assert sorted(r.member_id for r in changed.collect()) == members
        reasons = {r.batch_id: r.reason for r in outcome.rejected.collect()}
        assert set(reasons) == turned_away and reasons.get("a", marks_feed.LATE) == marks_feed.LATE
    assert store.load(spark, root).marks.where("member_id = 'm04' and session_id = '2026-05-24'").first().marked_at == datetime(2026, 6, 1, 8)


# --- the layout by member -------------------------------------------------------------------


def test_reports_over_the_layout_by_member_move_no_mark(spark, tmp_path):
    model = entry.Tables(spark, SF).model
    kind = model.members.schema["member_id"].dataType
    try:
        written = layout.write_by_member(model, str(tmp_path / "l"), buckets=4)
        attached = layout.attach(spark, str(tmp_path / "l"), 4, kind)
        want = rows(reports.all_members_report(refresh.prepare(model, entry.AS_OF)))
        for m in (written, attached):
            report = reports.all_members_report(refresh.prepare(m, entry.AS_OF))
            text = report._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(member_id" not in text and text.count("Bucketed: true") >= 4
            assert rows(report) == want
    finally:
        layout.detach(spark)
    assert not spark.catalog.listTables(pattern="rollcall_*")
