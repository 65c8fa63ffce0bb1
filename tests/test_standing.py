"""The standing kept by changes against the rules over all facts."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall.model import Calendar, Rules
from rollcall.operators import events, marking, registration
from rollcall.plans import progress, refresh, standing
from rollcall.sources.lineage import cut_lineage
from rollcall.streaming.marks_feed import record_schema
from tests.conftest import AS_OF, SF

ANY_DAY = Calendar(weekday=None, anchor="2026-04-12", start_index=0, cadence_days=7)
TODAY = "2026-06-01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_standing(kept, model, *names):
    """Tables of a standing equal those that are read from all facts."""
    fresh = standing.read_standing(model, buckets=kept.buckets)
    for name in names or kept.tables():
        assert rows(getattr(kept, name)) == rows(getattr(fresh, name)), name


def random_records(spark, r, members, n):
    """Records of few days, new and old ones, so that marks are overwritten and sessions get other topics."""
    days = [date(2026, 4, 12) + timedelta(days=r.choice([0, 7, 14, 21, 28, 1, 3])) for _ in range(5)]
    batch = [(i % 7, f"b{i % 7}", i, str(days[i % 7 % 5]), r.choice(members), r.choice(["present", "present", "absent"]), None, datetime(2026, 6, 1, i % 24)) for i in range(n)]
    return spark.createDataFrame(batch, record_schema())


def test_random_batches_of_marks(spark, seed):
    r = random.Random(11)
    members = [f"m{i:02d}" for i in range(1, 51)]
    kept = standing.with_standing(seed, AS_OF, buckets=8)
    full = kept.with_tables(standing=None)
    for n in (60, 150):
        records = random_records(spark, r, members, n)
        outcomes = [marking.upsert_marks(m, records, AS_OF, TODAY, ANY_DAY) for m in (kept, full)]
        kept, full = (o.model for o in outcomes)
        same_standing(kept.standing, full, "coverage", "recent")
        assert rows(kept.members) == rows(full.members) and rows(kept.stage2_roster) == rows(full.stage2_roster)
        # what the next round starts from
        own = ["members", "stage2_roster", "topics", "marks", "sessions"]
        full = full.with_tables(**{n: cut_lineage(getattr(full, n)) for n in own})
        tables = {n: cut_lineage(t) for n, t in kept.standing.tables().items()}
        kept = full.with_tables(standing=standing.replace(kept.standing, **tables))
    assert rows(standing.topic_coverage(kept)) == rows(progress.topic_coverage(full))
    assert rows(standing.promotion_eligible(kept)) == rows(refresh.promotion_eligible(full))


def test_recent_is_row_number(spark, seed):
    """Also for marks that come late, on days before those that are kept."""
    kept = standing.with_standing(seed, AS_OF, Rules(recent_n=2), buckets=3)
    records = spark.createDataFrame(
        [(1, "a", 1, "2026-04-12", "m01", "absent", None, datetime(2026, 6, 1)), (1, "a", 2, "2026-04-12", "m41", "present", None, datetime(2026, 6, 1)),
         (2, "b", 1, "2026-05-31", "m02", "absent", None, datetime(2026, 6, 1)), (3, "c", 1, "2026-06-01", "m03", "absent", None, datetime(2026, 6, 1))],
        record_schema(),
    )
    after = marking.upsert_marks(kept, records, AS_OF, TODAY, ANY_DAY, Rules(recent_n=2)).changed
    got = {r.member_id: [tuple(x) for x in r.recent] for r in after.standing.recent.collect()}
    ranked = progress.recent_marks(after, 2).select("member_id", "session_date", "status", "recency").collect()
    want = {}
    for x in sorted(ranked, key=lambda x: x.recency):
        want.setdefault(x.member_id, []).append((x.session_date, x.status))
    assert got == want and got["m02"][0] == (date(2026, 5, 31), "absent") and got["m03"][0] == (date(2026, 6, 1), "absent")


@pytest.mark.parametrize("kind", [events.OUTINGS, events.SERVICES], ids=lambda k: k.name)
def test_batches_of_events(spark, seed, kind):
    kept = standing.with_standing(seed, AS_OF, buckets=4)
    full = kept.with_tables(standing=None)
    old = [r[0] for r in getattr(seed, kind.events).select(kind.key).collect()]
    new = spark.createDataFrame([(1, "2026-06-01T10:00:00Z", None, None), (2, "2026-06-02", "x", None)], f"ord long, event_date string, details string, created_by string")
    lines = spark.createDataFrame([(1, "m11"), (1, "m12"), (2, "m17"), (2, "m18"), (2, "m17")], "ord long, member_id string")
    changes = spark.createDataFrame([(1, old[0], None, None), (2, old[1], None, " ")], "ord long, event_id string, event_date string, details string")
    empty = spark.createDataFrame([(1, "m22")], "ord long, member_id string")
    gone = spark.createDataFrame([(old[0],), ("none",)], f"{kind.key} string")
    for batch in (
        lambda m: events.create_events(m, kind, new, lines, AS_OF), lambda m: events.replace_event_members(m, kind, changes, empty, AS_OF),
        lambda m: events.delete_events(m, kind, gone, AS_OF),
    ):
        by_change, by_all = batch(kept), batch(full)
        same_standing(by_change.changed.standing, by_all.changed, "tallies")
        assert rows(by_change.model.members) == rows(by_all.model.members)


def test_deleted_members_leave_no_standing(spark, seed):
    kept = standing.with_standing(seed, AS_OF)
    after = registration.delete_members(kept, spark.createDataFrame([("m01",), ("m30",)], "member_id string")).model
    same_standing(after.standing, after)


def test_a_standing_goes_when_its_facts_do(seed):
    kept = standing.with_standing(seed, AS_OF)
    assert kept.with_tables(members=kept.members).standing is kept.standing
    assert kept.with_tables(marks=kept.marks).standing is None and seed.standing is None


def test_a_small_batch_reads_the_buckets_of_its_members(spark, tmp_path):
    """Of the stored coverage and of the marks, only folders that the batch touches are read."""
    from rollcall.sources.store import load, publish

    t, root = entry.Tables(spark, SF), str(tmp_path)
    kind = t.model.members.schema["member_id"].dataType
    publish(t.settled_morning, root, 1)
    stored = load(spark, root, member_id=kind)
    some = t.feed.where("seq = 250").limit(3).withColumn("status", F.lit("present")).withColumn("member_id", F.col("ord") % 100 + 1)
    touched = standing.standings(stored, some.select(standing.bucket_of(standing.BUCKETS), "member_id"))
    text = touched._jdf.queryExecution().executedPlan().toString()
    assert text.count("dynamicpruning") >= 3  # of the three tables of the standing, the buckets of these members
    outcome = marking.upsert_marks(stored, some, entry.AS_OF, entry.TODAY, entry.DAILY)
    text = outcome.rows["marks"]._jdf.queryExecution().executedPlan().toString()
    # what is merged is already there; the session's folder was read for it alone
    assert text.count("Scan parquet") == 1 and "session_id=" not in text
    moved = outcome.settle_rows(outcome.changed)[1]["members"]
    assert moved.count() <= 3
