"""Properties that must hold on any data."""

import __spark_entry__ as entry
from rollcall.functions.columns import percentage
from rollcall.operators import marking, reports
from rollcall.plans import progress, refresh
from rollcall.plans.keyed import keep_last, upsert
from tests.conftest import SF

from pyspark.sql import functions as F


def tables(spark):
    return entry.Tables(spark, SF)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_refresh_is_idempotent(spark):
    once = refresh.refresh(tables(spark).model, entry.AS_OF)
    twice = refresh.refresh(once, "2030-01-01 00:00:00")
    assert rows(twice.members) == rows(once.members)
    assert rows(twice.stage2_roster) == rows(once.stage2_roster)


def test_promotion_is_monotone(spark):
    model = tables(spark).model
    before = {r.member_id: r.level for r in model.members.collect()}
    after = {r.member_id: r.level for r in refresh.refresh(model, entry.AS_OF).members.collect()}
    assert all(after[m] >= before[m] for m in before)


def test_refreshing_everyone_is_the_full_rule_for_members_with_marks(spark):
    model = tables(spark).model
    everyone = model.members.select("member_id")
    marked = {r.member_id for r in model.marks.select("member_id").distinct().collect()}
    full = {r.member_id: r.active for r in refresh.activity_status(model).collect() if r.member_id in marked}
    some = {r.member_id: r.active for r in refresh.activity_refresh(model, everyone).collect() if r.member_id in marked}
    assert full == some


def test_eligible_and_not_eligible_split_level_1(spark):
    state = tables(spark).prepared()
    yes = {r.member_id for r in reports.eligible_report(state).collect()}
    no = {r.member_id for r in reports.eligible_report(state, "not_eligible").collect()}
    level1 = {r.member_id for r in state.profile.where("level = 1").collect()}
    assert not yes & no and yes | no == level1


def test_one_mark_per_session_and_member_after_a_feed(spark):
    t = tables(spark)
    marks = marking.upsert_marks(t.morning, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY).changed.marks
    assert marks.groupBy("session_id", "member_id").count().where("count > 1").count() == 0


def test_a_feed_taken_twice_is_taken_once(spark):
    t = tables(spark)
    once = marking.upsert_marks(t.morning, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY).changed
    twice = marking.upsert_marks(once, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY).changed
    assert rows(twice.marks) == rows(once.marks)


def test_percentage_matches_exact_half_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    pairs = [(p, n) for n in range(1, 60) for p in range(n + 1)]
    got = spark.createDataFrame(pairs, "p long, n long").select("p", "n", percentage(F.col("p"), F.col("n")).alias("x"))
    for r in got.collect():
        want = (Decimal(r.p) * 100 / Decimal(r.n)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r.x == float(want)
    assert spark.range(1).select(percentage(F.lit(0), F.lit(0)).alias("x")).first().x == 0


def test_keep_last_and_upsert_against_brute_force(spark):
    data = [(i % 7, (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(data, "k long, o long, v long")
    want = {}
    for k, o, v in data:
        if k not in want or (o, v) > want[k][:2]:
            want[k] = (o, v)
    kept = keep_last(df, ["k"], ["o", "v"])
    assert {r.k: (r.o, r.v) for r in kept.collect()} == want

    stored = spark.createDataFrame([(k, 0, -1) for k in range(3, 12)], "k long, o long, v long")
    merged = {r.k: (r.o, r.v) for r in upsert(stored, kept, ["k"], ["v"]).collect()}
    assert merged == {k: (0, want[k][1]) if 3 <= k < 7 else (0, -1) if k >= 7 else want[k] for k in range(12)}


def test_one_member_with_a_third_of_the_marks(spark):
    """A hot member gives the same answers, and its marks are cut down before the shuffle."""
    model = tables(spark).model
    hot = spark.range(20000).select(
        F.concat(F.lit("x"), "id").alias("mark_id"), F.date_add(F.lit("1950-01-01"), F.col("id").cast("int")).alias("d")
    )
    sessions = hot.select(
        F.col("d").cast("string").alias("session_id"), F.col("d").alias("session_date"),
        F.date_format("d", "EEEE").alias("day_of_week"), F.lit(None).cast("string").alias("topic_id"),
        F.lit(None).cast("string").alias("created_by"), F.lit(entry.AS_OF).cast("timestamp_ntz").alias("created_at"),
    )
    marks = hot.select(
        "mark_id", F.col("d").cast("string").alias("session_id"), F.lit(7).cast("bigint").alias("member_id"),
        F.lit("absent").alias("status"), F.lit(None).cast("string").alias("marked_by"), F.col("d").cast("timestamp_ntz").alias("marked_at"),
    )
    wide = model.with_tables(sessions=model.sessions.union(sessions), marks=model.marks.union(marks))
    own = {r.member_id: r for r in progress.mark_facts(model).collect()}
    got = {r.member_id: r for r in progress.mark_facts(wide).collect()}
    assert got[7].n_marks == own[7].n_marks + 20000 and got[7].n_topics == own[7].n_topics
    assert {m: r for m, r in got.items() if m != 7} == {m: r for m, r in own.items() if m != 7}
    before = {r.member_id: r.lapsed for r in progress.lapsed_members(model, refresh.Rules()).collect()}
    after = {r.member_id: r.lapsed for r in progress.lapsed_members(wide, refresh.Rules()).collect()}
    assert {m: x for m, x in after.items() if m != 7} == {m: x for m, x in before.items() if m != 7}
