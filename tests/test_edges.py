"""Edge cases of the rules; the S-numbers are those of the survey."""

from datetime import date, datetime, timedelta

import pytest

from rollcall.functions.values import TOPICS
from rollcall.operators import events, logs, members, reports
from rollcall.plans import progress, refresh
from rollcall.sources.store import load, publish
from tests.conftest import AS_OF
from tests.seed import (
    CREATED, SESSION_DATES, at, mark_row, member_row, model_from, number, seed_rows, session_row, topic_row,
)


def numbers(df):
    return sorted(number(r.member_id) for r in df.collect())


@pytest.fixture(scope="module")
def edge_rows():
    """The fixture plus the rows that each rule has trouble with."""
    rows = seed_rows()
    rows["members"] += [
        member_row(51),  # no marks at all
        member_row(52),  # three marks, all absent
        member_row(53, level=2, promoted_at=CREATED),  # created at level 2, no marks
        member_row(54, member_type="not_studying_not_working", description="Preparing"),
        member_row(55),  # present only at the session without a topic
    ]
    extra = date(2026, 6, 7)
    rows["sessions"].append(session_row(extra, topic_id=None))
    rows["marks"] += [mark_row(str(d), "m52", "absent", at(d, 9)) for d in SESSION_DATES[:3]]
    rows["marks"] += [mark_row(str(d), "m55", "absent", at(d, 9)) for d in SESSION_DATES[4:]]
    rows["marks"].append(mark_row(str(extra), "m55", "present", at(extra, 9)))
    rows["outings"].append(
        {"outing_id": "empty", "outing_date": date(2026, 6, 1), "details": None, "created_by": None, "created_at": CREATED}
    )
    return rows


@pytest.fixture(scope="module")
def edge(spark, edge_rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("edge"))
    publish(model_from(spark, edge_rows), root, 1)
    return load(spark, root)


def test_s1_and_s18_absentees_have_dates(edge):
    row = members.member_topic_progress(edge).where("member_id = 'm51' and order_index = 8").first()
    assert (row.status, row.attended_on, row.last_attended_on) == ("absent", "2026-05-31", None)
    after = refresh.refresh(edge, AS_OF)
    history = logs.stage2_member_history(after, after.members.where("member_id = 'm53'")).collect()
    assert [r.status for r in history] == ["absent"] * 3 and history[0].marked_at is None


def test_s2_created_at_level_2_is_not_in_the_promoted_report(edge):
    state = refresh.prepare(edge, AS_OF)
    assert 53 not in numbers(reports.promoted_report(state))
    assert 53 in numbers(logs.stage2_members(state.settled(AS_OF)))


def test_s2_losing_an_outing_leaves_level_but_not_the_report(spark, edge_rows):
    rows = {**edge_rows, "outing_members": [r for r in edge_rows["outing_members"] if r["member_id"] != "m01"]}
    state = refresh.prepare(model_from(spark, rows), AS_OF)
    assert 1 not in numbers(reports.promoted_report(state))
    assert state.profile.where("member_id = 'm01'").first().level == 2


def test_s3_yet_to_service_has_no_level_filter(edge):
    state = refresh.prepare(edge, AS_OF)
    assert 53 in numbers(reports.yet_to_service(state)) and 53 not in numbers(reports.yet_to_service(state, level=1))


def test_s4_no_level_1_member(spark, edge_rows):
    rows = {**edge_rows, "members": [m for m in edge_rows["members"] if m["level"] == 2]}
    state = refresh.prepare(model_from(spark, rows), AS_OF)
    assert reports.missing_by_topic(state).count() == 0 and reports.missing_counts_by_topic(state).count() == 0


def test_s4_no_topics(spark, edge_rows):
    state = refresh.observe(model_from(spark, {**edge_rows, "topics": []}))
    assert reports.all_members_report(state).count() == 0
    assert refresh.promotion_eligible(model_from(spark, {**edge_rows, "topics": []})).count() == 0


def test_s6_few_marks_are_active(edge):
    active = {number(r.member_id): r.active for r in refresh.activity_status(edge).collect()}
    assert active[51] and active[52] and not active[41]


def test_s7_manual_status_is_undone_at_level_1_only(spark, edge_rows):
    rows = {**edge_rows, "members": [{**m, "active": False} for m in edge_rows["members"]]}
    active = {number(r.member_id): r.active for r in refresh.activity_status(model_from(spark, rows)).collect()}
    assert active[51] and not active[53]


def test_s8_session_without_topic_counts_for_activity_only(edge):
    state = refresh.prepare(edge, AS_OF)
    row = state.profile.where("member_id = 'm55'").first()
    assert row.active and row.n_topics == 0
    assert 55 not in numbers(progress.topic_coverage(edge))
    untopical = logs.list_sessions(edge).first()
    assert (untopical.session_date, untopical.topic_id, untopical.topic_name) == ("2026-06-07", None, None)


def test_s9_a_ninth_topic_raises_the_bar(spark, edge_rows):
    rows = {**edge_rows, "topics": [*edge_rows["topics"], topic_row("Extra", 9)]}
    assert refresh.promotion_eligible(model_from(spark, rows)).count() == 0


def test_no_promotion_before_the_last_part_and_then_promotion(spark, edge_rows):
    late = {"outing_id": "empty", "member_id": "m17", "added_at": CREATED}
    rows = {**edge_rows, "outing_members": [*edge_rows["outing_members"], late]}
    model = refresh.refresh(model_from(spark, rows), AS_OF)
    row = model.members.where("member_id = 'm17'").first()
    assert (row.level, row.promoted_at) == (2, datetime(2026, 6, 1, 9))
    assert 17 in numbers(model.stage2_roster)


def test_s19_complete_but_level_1_reads_eligible(spark, edge_rows):
    rows = {**edge_rows, "members": [{**m, "level": 1} for m in edge_rows["members"]]}
    status = members.promotion_status(refresh.observe(model_from(spark, rows)))
    assert status.where("member_id = 'm01'").first().summary == "Eligible for promotion"


def test_event_without_members(edge):
    first = events.list_outings(edge).first()
    assert (first.outing_id, first.participant_count) == ("empty", 0)


@pytest.mark.parametrize("extra", [0, 55, 56, 192])
def test_any_number_of_topics(spark, edge_rows, extra):
    """8, 63, 64 and 200 topics go through the same plan: counts and reports against plain counting."""
    many = [topic_row(f"Topic {i:03d}", 100 + i) for i in range(extra)]
    days = [date(2019, 1, 6) + timedelta(weeks=i) for i in range(extra)]
    rows = {
        **edge_rows,
        "topics": [*edge_rows["topics"], *many],
        "sessions": [*edge_rows["sessions"], *[session_row(d, topic_id=t["topic_id"]) for d, t in zip(days, many, strict=True)]],
        "marks": [*edge_rows["marks"], *[mark_row(str(d), "m51", "present", at(d, 9)) for d in days[: extra - 4]]],
    }
    topic_of = {s["session_id"]: s["topic_id"] for s in rows["sessions"]}
    known, want = {t["topic_id"] for t in rows["topics"]}, {m["member_id"]: set() for m in rows["members"]}
    for mark in rows["marks"]:
        if mark["status"] == "present" and topic_of[mark["session_id"]] in known:
            want[mark["member_id"]].add(topic_of[mark["session_id"]])
    model = model_from(spark, rows)
    profile = refresh.observe(model).profile.collect()
    assert {r.member_id: r.n_topics for r in profile} == {i: len(t) for i, t in want.items()}
    assert {r.member_id: set(r.attended or ()) for r in profile} == want
    assert len(want["m51"]) == max(0, extra - 4)
    report = reports.all_members_report(refresh.prepare(model, AS_OF)).where("member_id = 'm51'").first()
    assert [t.status for t in report.topics].count("Attended") == len(want["m51"]) and len(report.topics) == 8 + extra
    assert reports.missing_counts_by_topic(refresh.prepare(model, AS_OF)).count() == 8 + extra


def test_ensure_topics_repairs_order_and_keeps_extras(spark, edge_rows):
    broken = [topic_row("Yoga", 99) | {"topic_id": "kept"}, topic_row("Extra", 9)]
    model = model_from(spark, {**edge_rows, "topics": broken})
    rows = {r.name: r for r in refresh.with_topics(model, AS_OF).topics.collect()}
    assert set(rows) == {*TOPICS, "Extra"}
    assert (rows["Yoga"].topic_id, rows["Yoga"].order_index, rows["Extra"].order_index) == ("kept", 2, 9)
    assert refresh.with_topics(model_from(spark, edge_rows), AS_OF).topics.count() == 8
