"""The fixture against its worked-out values."""

import pytest

from rollcall.functions.columns import rotation_topic
from rollcall.model import Calendar
from rollcall.operators import events, logs, members, reports
from rollcall.plans import progress, refresh
from tests.seed import OUTINGS, SERVICES, number


def numbers(df):
    return sorted(number(r.member_id) for r in df.collect())


def test_summary_of_the_raw_fixture(seed):
    row = reports.fixture_summary(refresh.observe(seed)).first()
    assert row.asDict() == {
        "members": 50, "studying": 26, "working": 24, "active_level1": 29, "inactive_level1": 11, "promoted": 10,
        "outing_only": 6, "service_only": 6, "both_missing_topics": 7,
    }


def test_inactive_after_refresh(prepared):
    rows = {number(r.member_id): (r.topic_name, r.session_date) for r in reports.inactive_report(prepared).collect()}
    assert rows == {
        29: ("Karma", "2026-05-03"), 39: ("Yoga", "2026-04-19"), 42: ("Self Management", "2026-04-12"),
        43: ("Karma", "2026-05-03"), 41: (None, None), 44: (None, None),
    }


def test_nobody_is_newly_promoted(seed, prepared):
    levels = {r.member_id: r.level for r in seed.members.collect()}
    assert {r.member_id: r.level for r in prepared.profile.collect()} == levels


def test_promoted_report(prepared):
    rows = reports.promoted_report(prepared).collect()
    assert [number(r.member_id) for r in rows] == list(range(1, 11))
    for r in rows:
        dates = [str(d) for d, ms in OUTINGS.items() if number(r.member_id) in ms]
        assert r.outing_date == max(dates)


def test_eligible_and_not_eligible(prepared):
    assert numbers(reports.eligible_report(prepared)) == [*range(11, 31), *range(46, 51)]
    assert numbers(reports.eligible_report(prepared, "not_eligible")) == list(range(31, 46))
    # any other status means eligible
    assert numbers(reports.eligible_report(prepared, "anything")) == [*range(11, 31), *range(46, 51)]


def test_yet_to(prepared):
    assert numbers(reports.yet_to_outing(prepared)) == [*range(17, 23), 29, 30, 47, 49, 50]
    assert numbers(reports.yet_to_service(prepared)) == [*range(11, 17), *range(29, 47), 49, 50]


def test_missing_by_topic(prepared):
    counts = [r.missing_count for r in reports.missing_counts_by_topic(prepared).collect()]
    assert counts == [14, 15, 15, 14, 16, 15, 15, 13]
    rows = reports.missing_by_topic(prepared).collect()
    assert len(rows) == sum(counts)
    first = [r.full_name for r in rows if r.order_index == 1]
    assert first == sorted(first) and len(first) == 14


def test_attendance_summary(seed):
    rows = logs.attendance_summary(seed).collect()
    assert len(rows) == 40 and {r.total_sessions for r in rows} == {8}
    shares = [r.attendance_percentage for r in rows]
    assert sum(shares) / 40 == 63.4375
    assert set(shares) <= {0, 12.5, 25, 37.5, 50, 75, 87.5, 100}
    part = logs.attendance_summary(seed, "2026-04-12", "2026-04-26").collect()
    assert {r.total_sessions for r in part} == {3}


def test_all_members_report(prepared):
    rows = {number(r.member_id): r for r in reports.all_members_report(prepared).collect()}
    assert len(rows) == 50 and {len(r.topics) for r in rows.values()} == {8}
    assert [t.order_index for t in rows[23].topics] == list(range(1, 9))
    assert [t.status for t in rows[23].topics] == ["Attended", "Not Attended"] + ["Attended"] * 6
    r = rows[29]
    assert (r.outing, r.service, r.activity_status, r.promotion_status) == (
        "Not Attended", "Not Done", "Inactive", "Not Promoted",
    )
    assert rows[1].promotion_status == "Promoted"


def test_event_lists(seed):
    outings = events.list_outings(seed).collect()
    assert [(r.outing_date, r.participant_count, r.is_locked) for r in outings] == [
        ("2026-05-24", 15, False), ("2026-04-26", 9, False),
    ]
    assert [r.participant_count for r in events.list_services(seed).collect()] == [16, 8]
    people = events.event_participants(seed, events.SERVICES).collect()
    assert [number(r.member_id) for r in people[:16]] == sorted(SERVICES[max(SERVICES)])


def test_stage2(seed):
    assert numbers(logs.stage2_members(seed)) == list(range(1, 11))
    history = logs.stage2_member_history(seed, seed.members).collect()
    marks = {(r.member_id, r.session_date, r.status) for r in logs.stage2_member_marks(seed).collect()}
    implied = {r.member_id: (r.marked, r.implied_absences) for r in logs.stage2_member_absences(seed).collect()}
    assert marks <= {(r.member_id, r.session_date, r.status) for r in history}
    assert sum(m for m, _ in implied.values()) == len(marks)
    assert sum(m + a for m, a in implied.values()) == len(history)
    present = [sum(r.status == "present" and r.session_date == d for r in history) for d in ["2026-05-17", "2026-05-24", "2026-05-31"]]
    assert len(history) == 30 and present == [7, 6, 7]
    assert [r.session_date for r in logs.stage2_sessions(seed).collect()] == ["2026-05-31", "2026-05-24", "2026-05-17"]
    assert logs.stage2_marks(seed, session_date="2026-05-24").count() == 10
    assert logs.stage2_member_by_id(seed, "m03").count() == 1 and logs.stage2_member_by_id(seed, "m30").count() == 0


@pytest.mark.parametrize(
    "day, topic",
    [
        ("2026-04-12", "The Real Freedom"), ("2026-04-19", "Self Management"), ("2026-04-26", "Yoga"),
        ("2026-05-03", "Relationship"), ("2026-05-10", "Karma"), ("2026-05-17", "Diet For Happiness"),
        ("2026-05-24", "Habits For Happiness"), ("2026-05-31", "The Perfect Knowledge"),
        ("2026-06-07", "The Real Freedom"), ("2026-06-08", None), ("2020-01-05", "Self Management"),
    ],
)
def test_rotation(spark, day, topic):
    from pyspark.sql import functions as F

    rows = spark.range(1).select(rotation_topic(F.lit(day).cast("date"), Calendar()).alias("t"))
    assert rows.first().t == topic


def test_details_of_one_member(seed):
    row = members.member_details(refresh.observe(seed)).where("member_id = 'm27'").first()
    assert row.member.full_name == "Member 27" and row.member.level == 1
    assert [s.status for s in row.sessions].count("absent") == 2
    # an absentee still gets the last date the topic was held
    assert row.sessions[0].status == "absent" and row.sessions[0].attended_on == "2026-04-12"
    assert row.sessions[0].attended_dates == [] and row.sessions[0].last_attended_on is None
    assert [o.outing_date for o in row.outings] == ["2026-05-24"]
    assert [s.service_date for s in row.services] == ["2026-04-20"]
    assert row.promotion_status.missing == ["Needs to attend 2 more classes"]


def test_promotion_status_texts(seed):
    rows = {number(r.member_id): r for r in members.promotion_status(refresh.observe(seed)).collect()}
    assert rows[1].summary == "Promoted" and rows[1].promoted
    assert rows[23].missing == ["Needs to attend 1 more class"]
    assert rows[41].summary == "Needs to attend 8 more classes, Needs to attend one trip, Needs to volunteer once"


def test_latest_status_and_lists(seed, prepared):
    latest = {number(r.member_id): r.latest_status for r in progress.latest_status(seed).collect()}
    assert latest[30] == "present" and latest[26] == "absent" and len(latest) == 50
    assert numbers(members.list_members(prepared, active=False)) == [29, 39, 41, 42, 43, 44]
    assert len(numbers(members.list_members(prepared, include_promoted=True))) == 50
    assert numbers(members.list_members(prepared, eligible_for_outing=True)) == [*range(11, 31), *range(46, 51)]
    assert members.member_by_id(seed.members, "m07").first().full_name == "Member 07"
    names = [r.full_name for r in members.list_members(prepared, collation="UNICODE").collect()]
    assert names == sorted(names)


def test_logs(seed):
    assert logs.list_marks(seed).count() == 400
    one = logs.list_marks(seed, session_date="2026-05-31").collect()
    assert len(one) == 50 and one[0].marked_by_name == "Administrator"
    assert [r.member_name for r in one] == sorted(r.member_name for r in one)
    assert logs.list_marks(seed, session_id="2026-04-12", ordered=False).count() == 50
    assert [r.session_date for r in logs.list_sessions(seed, "2026-05-01", "2026-05-17").collect()] == [
        "2026-05-17", "2026-05-10", "2026-05-03",
    ]

