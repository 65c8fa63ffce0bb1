"""The designed fixture: 50 members in cohorts, 8 sessions, 3 stage-2 sessions.

Fixed values: which sessions each member was present at, and who took part in what.
"""

from datetime import date, datetime, timedelta
from decimal import Decimal

from rollcall.functions.values import TOPICS
from rollcall.model import Model, schemas

SESSION_DATES = [date(2026, 4, 12) + timedelta(weeks=i) for i in range(8)]
STAGE2_DATES = SESSION_DATES[5:]
EVERY = set(range(8))

PRESENT = {m: EVERY for m in [*range(1, 23), 49, 50]}
PRESENT |= {23: EVERY - {1}, 24: EVERY - {3}, 25: EVERY - {5}, 26: EVERY - {7}}
PRESENT |= {27: EVERY - {0, 6}, 28: EVERY - {2, 4}, 46: EVERY - {2, 6}, 47: EVERY - {1, 5}, 48: EVERY - {0, 4}}
PRESENT |= {29: {0, 1, 2, 3}, 30: {4, 5, 6, 7}}
PRESENT |= {31: {0, 2, 5}, 32: {1, 3, 6}, 33: {2, 4, 7}, 34: {0, 5, 7}}
PRESENT |= {35: {1, 4}, 36: {3, 6}, 37: {0, 7}, 38: {2, 5}}
PRESENT |= {39: {1}, 40: {6}, 42: {0}, 43: {3}, 45: {7}, 41: set(), 44: set()}

PROMOTED = set(range(1, 11))
INACTIVE = PROMOTED | {16, 21, 27, 35, 36, 41, 42, 43, 44, 45, 50}
STUDYING = {1, 2, 5, 7, 9, *range(11, 46, 2), 46, 48, 50}

OUTINGS = {
    date(2026, 5, 24): {1, 2, 4, 6, 7, 9, 10, 11, 13, 15, 23, 25, 27, 28, 46},
    date(2026, 4, 26): {3, 5, 8, 12, 14, 16, 24, 26, 48},
}
SERVICES = {
    date(2026, 5, 30): {1, 2, 3, 6, 8, 9, 10, 17, 19, 21, 22, 23, 25, 26, 28, 47},
    date(2026, 4, 20): {4, 5, 7, 18, 20, 24, 27, 48},
}
STAGE2 = {
    1: ["present", "present", "present"],
    2: ["present", "absent", "present"],
    3: ["absent", "present", "present"],
    4: ["present", "present", "absent"],
    5: ["present", "present", "present"],
    6: ["absent", "absent", "present"],
    7: ["present", "absent", "absent"],
    8: ["present", "present", "present"],
    9: ["absent", "present", "absent"],
    10: ["present", "absent", "present"],
}

CREATED = datetime(2026, 4, 1)


def member_id(number: int) -> str:
    return f"m{number:02d}"


def at(day: date, hour: int) -> datetime:
    return datetime(day.year, day.month, day.day, hour)


def member_row(number: int, **changes) -> dict:
    studying = number in STUDYING
    row = {
        "member_id": member_id(number),
        "full_name": f"Member {number:02d}",
        "email": None,
        "phone": f"900100{number:04d}",
        "age": 19 + number % 6,
        "member_type": "studying" if studying else "working",
        "college_name": "City College" if studying else None,
        "branch": "Science" if studying else None,
        "semester": number % 8 + 1 if studying else None,
        "company_name": None if studying else "Works",
        "designation": None if studying else "Analyst",
        "experience": None if studying else Decimal("1.75"),
        "description": None,
        "active": number not in INACTIVE,
        "level": 2 if number in PROMOTED else 1,
        "promoted_at": datetime(2026, 5, 31, 18) if number in PROMOTED else None,
        "created_at": CREATED,
    }
    return row | changes


def mark_row(session: str, member: str, status: str, when: datetime) -> dict:
    return {
        "mark_id": f"{session}|{member}", "session_id": session, "member_id": member, "status": status,
        "marked_by": "admin", "marked_at": when,
    }


def session_row(day: date, **more) -> dict:
    return {
        "session_id": str(day), "session_date": day, "day_of_week": day.strftime("%A"), "created_by": "admin",
        "created_at": CREATED, **more,
    }


def topic_row(name: str, order_index: int) -> dict:
    return {"topic_id": f"topic:{name}", "name": name, "order_index": order_index, "created_at": CREATED}


def _events(name: str, days: dict) -> tuple[list[dict], list[dict]]:
    events = [
        {f"{name}_id": str(d), f"{name}_date": d, "details": f"{name} {d}", "created_by": "admin", "created_at": CREATED}
        for d in days
    ]
    bridge = [
        {f"{name}_id": str(d), "member_id": member_id(m), "added_at": at(d, 10)} for d, ms in days.items() for m in sorted(ms)
    ]
    return events, bridge


def seed_rows() -> dict[str, list[dict]]:
    outings, outing_members = _events("outing", OUTINGS)
    services, service_members = _events("service", SERVICES)
    return {
        "members": [member_row(n) for n in range(1, 51)],
        "topics": [topic_row(name, i + 1) for i, name in enumerate(TOPICS)],
        "sessions": [session_row(d, topic_id=f"topic:{TOPICS[i]}") for i, d in enumerate(SESSION_DATES)],
        "marks": [
            mark_row(str(d), member_id(n), "present" if i in PRESENT[n] else "absent", at(d, 9))
            for i, d in enumerate(SESSION_DATES)
            for n in range(1, 51)
        ],
        "outings": outings,
        "outing_members": outing_members,
        "services": services,
        "service_members": service_members,
        "stage2_roster": [
            {"roster_id": f"roster:{member_id(n)}", "member_id": member_id(n), "added_at": CREATED} for n in sorted(PROMOTED)
        ],
        "stage2_sessions": [session_row(d) for d in STAGE2_DATES],
        "stage2_marks": [
            mark_row(str(d), member_id(n), STAGE2[n][i], at(d, 17))
            for i, d in enumerate(STAGE2_DATES)
            for n in sorted(PROMOTED)
        ],
        "markers": [{"marker_id": "admin", "name": "Administrator"}],
    }


def table(spark, name: str, rows: list[dict]):
    schema = schemas()[name]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def model_from(spark, rows: dict[str, list[dict]]) -> Model:
    return Model(**{name: table(spark, name, rows[name]) for name in Model.table_names()})


def seed_model(spark) -> Model:
    return model_from(spark, seed_rows())


def number(member: str) -> int:
    return int(member[1:])
