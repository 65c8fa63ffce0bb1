"""Batch writes to members: validate, create, patch, set active, delete with cascade.

Requests carry raw text, one row per request, with a unique `ord` that gives their order.
A batch is checked against the tables as they were before it; inside the batch the
earliest sound request wins a phone number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import blank, exact_number, first_reason, number, trimmed, whole_number
from rollcall.functions.values import MEMBER_TYPES, PROFILE_COLUMNS
from rollcall.model import EXPERIENCE, MEMBER_COLUMNS, Model
from rollcall.operators.outcome import Outcome
from rollcall.plans.keyed import first_claims, flag_known, last_given, matched_keys, spread_key
from rollcall.plans.refresh import moment, roster_sync
from rollcall.plans.standing import members_removed
from rollcall.sources.lineage import cut_lineage

DUPLICATE_PHONE = "phone number is in use"
BAD_TYPE = "member_type is none of the known ones"
NO_DESCRIPTION = "not_studying_not_working needs a description"
NO_DESCRIPTION_STAGE2 = "a stage-2 member without studies or work needs a description"

#: For a number that the column could hold only by rounding or not at all.
TOO_LONG = "experience has more digits than can be kept"

Check = tuple[Column, str]


def _typed(member_type: str, failed: Column) -> Column:
    return (F.col("member_type") == member_type) & failed


def _missing_number(parsed: Column, sound: Column) -> Column:
    return ~F.coalesce(sound, F.lit(False)) | parsed.isNull()


def _name_and_phone_checks() -> list[Check]:
    return [
        (blank(F.col("full_name")), "no full_name given"),
        (blank(F.col("phone")), "no phone number given"),
    ]


def _detail_checks(no_description: str) -> list[Check]:
    age, semester, experience = (number(F.col(c)) for c in ["age", "semester", "experience"])
    known_type = F.coalesce(F.col("member_type").isin(MEMBER_TYPES), F.lit(False))
    return [
        (_missing_number(age, age > 0), "age is not above zero"),
        (~known_type, BAD_TYPE),
        (_typed("studying", blank(F.col("college_name"))), "studying needs a college_name"),
        (_typed("studying", blank(F.col("branch"))), "studying needs a branch"),
        (_typed("studying", _missing_number(semester, semester > 0)), "semester is not above zero"),
        (_typed("working", blank(F.col("company_name"))), "working needs a company_name"),
        (_typed("working", blank(F.col("designation"))), "working needs a designation"),
        (_typed("working", _missing_number(experience, experience >= 0)), "experience is below zero"),
        (_typed("not_studying_not_working", blank(F.col("description"))), no_description),
        # a fraction passes the checks above but has no place in a whole-number column
        (whole_number(F.col("age")).isNull(), "age is no whole number"),
        (_typed("studying", whole_number(F.col("semester")).isNull()), "semester is no whole number"),
        (_typed("working", exact_number(F.col("experience"), EXPERIENCE).isNull()), TOO_LONG),
    ]


def _clean_profile() -> dict[str, Column]:
    """Profile columns of the row's own type, trimmed and typed; those of other types null."""
    parse = {
        "semester": whole_number(F.col("semester")),
        "experience": exact_number(F.col("experience"), EXPERIENCE),
    }
    return {
        column: F.when(F.col("member_type") == kind, parse.get(column, trimmed(F.col(column))))
        for kind, columns in PROFILE_COLUMNS.items()
        for column in columns
    }


@dataclass(frozen=True)
class Checked:
    valid: DataFrame
    rejected: DataFrame


def _judged_alone(requests: DataFrame, no_description: str) -> DataFrame:
    """Add `early` and `detail`: the first failing rule before and after the phone check."""
    return requests.withColumns(
        {"early": first_reason(*_name_and_phone_checks()), "detail": first_reason(*_detail_checks(no_description))}
    )


def validate_members(requests: DataFrame, no_description: str = NO_DESCRIPTION) -> Checked:
    """The rules of one request alone; the first failing one is the reason."""
    rows = _judged_alone(requests, no_description)
    return _checked(rows.withColumn("reason", F.coalesce("early", "detail")), requests.columns)


def _sound(rows: DataFrame) -> DataFrame:
    """Requests that fail no rule by themselves and whose phone number is free."""
    return rows.where(F.col("early").isNull() & F.col("detail").isNull() & ~F.col("taken"))


def _checked(rows: DataFrame, columns: list[str]) -> Checked:
    rejected = rows.where(F.col("reason").isNotNull()).select(*columns, "reason")
    valid = rows.where(F.col("reason").isNull()).withColumns(
        {
            "full_name": trimmed(F.col("full_name")),
            "phone": trimmed(F.col("phone")),
            "age": whole_number(F.col("age")),
            **_clean_profile(),
        }
    )
    return Checked(valid.select(*columns), rejected)


def _phone_key(order: str) -> Column:
    return spread_key(F.nullif(trimmed(F.col("phone")), F.lit("")), order)


def check_registrations(
    requests: DataFrame, members: DataFrame, no_description: str = NO_DESCRIPTION
) -> Checked:
    """All rules in order, with the phone number unique over members and batch."""
    rows = _judged_alone(requests, no_description).withColumn("phone_key", _phone_key("ord"))
    held = members.where(F.col("phone").isNotNull()).select(F.concat(F.lit("="), "phone").alias("phone_key"))
    # judged once; the claims and the verdicts both read them
    rows = cut_lineage(flag_known(rows, held, ["phone_key"], "taken"))
    claims = first_claims(_sound(rows).withColumn("owner", F.col("ord")), "phone_key", "ord", "owner")
    rows = rows.join(claims, "phone_key", "left")
    duplicate = F.when(F.col("taken") | (F.col("claimed_by") < F.col("ord")), F.lit(DUPLICATE_PHONE))
    return _checked(rows.withColumn("reason", F.coalesce("early", duplicate, "detail")), requests.columns)


def duplicate_phone(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests turned away because their phone number is in use."""
    return check_registrations(requests, members).rejected.where(F.col("reason") == DUPLICATE_PHONE)


def _as_members(valid: DataFrame, members: DataFrame, level: int, promoted_at: Column, as_of: str) -> DataFrame:
    """Valid requests as member rows. Without a `member_id` column the id follows from the phone."""
    if "member_id" not in valid.columns:
        valid = valid.withColumn("member_id", F.sha2(F.col("phone"), 256))
    rows = valid.withColumns(
        {
            "email": F.lit(None).cast("string"),
            "active": F.lit(True),
            "level": F.lit(level),
            "promoted_at": promoted_at,
            "created_at": moment(as_of),
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in members.select(*MEMBER_COLUMNS).schema.fields])


def create_members(model: Model, requests: DataFrame, as_of: str) -> Outcome:
    checked = check_registrations(requests, model.members)
    added = _as_members(checked.valid, model.members, 1, F.lit(None).cast("timestamp_ntz"), as_of)
    return Outcome(model.with_tables(members=model.members.unionByName(added)), checked.rejected)


def create_stage2_members(model: Model, requests: DataFrame, as_of: str) -> Outcome:
    """As `create_members`, at level 2 from the start and with a roster row."""
    checked = check_registrations(requests, model.members, NO_DESCRIPTION_STAGE2)
    added = _as_members(checked.valid, model.members, 2, moment(as_of), as_of)
    changed = model.with_tables(
        members=model.members.unionByName(added),
        stage2_roster=roster_sync(model.stage2_roster, added, as_of),
    )
    return Outcome(changed, checked.rejected)


# --- patch -------------------------------------------------------------------------

_PATCH_PROFILE = [c for columns in PROFILE_COLUMNS.values() for c in columns]


def _patch_checks() -> list[Check]:
    """The rules after those for the phone number."""
    given = {c: F.col(c).isNotNull() for c in ["phone", "age", "member_type", *_PATCH_PROFILE]}
    age, semester, experience = (number(F.col(c)) for c in ["age", "semester", "experience"])
    any_profile = F.lit(False)
    for column in _PATCH_PROFILE:
        any_profile = any_profile | given[column]

    def blank_text(kind: str, column: str) -> Check:
        return _typed(kind, given[column] & blank(F.col(column))), f"{kind} needs a {column}"

    return [
        (given["age"] & _missing_number(age, age > 0), "age is not above zero"),
        (given["member_type"] & ~F.col("member_type").isin(MEMBER_TYPES), BAD_TYPE),
        (any_profile & ~given["member_type"], "profile columns come without a member_type"),
        blank_text("studying", "college_name"),
        blank_text("studying", "branch"),
        (
            _typed("studying", given["semester"] & _missing_number(semester, semester > 0)),
            "semester is not above zero",
        ),
        blank_text("working", "company_name"),
        blank_text("working", "designation"),
        (
            _typed("working", given["experience"] & _missing_number(experience, experience >= 0)),
            "experience is below zero",
        ),
        (_typed("not_studying_not_working", blank(F.col("description"))), NO_DESCRIPTION),
        (given["age"] & whole_number(F.col("age")).isNull(), "age is no whole number"),
        (given["semester"] & whole_number(F.col("semester")).isNull(), "semester is no whole number"),
        (given["experience"] & exact_number(F.col("experience"), EXPERIENCE).isNull(), TOO_LONG),
        (~F.col("found"), "member not found"),
    ]


def patch_members(model: Model, patches: DataFrame) -> Outcome:
    """Sparse update; a null keeps the old value.

    Giving a type sets that type's profile columns to what the patch gives, even when
    that is nothing, and clears the columns of the other types. Of several patches to one
    member, the last typed one decides the profile, and each other column takes its last
    given value.
    """
    rows = cut_lineage(flag_known(patches.withColumn("phone_key", _phone_key("ord")), model.members, ["member_id"], "found"))
    holders = model.members.where(F.col("phone").isNotNull()).select(
        F.concat(F.lit("="), "phone").alias("phone_key"), F.col("member_id").alias("held_by")
    )
    asked = rows.where(F.col("phone_key").startswith("=")).select("phone_key").distinct()
    holders = holders.join(asked, "phone_key", "left_semi")
    # who holds the number: two bounds per number are enough to see a holder other than the patched one
    holders = holders.groupBy("phone_key").agg(F.min("held_by").alias("low_"), F.max("held_by").alias("high_"))
    rows = rows.join(holders, "phone_key", "left").withColumn(
        "taken",
        F.coalesce((F.col("low_") != F.col("member_id")) | (F.col("high_") != F.col("member_id")), F.lit(False)),
    )
    blank_phone = F.col("phone").isNotNull() & blank(F.col("phone"))
    rows = rows.withColumns(
        {"early": first_reason((blank_phone, "no phone number given")), "detail": first_reason(*_patch_checks())}
    )
    rows = cut_lineage(rows)
    rows = rows.join(first_claims(_sound(rows), "phone_key", "ord", "member_id"), "phone_key", "left")
    duplicate = F.col("taken") | F.coalesce(F.col("claimed_by") != F.col("member_id"), F.lit(False))
    rows = rows.withColumn("reason", F.coalesce("early", F.when(duplicate, F.lit(DUPLICATE_PHONE)), "detail"))
    rejected = rows.where(F.col("reason").isNotNull()).select(*patches.columns, "reason")

    parse = {
        "semester": whole_number(F.col("semester")),
        "experience": exact_number(F.col("experience"), EXPERIENCE),
        "description": trimmed(F.col("description")),
    }
    sound = rows.where(F.col("reason").isNull()).select(
        "member_id", "ord", "full_name", "phone", "member_type",
        whole_number(F.col("age")).alias("age"),
        F.struct(*[parse.get(c, F.col(c)).alias(c) for c in _PATCH_PROFILE]).alias("details"),
    )
    typed_ord = F.when(F.col("member_type").isNotNull(), F.col("ord"))
    changes = sound.groupBy("member_id").agg(
        *[last_given(c, "ord").alias(f"new_{c}") for c in ["full_name", "phone", "age", "member_type"]],
        F.max_by("details", typed_ord).alias("details"),
    )
    merged = model.members.join(changes, "member_id", "left")
    new_type = F.col("new_member_type")
    updated = {c: F.coalesce(f"new_{c}", c) for c in ["full_name", "phone", "age", "member_type"]}
    for kind, columns in PROFILE_COLUMNS.items():
        for column in columns:
            updated[column] = (
                F.when(new_type == kind, F.col(f"details.{column}"))
                .when(new_type.isNull(), F.col(column))
            )
    return Outcome(
        model.with_tables(members=merged.withColumns(updated).select(*MEMBER_COLUMNS)), rejected
    )


def set_active(model: Model, requests: DataFrame) -> Outcome:
    """Overwrite `active`; the last request per member (by `ord`) wins."""
    rows = flag_known(requests, model.members, ["member_id"], "found").withColumn(
        "reason",
        first_reason((F.col("active").isNull(), "active is required"), (~F.col("found"), "member not found")),
    )
    changes = (
        rows.where(F.col("reason").isNull())
        .groupBy("member_id")
        .agg(F.max_by("active", "ord").alias("new_active"))
    )
    members = model.members.join(changes, "member_id", "left").withColumn("active", F.coalesce("new_active", "active"))
    rejected = rows.where(F.col("reason").isNotNull()).select(*requests.columns, "reason")
    return Outcome(model.with_tables(members=members.select(*MEMBER_COLUMNS)), rejected)


# --- delete ------------------------------------------------------------------------

CASCADE = ["members", "marks", "outing_members", "service_members", "stage2_roster", "stage2_marks"]


@dataclass(frozen=True)
class Deletion:
    model: Model
    removed: DataFrame
    rejected: DataFrame
    ids: DataFrame

    @property
    def outcome(self) -> Outcome:
        """As the outcome of a batch write: a store needs no more than the ids."""
        tables = [*CASCADE, *[f"standing_{name}" for name in (self.model.standing.tables() if self.model.standing else [])]]
        return Outcome(self.model, self.rejected, removed=dict.fromkeys(tables, self.ids))


def delete_members(model: Model, ids: DataFrame) -> Deletion:
    """Delete members with all their rows; `removed` counts the marks deleted per member."""
    ids = ids.select("member_id").distinct()
    found = matched_keys(model.members, ids, ["member_id"])
    counts = (
        model.marks.join(ids, "member_id", "left_semi")
        .groupBy("member_id")
        .agg(F.count(F.lit(1)).alias("attendance_removed"))
    )
    removed = found.join(counts, "member_id", "left").withColumn(
        "attendance_removed", F.coalesce("attendance_removed", F.lit(0).cast("bigint"))
    )
    stored = {name: getattr(model, name) for name in CASCADE}
    tables = {name: rows.join(ids, "member_id", "left_anti").select(*rows.columns) for name, rows in stored.items()}
    standing = members_removed(model.standing, ids) if model.standing else None
    rejected = ids.join(found, "member_id", "left_anti").withColumn("reason", F.lit("member not found"))
    return Deletion(model.with_tables(**tables, standing=standing), removed, rejected, ids)
