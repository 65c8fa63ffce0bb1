"""Outings and services: lists, and batch create, replace and delete.

Both are the same pair of tables: one row per date, and a bridge to members. A batch is
two tables: `requests` (one row per request, ordered by `ord`) and `lines` (`ord`,
`member_id`, one row per named member), so a request that names very many members is
spread over tasks like any other rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.columns import blank_to_null, date_before_time, first_reason
from rollcall.model import Model, Rules
from rollcall.operators.outcome import Outcome
from rollcall.plans.keyed import first_claims, flag_known, flag_unknown, last_given, matched_keys, spread_key
from rollcall.plans.refresh import moment, promote
from rollcall.plans.standing import bridge_changed, settle_touched
from rollcall.sources.lineage import cut_lineage


@dataclass(frozen=True)
class Kind:
    events: str
    bridge: str
    name: str

    @property
    def key(self) -> str:
        return f"{self.name}_id"

    @property
    def date(self) -> str:
        return f"{self.name}_date"


OUTINGS = Kind("outings", "outing_members", "outing")
SERVICES = Kind("services", "service_members", "service")


def request_lines(requests: DataFrame, members: str = "member_ids") -> DataFrame:
    """`lines` of requests that carry their members as an array."""
    return requests.select("ord", F.explode(members).alias("member_id"))


# --- lists -------------------------------------------------------------------------


def list_events(model: Model, kind: Kind) -> DataFrame:
    """Events newest first with their participant count, 0 when there are none."""
    counts = getattr(model, kind.bridge).groupBy(kind.key).agg(F.count(F.lit(1)).alias("participant_count"))
    rows = getattr(model, kind.events).join(counts, kind.key, "left").orderBy(F.desc(kind.date))
    return rows.select(
        kind.key,
        F.col(kind.date).cast("string").alias(kind.date),
        "details",
        "created_at",
        F.coalesce("participant_count", F.lit(0).cast("bigint")).alias("participant_count"),
    )


def list_outings(model: Model) -> DataFrame:
    """Outings are never locked."""
    return list_events(model, OUTINGS).withColumn("is_locked", F.lit(False))


def list_services(model: Model) -> DataFrame:
    return list_events(model, SERVICES)


def event_participants(model: Model, kind: Kind) -> DataFrame:
    """One row per event and participant, newest event first, participants by name.

    An event may hold any share of the members, so its participants are rows, not one list.
    """
    members = model.members.select("member_id", "full_name", "phone")
    return (
        getattr(model, kind.bridge)
        .select(kind.key, "member_id")
        .join(members, "member_id")
        .join(getattr(model, kind.events).select(kind.key, kind.date), kind.key)
        .orderBy(F.desc(kind.date), "full_name", "member_id")
        .select(kind.key, F.col(kind.date).cast("string").alias(kind.date), "member_id", "full_name", "phone")
    )


# --- writes ------------------------------------------------------------------------


def _with_bad_lines(requests: DataFrame, lines: DataFrame, model: Model) -> DataFrame:
    """`requests` with `bad_lines`: true when any named member does not exist."""
    unknown = flag_unknown(lines, model.members, "member_id").where(F.col("unknown"))
    bad = unknown.select("ord").distinct().withColumn("bad_lines", F.lit(True))
    return requests.join(bad, "ord", "left").withColumn("bad_lines", F.coalesce("bad_lines", F.lit(False)))


def _split(checked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    accepted = checked.where(F.col("reason").isNull())
    rejected = checked.where(F.col("reason").isNotNull()).select(*columns, "reason")
    return accepted, rejected


def _date_key(kind: Kind) -> Column:
    return F.concat(F.lit("="), F.col(kind.date).cast("string")).alias("date_key")


def create_events(
    model: Model, kind: Kind, requests: DataFrame, lines: DataFrame, as_of: str, rules: Rules = Rules()
) -> Outcome:
    """Create events with their members. `requests`: ord, event_date, details, created_by."""
    events, bridge = getattr(model, kind.events), getattr(model, kind.bridge)
    columns = requests.columns
    lines = lines.select("ord", "member_id").distinct()
    parsed = requests.withColumn(kind.date, date_before_time(F.col("event_date")))
    parsed = parsed.withColumn("date_key", spread_key(F.col(kind.date), "ord"))
    parsed = flag_known(parsed, events.select(_date_key(kind)), ["date_key"], "taken")
    # judged once; the claims and the verdicts both read them
    parsed = cut_lineage(_with_bad_lines(parsed, lines, model))
    sound = parsed.where(~F.col("taken") & ~F.col("bad_lines")).withColumn("owner", F.col("ord"))
    parsed = parsed.join(first_claims(sound, "date_key", "ord", "owner"), "date_key", "left")
    checked = parsed.withColumn(
        "reason",
        first_reason(
            (F.col(kind.date).isNull(), f"{kind.date} is required"),
            (F.col("taken") | (F.col("claimed_by") < F.col("ord")), f"another {kind.name} holds that date"),
            (F.col("bad_lines"), "a named member does not exist"),
        ),
    )
    accepted, rejected = _split(cut_lineage(checked), columns)
    event_id = F.col(kind.date).cast("string").alias(kind.key)
    new_events = accepted.select(
        event_id, kind.date, blank_to_null(F.col("details")).alias("details"),
        "created_by", moment(as_of).alias("created_at"),
    )
    new_rows = lines.join(accepted.select("ord", event_id), "ord").select(
        kind.key, "member_id", moment(as_of).alias("added_at")
    )
    tables = {kind.events: events.unionByName(new_events), kind.bridge: bridge.unionByName(new_rows)}
    return _settled(model, kind, tables, rejected, None, new_rows, as_of, rules)


def replace_event_members(
    model: Model, kind: Kind, requests: DataFrame, lines: DataFrame, as_of: str, rules: Rules = Rules()
) -> Outcome:
    """Replace the whole member set of events; a request without lines empties it.

    `requests`: ord, event_id, event_date, details. A null date or details keeps the old
    value, blank details clear it. Dates are checked against the state before the batch.
    """
    events, bridge = getattr(model, kind.events), getattr(model, kind.bridge)
    columns = requests.columns
    lines = lines.select("ord", "member_id").distinct()
    parsed = requests.withColumn(kind.key, F.col("event_id")).withColumn(
        "new_date", date_before_time(F.col("event_date"))
    )
    parsed = flag_known(parsed, events, [kind.key], "found")
    parsed = parsed.withColumn("date_key", spread_key(F.col("new_date"), "ord"))
    holders = events.select(_date_key(kind), F.col(kind.key).alias("held_by"))
    parsed = parsed.join(holders, "date_key", "left")
    # judged once; the claims and the verdicts both read them
    parsed = cut_lineage(_with_bad_lines(parsed, lines, model))
    taken = F.coalesce(F.col("held_by") != F.col(kind.key), F.lit(False))
    sound = parsed.where(F.col("found") & ~taken & ~F.col("bad_lines"))
    parsed = parsed.join(first_claims(sound, "date_key", "ord", kind.key), "date_key", "left")
    claimed = F.coalesce(F.col("claimed_by") != F.col(kind.key), F.lit(False))
    checked = parsed.withColumn(
        "reason",
        first_reason(
            (F.col("event_date").isNotNull() & F.col("new_date").isNull(), f"{kind.date} is invalid"),
            (~F.col("found"), f"{kind.name} not found"),
            (taken | claimed, f"another {kind.name} holds that date"),
            (F.col("bad_lines"), "a named member does not exist"),
        ),
    )
    accepted, rejected = _split(cut_lineage(checked), columns)
    changes = accepted.groupBy(kind.key).agg(
        last_given("new_date", "ord").alias("new_date"),
        last_given("details", "ord").alias("new_details"),
        F.max("ord").alias("ord"),
    )
    new_events = events.join(changes.drop("ord"), kind.key, "left").withColumns(
        {
            kind.date: F.coalesce("new_date", kind.date),
            "details": F.when(F.col("new_details").isNotNull(), blank_to_null(F.col("new_details"))).otherwise(
                F.col("details")
            ),
        }
    )
    new_rows = lines.join(changes.select("ord", kind.key), "ord").select(
        kind.key, "member_id", moment(as_of).alias("added_at")
    )
    gone = bridge.join(changes.select(kind.key), kind.key, "left_semi")
    kept = bridge.join(changes.select(kind.key), kind.key, "left_anti")
    tables = {kind.events: new_events.select(*events.columns), kind.bridge: kept.unionByName(new_rows)}
    return _settled(model, kind, tables, rejected, gone, new_rows, as_of, rules)


def delete_events(model: Model, kind: Kind, ids: DataFrame, as_of: str, rules: Rules = Rules()) -> Outcome:
    """Delete events and their bridge rows; levels already reached stay. `ids`: event id column."""
    ids = ids.select(kind.key).distinct()
    events, bridge = getattr(model, kind.events), getattr(model, kind.bridge)
    missing = ids.join(matched_keys(events, ids, [kind.key]), kind.key, "left_anti")
    tables = {kind.events: events.join(ids, kind.key, "left_anti"), kind.bridge: bridge.join(ids, kind.key, "left_anti")}
    rejected = missing.withColumn("reason", F.lit(f"{kind.name} not found"))
    gone = bridge.join(ids, kind.key, "left_semi")
    outcome = _settled(model, kind, tables, rejected, gone, None, as_of, rules, settle=kind is not SERVICES)
    return replace(outcome, removed={kind.events: ids, kind.bridge: ids})


def _settled(
    model: Model, kind: Kind, tables: dict[str, DataFrame], rejected: DataFrame, gone: DataFrame | None, new: DataFrame | None,
    as_of: str, rules: Rules, settle: bool = True,
) -> Outcome:
    """The outcome of bridge rows that go and come: by the standing of their members if the model keeps one, else by all facts."""
    if model.standing is None:
        later = (lambda after: promote(after, as_of, rules)) if settle else (lambda after: after)
        return Outcome(model.with_tables(**tables), rejected, later)
    bridge = getattr(model, kind.bridge)
    none = bridge.where(F.lit(False))
    standing, moved, buckets = bridge_changed(model.standing, f"n_{kind.name}s", gone if gone is not None else none, new if new is not None else none)
    return Outcome(
        model.with_tables(**tables, standing=standing), rejected, touched={f"standing_{name}": keys for name, keys in buckets.items()},
        settle_rows=lambda after: settle_touched(after, moved, None, as_of, rules),
    )
