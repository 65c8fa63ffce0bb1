"""

Nested results are flattened here for the comparison (dates and timestamps as text, arrays
joined); the library itself returns native types.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from oracle.sql import ORACLE  # noqa: E402
from rollcall.model import Calendar, Model  # noqa: E402
from rollcall.operators import events, logs, marking, members, migrations, quality, registration, reports  # noqa: E402
from rollcall.operators.outcome import Outcome  # noqa: E402
from rollcall.plans import progress, refresh, standing  # noqa: E402
from rollcall.sources import layout, requests, store  # noqa: E402
from rollcall.sources.bindings import AS_OF, DAILY, from_test_tables, marks, read_table  # noqa: E402
from rollcall.sources.lineage import cut_lineage, new_folder, shared_folder  # noqa: E402
from rollcall.streaming import marks_feed  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
TODAY = "2024-02-01"
SESSION_TODAY = "2024-01-20"

_plans: dict[tuple, tuple[SparkSession, object]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """A model or state is a set of lazy plans: built once per session and folder."""
    key = (id(spark), sf_dir, name)
    if key not in _plans:
        _plans[key] = (spark, build())
    return _plans[key][1]


def flat(df: DataFrame) -> DataFrame:
    """Dates, timestamps as text, decimals as double."""

    def plain(field: T.StructField):
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(field.name).cast("string")
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double")
        return F.col(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


class Tables:
    """Lazy access to the test tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def model(self) -> Model:
        return once(self.spark, self.sf_dir, "model", lambda: from_test_tables(self.spark, self.sf_dir))

    @property
    def morning(self) -> Model:
        """The model with the marks of morning events only, stored: the afternoon is the feed."""
        return once(self.spark, self.sf_dir, "morning", self._morning)

    def _morning(self) -> Model:
        stored = cut_lineage(marks(self.events.where(requests.is_morning()), self.supplier))
        roster = self.model.stage2_roster.select("member_id")
        on_sunday = stored.where(F.dayofweek(F.col("session_id").cast("date")) == 1)
        return self.model.with_tables(
            marks=stored, stage2_marks=on_sunday.join(roster, "member_id", "left_semi").select(*stored.columns)
        )

    @property
    def settled(self) -> Model:
        """The model with every level settled, and its standing, stored."""
        return once(self.spark, self.sf_dir, "settled", lambda: _stored_standing(self.model))

    @property
    def settled_morning(self) -> Model:
        return once(self.spark, self.sf_dir, "settled_morning", lambda: _stored_standing(self.morning))

    def stored(self, name: str, build: Callable[[Tables], Model]) -> Model:
        """A model that is published and loaded again, once for the queries that read it."""
        return once(self.spark, self.sf_dir, name, lambda: build(self))

    @property
    def feed(self) -> DataFrame:
        return requests.mark_records(self.events, self.supplier)

    @property
    def stage2_feed(self) -> DataFrame:
        return requests.stage2_mark_records(self.events, self.supplier, self.model.stage2_roster)

    def prepared(self) -> refresh.State:
        return once(self.spark, self.sf_dir, "prepared", lambda: refresh.prepare(self.model, AS_OF))

    def observed(self) -> refresh.State:
        return once(self.spark, self.sf_dir, "observed", lambda: refresh.observe(self.model))

    def requested_ids(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("member_id"))


def _stored_standing(model: Model) -> Model:
    """The model settled, with members, roster and standing written as tables."""
    full = standing.with_standing(model, AS_OF)
    kept = {name: cut_lineage(table) for name, table in full.standing.tables().items()}
    own = {name: cut_lineage(getattr(full, name)) for name in ("members", "stage2_roster", "topics")}
    return full.with_tables(**own, standing=replace(full.standing, **kept))


# --- reads -------------------------------------------------------------------------


def _all_members_report(t: Tables) -> DataFrame:
    report = reports.all_members_report(t.prepared())
    return report.withColumn(
        "topics",
        F.array_join(F.transform("topics", lambda x: F.concat_ws("=", x["name"], x["status"])), "|"),
    )


def _member_topic_progress(t: Tables) -> DataFrame:
    return members.member_topic_progress(t.model).withColumn("attended_dates", F.array_join("attended_dates", "|"))


def _promotion_status(t: Tables) -> DataFrame:
    return members.promotion_status(t.observed()).withColumn("missing", F.array_join("missing", "|"))


def _member_details(t: Tables) -> DataFrame:
    def joined(array: str, *fields: str):
        """Records by "|", their fields by "="; an array inside by ","."""

        def shown(x, name: str):
            return F.array_join(x[name], ",") if name == "attended_dates" else F.coalesce(x[name].cast("string"), F.lit(""))

        return F.array_join(F.transform(array, lambda x: F.concat_ws("=", *[shown(x, f) for f in fields])), "|")

    progress_fields = ["topic_id", "name", "order_index", "status", "attended_on", "attended_dates", "last_attended_on"]
    status = [c for c in members.promotion_status(t.observed()).columns if c not in ("member_id", "missing")]
    return members.member_details(t.observed()).select(
        "member.*",
        joined("sessions", *progress_fields).alias("sessions"),
        joined("outings", "outing_date", "recorded_at", "details").alias("outings"),
        joined("services", "service_date", "recorded_at", "details").alias("services"),
        *[F.col(f"promotion_status.{c}").alias(c) for c in status],
        F.array_join("promotion_status.missing", "|").alias("missing"),
    )


def _existing_topics(t: Tables) -> DataFrame:
    """Event types as stored topics, two of them under a fixed topic's name."""
    name = (
        F.when(F.col("event_type") == "view", F.lit("Yoga"))
        .when(F.col("event_type") == "click", F.lit("Karma"))
        .otherwise(F.col("event_type"))
    )
    return t.events.groupBy(name.alias("name")).agg(
        F.concat(F.lit("stored:"), F.min("event_type")).alias("topic_id"),
        F.count(F.lit(1)).cast("int").alias("order_index"),
        refresh.moment("2024-01-01 00:00:00").alias("created_at"),
    ).select("topic_id", "name", "order_index", "created_at")


def _rotation_dates(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderdate").cast("date").alias("session_date")).distinct()


def _session_dates(t: Tables) -> DataFrame:
    asked = requests.session_requests(t.events, t.orders)
    reason = marking.session_date_reason(F.col("session_date"), Calendar(), SESSION_TODAY)
    return asked.select("ord", "session_date", reason.alias("reason"))


def _recent(rows: DataFrame) -> DataFrame:
    """The newest statuses of a member as one text."""
    return rows.select(
        "member_id", F.array_join(F.transform("recent", lambda x: F.concat_ws("=", x["session_date"].cast("string"), x["status"])), "|").alias("recent")
    )


def _member_layout_report(t: Tables) -> DataFrame:
    laid_out = layout.write_by_member(t.model, _own_folder(t), buckets=8)
    report = reports.all_members_report(refresh.prepare(laid_out, AS_OF))
    return report.withColumn("topics", F.array_join(F.transform("topics", lambda x: F.concat_ws("=", x["name"], x["status"])), "|"))


def _unchecked_model(t: Tables) -> Model:
    """All records of the feed as marks, as they came: doubled ones, unknown members and statuses; and an event as its own marker."""
    raw = t.feed.select(
        F.concat_ws("|", "session_date", F.col("member_id").cast("string")).alias("mark_id"), F.col("session_date").alias("session_id"), "member_id",
        F.when(F.col("member_id") > 0, F.col("status")).alias("status"), F.col("ord").cast("string").alias("marked_by"), F.col("received_at").alias("marked_at"),
    )
    return t.model.with_tables(marks=raw, members=t.model.members.withColumn("phone", F.nullif(F.col("college_name"), F.lit("College 3"))))


READS: dict[str, Callable[[Tables], DataFrame]] = {
    "all_members_report": _all_members_report,
    "list_members": lambda t: members.list_members(t.prepared()),
    "list_members_inactive_any_level": lambda t: members.list_members(t.prepared(), False, True),
    "list_members_eligible": lambda t: members.list_members(t.prepared(), eligible_for_outing=True),
    "member_by_id": lambda t: members.members_by_ids(t.model.members, t.requested_ids()),
    "member_topic_progress": _member_topic_progress,
    "member_outing_history": lambda t: members.member_outing_history(t.model),
    "member_service_history": lambda t: members.member_service_history(t.model),
    "member_progress_counts": lambda t: members.member_progress_counts(t.observed()),
    "promotion_status": _promotion_status,
    "member_details": _member_details,
    "list_sessions": lambda t: logs.list_sessions(t.model),
    "list_sessions_range": lambda t: logs.list_sessions(t.model, "2024-01-05", "2024-01-20"),
    "list_marks": lambda t: logs.list_marks(t.model),
    "list_marks_of_date": lambda t: logs.list_marks(t.model, session_date="2024-01-14"),
    "attendance_summary": lambda t: logs.attendance_summary(t.model),
    "attendance_summary_range": lambda t: logs.attendance_summary(t.model, "2024-01-05", "2024-01-20"),
    "inactive_report": lambda t: reports.inactive_report(t.prepared()),
    "eligible_report": lambda t: reports.eligible_report(t.prepared()),
    "not_eligible_report": lambda t: reports.eligible_report(t.prepared(), "not_eligible"),
    "promoted_report": lambda t: reports.promoted_report(t.prepared()),
    "missing_by_topic": lambda t: reports.missing_by_topic(t.prepared()),
    "missing_counts_by_topic": lambda t: reports.missing_counts_by_topic(t.prepared()),
    "yet_to_outing": lambda t: reports.yet_to_outing(t.prepared()),
    "yet_to_service": lambda t: reports.yet_to_service(t.prepared()),
    "list_outings": lambda t: events.list_outings(t.model),
    "outing_participants": lambda t: events.event_participants(t.model, events.OUTINGS),
    "list_services": lambda t: events.list_services(t.model),
    "service_participants": lambda t: events.event_participants(t.model, events.SERVICES),
    "stage2_members": lambda t: logs.stage2_members(t.model),
    "stage2_member_by_id": lambda t: logs.stage2_members_by_ids(t.model, t.requested_ids()),
    "stage2_member_history": lambda t: logs.stage2_member_history(t.model, t.requested_ids()),
    "stage2_member_marks": lambda t: logs.stage2_member_marks(t.model),
    "stage2_member_absences": lambda t: logs.stage2_member_absences(t.model),
    "list_members_active": lambda t: members.list_members(t.prepared(), True),
    "list_marks_of_session": lambda t: logs.list_marks(t.model, session_id="2024-01-14"),
    "stage2_marks_of_date": lambda t: logs.stage2_marks(t.model, session_date="2024-01-14"),
    "stage2_marks_of_session": lambda t: logs.stage2_marks(t.model, session_id="2024-01-07"),
    "stage2_sessions_range": lambda t: logs.stage2_sessions(t.model, "2024-01-05", "2024-01-20"),
    "stage2_sessions": lambda t: logs.stage2_sessions(t.model),
    "stage2_marks": lambda t: logs.stage2_marks(t.model),
    "fixture_summary": lambda t: reports.fixture_summary(t.observed()),
    "ensure_topics": lambda t: refresh.ensure_topics(_existing_topics(t), AS_OF),
    "activity_status": lambda t: refresh.activity_status(t.model),
    "activity_refresh": lambda t: refresh.activity_refresh(
        t.model, t.events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("member_id"))
    ),
    "latest_status": lambda t: progress.latest_status(t.model),
    "promotion_eligible": lambda t: refresh.promotion_eligible(t.model),
    "promote": lambda t: refresh.promote(t.model, AS_OF).members,
    "stage2_roster_sync": lambda t: refresh.refresh(t.model, AS_OF).stage2_roster,
    "prepare_state": lambda t: refresh.refresh(t.model, AS_OF).members,
    "topic_rotation": lambda t: marking.topic_rotation(_rotation_dates(t), t.model.topics),
    "topic_coverage": lambda t: progress.topic_coverage(t.model),
    "constraint_check": lambda t: quality.constraint_check(t.model),
    "constraint_check_unchecked": lambda t: quality.constraint_check(_unchecked_model(t)),
    "standing_coverage": lambda t: t.settled.standing.coverage.drop("bucket"),
    "standing_tallies": lambda t: t.settled.standing.tallies.drop("bucket"),
    "standing_recent": lambda t: _recent(t.settled.standing.recent),
    "standing_topic_coverage": lambda t: standing.topic_coverage(t.settled),
    "standing_promotion_eligible": lambda t: standing.promotion_eligible(t.settled),
    "member_layout_report": _member_layout_report,
    "migrate_add_columns": lambda t: migrations.migrate_add_columns(
        requests.members_before_profiles(t.model.members, t.customer)
    ),
    "backfill_profile": lambda t: migrations.backfill_profile(
        migrations.migrate_add_columns(requests.members_before_profiles(t.model.members, t.customer))
    ),
}


# --- writes: the tables after a batch, and the rejects ---------------------------------


def _applicants_verdict(t: Tables) -> DataFrame:
    checked = registration.validate_members(requests.applicants(t.supplier))
    return checked.valid.withColumn("reason", F.lit(None).cast("string")).withColumn("age", F.col("age").cast("string")).select(
        "ord", "full_name", "phone", "age", "reason"
    ).unionByName(checked.rejected.select("ord", "full_name", "phone", "age", "reason"))


def _events_after(kind: events.Kind, outcome: Outcome) -> DataFrame:
    """Events and bridge rows in one table."""
    rows, bridge = getattr(outcome.changed, kind.events), getattr(outcome.changed, kind.bridge)
    return rows.join(bridge.select(kind.key, "member_id", "added_at"), kind.key, "left")


def _create(t: Tables, kind: events.Kind) -> Outcome:
    return events.create_events(t.model, kind, *requests.event_requests(t.orders), AS_OF)


def _replace(t: Tables, kind: events.Kind) -> Outcome:
    return events.replace_event_members(t.model, kind, *requests.replace_requests(t.orders), AS_OF)


def _delete(t: Tables, kind: events.Kind) -> Outcome:
    return events.delete_events(t.model, kind, requests.event_ids_to_delete(t.orders, kind.key), AS_OF)


def _of_kind(kind: events.Kind) -> dict[str, Callable[[Tables], DataFrame]]:
    """Create, replace and delete: the tables, the levels, the rejects."""
    name = kind.name
    return {
        f"create_{name}s": lambda t: _events_after(kind, _create(t, kind)),
        f"create_{name}s_members": lambda t: _create(t, kind).model.members,
        f"create_{name}s_rejected": lambda t: _create(t, kind).rejected.select("ord", "reason"),
        f"replace_{name}_members": lambda t: _events_after(kind, _replace(t, kind)),
        f"replace_{name}_members_levels": lambda t: _replace(t, kind).model.members,
        f"replace_{name}_members_rejected": lambda t: _replace(t, kind).rejected.select("ord", "reason"),
        f"delete_{name}s": lambda t: _events_after(kind, _delete(t, kind)),
        f"delete_{name}s_rejected": lambda t: _delete(t, kind).rejected,
    }


def _own_folder(t: Tables) -> str:
    return new_folder(t.spark)


def _snapshot_roundtrip(t: Tables) -> DataFrame:
    """Publish every table, load it again, and count rows, lost ones and added ones."""
    root, kind = _own_folder(t), t.model.members.schema["member_id"].dataType
    store.publish(t.model, root, 1)
    lines = []
    for name, back in store.load(t.spark, root, member_id=kind).tables().items():
        first = getattr(t.model, name)
        lost, added = (a.exceptAll(b).agg(F.count(F.lit(1))).scalar() for a, b in ((first, back), (back, first)))
        lines.append(back.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", lost.alias("lost"), added.alias("added")
        ))
    return reduce(DataFrame.unionByName, lines)


def _export_json_roundtrip(t: Tables) -> DataFrame:
    rows = logs.list_sessions(t.model)
    path = f"{_own_folder(t)}/json"
    store.export_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


def _standing_upsert(t: Tables) -> Outcome:
    return marking.upsert_marks(t.settled_morning, t.feed, AS_OF, TODAY, DAILY)


def _store_after_feed(t: Tables) -> Model:
    """The morning published, the feed published as a batch, and the model loaded again."""
    root, kind = _own_folder(t), t.model.members.schema["member_id"].dataType
    store.publish(t.settled_morning, root, 1)
    outcome = marking.upsert_marks(store.load(t.spark, root, member_id=kind), t.feed, AS_OF, TODAY, DAILY)
    store.publish_outcome(outcome, root, 2, ["sessions", "marks"])
    return store.load(t.spark, root, member_id=kind)


def _store_after_deletions(t: Tables) -> Model:
    """Members, then outings deleted by their keys, and the tables written whole again."""
    root, kind = _own_folder(t), t.model.members.schema["member_id"].dataType
    store.publish(t.settled, root, 1)
    ids = requests.member_ids_to_delete(t.customer, t.supplier)
    store.publish_outcome(registration.delete_members(store.load(t.spark, root, member_id=kind), ids).outcome, root, 2, registration.CASCADE)
    gone = requests.event_ids_to_delete(t.orders, "outing_id")
    outcome = events.delete_events(store.load(t.spark, root, member_id=kind), events.OUTINGS, gone, AS_OF)
    store.publish_outcome(outcome, root, 3, ["outings", "outing_members"])
    store.compact(t.spark, root, 4, kind)
    lines = [store.load(t.spark, root, version, kind) for version in (3, 4)]
    both = [getattr(m, name).exceptAll(getattr(o, name)) for m, o in (lines, lines[::-1]) for name in registration.CASCADE]
    assert all(df.isEmpty() for df in both)
    return lines[1]


def _folded_marks(t: Tables) -> DataFrame:
    """The feed as a stream of three parts, folded into the store after each of them."""
    root, feed, kind = _own_folder(t), f"{shared_folder(t.spark)}/marks_feed/{uuid.uuid4().hex}", t.model.members.schema["member_id"].dataType
    store.publish(t.settled_morning, root, 1)
    records = requests.mark_records(t.events, t.supplier)
    folder, last = _own_folder(t), F.lit(31 * 24)
    for part in range(3):
        hours = F.col("seq") + F.when(F.col("ord") % 2 == 1, 1).otherwise(0)
        records.where(F.floor(3 * hours / last).between(-10**6 if part == 0 else part, part if part < 2 else 10**6)).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(records.schema).parquet(folder)
        marks_feed.start_feed(stream, feed, availableNow=True).awaitTermination()
        marks_feed.fold(t.spark, feed, root, 2 + part, AS_OF, TODAY, DAILY, grace=1 if part < 2 else None, member_id=kind, check=False)
    return store.load(t.spark, root, member_id=kind).marks


def _older_members(t: Tables) -> DataFrame:
    """Members stored by the first schema, without the columns that came later, as they are loaded now."""
    root, kind = _own_folder(t), t.model.members.schema["member_id"].dataType
    old = requests.members_before_profiles(t.model.members, t.customer)
    store.publish(t.model.with_tables(members=old), root, 1, schema=1)
    return store.load(t.spark, root, member_id=kind).members


def _upsert_marks(t: Tables) -> Outcome:
    return marking.upsert_marks(t.morning, t.feed, AS_OF, TODAY, DAILY)


def _delete_members(t: Tables) -> registration.Deletion:
    return registration.delete_members(t.model, requests.member_ids_to_delete(t.customer, t.supplier))


def _stream_upsert_marks(t: Tables) -> DataFrame:
    """The same feed as `upsert_marks`, read as a stream from the events table, a file or a folder of files."""
    # as a pattern: a stream takes a folder or a pattern, and the table may be a single file
    path = f"{t.sf_dir}/events.parque[t]"
    stream = t.spark.readStream.schema(t.events.schema).parquet(path)
    root = f"{shared_folder(t.spark)}/marks_feed/{uuid.uuid4().hex}"
    marks_feed.start_feed(requests.mark_records(stream, t.supplier), root, availableNow=True).awaitTermination()
    return marks_feed.current(t.morning, root, AS_OF, TODAY, DAILY).changed.marks


def _patch(t: Tables) -> Outcome:
    return registration.patch_members(t.model, requests.patches(t.customer))


def _set_active(t: Tables) -> Outcome:
    return registration.set_active(t.model, requests.activity_requests(t.customer, t.supplier))


WRITES: dict[str, Callable[[Tables], DataFrame]] = {
    "validate_members": _applicants_verdict,
    "duplicate_phone": lambda t: registration.duplicate_phone(
        requests.applicants(t.supplier), t.model.members
    ).select("ord", "phone", "reason"),
    "create_members": lambda t: registration.create_members(
        t.model, requests.applicants(t.supplier), AS_OF
    ).model.members,
    "create_members_rejected": lambda t: registration.create_members(
        t.model, requests.applicants(t.supplier), AS_OF
    ).rejected.select("ord", "reason"),
    "create_stage2_members": lambda t: registration.create_stage2_members(
        t.model, requests.applicants(t.supplier), AS_OF
    ).model.members,
    "create_stage2_members_roster": lambda t: registration.create_stage2_members(
        t.model, requests.applicants(t.supplier), AS_OF
    ).model.stage2_roster,
    "upsert_sessions": lambda t: marking.upsert_sessions(
        t.model, requests.session_requests(t.events, t.orders), AS_OF, SESSION_TODAY
    ).model.sessions,
    "validate_session_date": _session_dates,
    "stage2_upsert_sessions": lambda t: marking.stage2_upsert_sessions(
        t.model, requests.session_requests(t.events, t.orders), AS_OF
    ).model.stage2_sessions,
    "upsert_marks": lambda t: _upsert_marks(t).changed.marks,
    "upsert_marks_members": lambda t: _upsert_marks(t).model.members,
    "upsert_marks_sessions": lambda t: _upsert_marks(t).changed.sessions,
    "upsert_marks_rejected": lambda t: marking.accept_marks(t.feed, t.model.members, DAILY, TODAY)[1],
    "stage2_upsert_marks": lambda t: marking.stage2_upsert_marks(t.morning, t.stage2_feed, AS_OF).model.stage2_marks,
    "stage2_upsert_marks_rejected": lambda t: marking.accept_stage2_marks(
        t.stage2_feed, t.model.stage2_roster, Calendar()
    )[1],
    "patch_members": lambda t: _patch(t).model.members,
    "patch_members_rejected": lambda t: _patch(t).rejected.select("ord", "member_id", "reason"),
    "set_active": lambda t: _set_active(t).model.members,
    "set_active_rejected": lambda t: _set_active(t).rejected.select("member_id", "reason"),
    "delete_members": lambda t: _delete_members(t).model.members,
    "delete_members_removed": lambda t: _delete_members(t).removed,
    "delete_members_marks": lambda t: _delete_members(t).model.marks,
    "delete_members_rejected": lambda t: _delete_members(t).rejected,
    **_of_kind(events.OUTINGS),
    **_of_kind(events.SERVICES),
    "delete_outings_members": lambda t: _delete(t, events.OUTINGS).model.members,
    "upsert_sessions_rejected": lambda t: marking.upsert_sessions(
        t.model, requests.session_requests(t.events, t.orders), AS_OF, SESSION_TODAY
    ).rejected.select("ord", "session_date", "reason"),
    "stage2_upsert_sessions_rejected": lambda t: marking.stage2_upsert_sessions(
        t.model, requests.session_requests(t.events, t.orders), AS_OF
    ).rejected.select("ord", "session_date", "reason"),
    "stage2_upsert_marks_sessions": lambda t: marking.stage2_upsert_marks(t.morning, t.stage2_feed, AS_OF).model.stage2_sessions,
    **{
        f"delete_members_{table}": lambda t, table=table: getattr(_delete_members(t).model, table)
        for table in ("outing_members", "service_members", "stage2_roster", "stage2_marks")
    },
    "snapshot_roundtrip": _snapshot_roundtrip,
    "standing_upsert_marks_members": lambda t: _standing_upsert(t).model.members,
    "standing_upsert_marks_coverage": lambda t: _standing_upsert(t).changed.standing.coverage.drop("bucket"),
    "standing_upsert_marks_recent": lambda t: _recent(_standing_upsert(t).changed.standing.recent),
    "standing_create_outings_members": lambda t: events.create_events(
        t.settled, events.OUTINGS, *requests.event_requests(t.orders), AS_OF
    ).model.members,
    "standing_replace_service_members_levels": lambda t: events.replace_event_members(
        t.settled, events.SERVICES, *requests.replace_requests(t.orders), AS_OF
    ).model.members,
    "standing_replace_service_members_tallies": lambda t: events.replace_event_members(
        t.settled, events.SERVICES, *requests.replace_requests(t.orders), AS_OF
    ).changed.standing.tallies.drop("bucket"),
    "standing_delete_outings_tallies": lambda t: events.delete_events(
        t.settled, events.OUTINGS, requests.event_ids_to_delete(t.orders, "outing_id"), AS_OF
    ).changed.standing.tallies.drop("bucket"),
    "store_upsert_marks": lambda t: t.stored("after_feed", _store_after_feed).marks,
    "store_upsert_marks_members": lambda t: t.stored("after_feed", _store_after_feed).members,
    "store_delete_marks": lambda t: t.stored("after_deletions", _store_after_deletions).marks,
    "store_delete_outing_members": lambda t: t.stored("after_deletions", _store_after_deletions).outing_members,
    "store_older_members": _older_members,
    "feed_folded_marks": _folded_marks,
    "export_json_roundtrip": _export_json_roundtrip,
    "stream_upsert_marks": _stream_upsert_marks,
}


def _with_folder(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """On a single machine without a shared folder, as in tests, give the session one; a cluster has to name its own."""

    def runner(spark: SparkSession, *args) -> DataFrame:
        if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
            if spark.sparkContext.master.partition("[")[0] == "local":
                spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rollcall-"))
        return run(spark, *args)

    return runner


def _runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _with_folder(lambda spark, sf_dir: flat(build(Tables(spark, sf_dir))))


def entry(spark: SparkSession) -> DataFrame:
    """The member-by-topic matrix with status labels, after the rule pipeline."""
    return _runner(_all_members_report)(spark, SMOKE_DIR)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators; none where their subpackage is not there."""
    try:
        import corpus_pipeline
        from rollcall.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "rollcall.llm"):
            raise
        return {}, {}
    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, {**llm.ORACLE, **sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: _runner(build) for name, build in {**READS, **WRITES}.items()}
    return {**own, **{name: _with_folder(run) for name, run in _training_data()[0].items()}}


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **_training_data()[1]}
