"""The shape of the plans: what reaches the scans, what is shuffled, what is not."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall.model import Rules
from rollcall.operators import logs, marking, members, reports
from rollcall.plans import progress, refresh
from rollcall.plans.keyed import spread_key
from rollcall.sources import requests
from rollcall.sources.store import load, publish
from tests.conftest import SF


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The test tables as a stored snapshot, as an installation would have them."""
    root = str(tmp_path_factory.mktemp("plans"))
    model = entry.Tables(spark, SF).model
    publish(model, root, 1)
    return load(spark, root, member_id=model.members.schema["member_id"].dataType)


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned when no side is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, pattern: str) -> int:
    return len(re.findall(pattern, plan(df)))


@pytest.mark.parametrize("name", list(entry.READS))
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text


def test_no_broadcast_hint_is_given(stored):
    logical = reports.all_members_report(refresh.prepare(stored, entry.AS_OF))._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in logical and "broadcast" not in logical.lower()


def test_a_point_lookup_reaches_the_scan(stored):
    assert "PushedFilters: [IsNotNull(member_id), EqualTo(member_id,7)]" in plan(members.member_by_id(stored.members, 7))


def test_a_report_reads_only_its_columns(stored):
    text = plan(reports.eligible_report(refresh.prepare(stored, entry.AS_OF)))
    assert "ReadSchema: struct<member_id:bigint,full_name:string,phone:string,level:int>" in text
    assert "marked_at" not in text


def test_a_report_without_activity_has_no_window(stored):
    """The activity part is a left join on a grouping key, which is dropped when unused."""
    assert count(reports.eligible_report(refresh.prepare(stored, entry.AS_OF)), "Window ") == 0
    assert count(reports.yet_to_service(refresh.prepare(stored, entry.AS_OF)), "bit_or") == 0
    assert count(reports.inactive_report(refresh.prepare(stored, entry.AS_OF)), "Window ") == 1


def test_recent_marks_are_limited_before_the_shuffle(stored):
    text = plan(progress.lapsed_members(stored, Rules()))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)
    assert text.count("Exchange hashpartitioning") == 1


def test_coverage_is_one_aggregate_of_bitmaps(stored):
    """By member alone, combined in the map tasks; no list of topics is collected from the marks."""
    text = plan(progress.mark_facts(stored))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_bit_or" in text
    assert len(re.findall(r"Scan parquet .*member_id", text)) == 1 and "ObjectHashAggregate(keys=[member_id" not in text


def test_the_matrix_is_not_shuffled(stored, no_broadcast):
    """Flagship without any broadcast: no product of members and topics, members are shuffled once."""
    text = plan(reports.all_members_report(refresh.prepare(stored, entry.AS_OF)))
    assert text.count("Exchange rangepartitioning") == 1 and "Generate" not in text
    keys = Counter(re.findall(r"Exchange hashpartitioning\((\w+)#", text))
    print(keys)
    assert keys["member_id"] <= 6 and keys["session_id"] <= 4


def test_stage2_history_in_bulk_is_sparse(stored):
    """No member-by-session product, no list of all sessions on a row."""
    for df in (logs.stage2_member_marks(stored), logs.stage2_member_absences(stored)):
        assert "Generate" not in plan(df) and "collect_list" not in plan(df)


def join_keys(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((\w+)#", plan(df))


def test_rows_without_a_key_are_spread(spark, no_broadcast):
    """Joins by phone or date are on a key that every row has, and that rows without a value share with no other."""
    t = entry.Tables(spark, SF)
    patches = requests.patches(t.customer)
    keyed = patches.withColumn("phone_key", spread_key(F.nullif(F.col("phone"), F.lit("")), "ord"))
    assert keyed.where("phone_key is null").count() == 0
    without = keyed.where("phone is null")
    assert without.count() > 50 and without.select("phone_key").distinct().count() == without.count()
    for outcome in (entry._patch(t), entry._create(t, entry.events.OUTINGS), entry._replace(t, entry.events.SERVICES)):
        assert not {"phone", "new_date", "outing_date", "service_date", "event_date"} & set(join_keys(outcome.rejected))


def test_stored_marks_are_shuffled_once(spark, stored, no_broadcast):
    """A batch meets the stored marks of its sessions in one aggregate; the others pass by."""
    t = entry.Tables(spark, SF)
    outcome = marking.upsert_marks(stored, t.feed, entry.AS_OF, entry.TODAY, entry.DAILY)
    text = plan(outcome.changed.marks)
    assert len(re.findall(r"Scan parquet .*mark_id", text)) <= 3
    assert text.count("partial_min_by") == 1
