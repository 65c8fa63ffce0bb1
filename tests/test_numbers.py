"""Numbers of requests: no digit is dropped, and what a column can't hold is turned away with a reason."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rollcall.functions.columns import exact_number
from rollcall.model import EXPERIENCE
from rollcall.operators import registration
from tests.conftest import AS_OF

HELD = {
    "1e13": "10000000000000", "1e-9": "0.000000001", "10e-19": "0.000000000000000001", " 2.5 ": "2.5", "": "0", "0.000000000000000000000": "0",
    "12345678901234567890.123456789012345678": "12345678901234567890.123456789012345678", "+.5": "0.5", "3.": "3", "0e99": "0", "1.50000000000000000000000": "1.5",
}
NOT_HELD = ["123456789012345678901234567890", "0.1234567890123456789", "1e-19", "1e25", "1e400", "1e-400", "1e99999999999", "x", "1e", "0x10", "NaN"]


def test_exact_numbers(spark):
    texts = [*HELD, *NOT_HELD]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_number(F.col("t"), EXPERIENCE).alias("n")).collect()
    got = {r.t: r.n for r in found}
    assert all(got[t] == Decimal(n) for t, n in HELD.items()) and all(got[t] is None for t in NOT_HELD)


def request(ord_, experience):
    return (ord_, f"new{ord_}", f"Name {ord_}", f"555{ord_}", "30", "working", None, None, None, "Firm", "Role", experience, None)


COLUMNS = "ord long, member_id string, full_name string, phone string, age string, member_type string, college_name string, branch string, semester string, company_name string, designation string, experience string, description string"
CASES = [(1, "1e13"), (2, "1e-9"), (3, "123456789012345678901234567890"), (4, "2.25"), (5, "0.1234567890123456789"), (6, "-1")]


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([request(*c) for c in CASES], COLUMNS)


def test_create(seed, requests):
    outcome = registration.create_members(seed, requests, AS_OF)
    reasons = {r.ord: r.reason for r in outcome.rejected.collect()}
    assert reasons == {3: registration.TOO_LONG, 5: registration.TOO_LONG, 6: "experience is below zero"}
    kept = {r.member_id: r.experience for r in outcome.model.members.where("member_id like 'new%'").collect()}
    assert kept == {"new1": Decimal(10**13), "new2": Decimal("1e-9"), "new4": Decimal("2.25")}
    assert {r.ord for r in registration.validate_members(requests).rejected.collect()} == {3, 5, 6}


def test_patch(seed, requests):
    patches = requests.withColumns({"member_id": F.format_string("m%02d", "ord"), "phone": F.lit(None).cast("string")})
    outcome = registration.patch_members(seed, patches)
    assert {r.ord for r in outcome.rejected.collect()} == {3, 5, 6}
    assert outcome.model.members.where("member_id = 'm01'").first().experience == Decimal(10**13)


@pytest.mark.parametrize("column", ["age", "semester"])
def test_whole_numbers_out_of_range(spark, seed, column):
    rows = [("1e13", True), ("99999999999999999999", True), ("1e-9", True), ("4", False)]
    made = [request(i, "1") for i in range(len(rows))]
    frame = spark.createDataFrame(made, COLUMNS).withColumns({"member_type": F.lit("studying"), "college_name": F.lit("C"), "branch": F.lit("B"), "semester": F.lit("1")})
    texts = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(rows) for x in (i, t)])
    rejected = {r.ord for r in registration.create_members(seed, frame.withColumn(column, texts[F.col("ord").cast("int")]), AS_OF).rejected.collect()}
    assert rejected == {i for i, (_, bad) in enumerate(rows) if bad}
