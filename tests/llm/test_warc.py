"""WARC archives: round trip, digests, rolling, commits."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from oracle.compare import duck, duck_rows, spark_rows
from rollcall.llm import queries, warc
from tests.conftest import SF

ROWS = [(i, f"http://a/{i}\r\nX: y", ("x" * (i % 3)) if i % 7 else None) for i in range(40)]
ROWS += [(None, None, "zz"), (None, None, "zz"), (None, "u", "x"), (5, None, "xx"), (5, None, "xx"), (-3, "http://é", "é愛\r\n\r\nWARC/1.1\r\n"), (99, "", "big" * 400_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, u, h, "f", "r") for i, u, h in ROWS], "page_id long, url string, html string, first string, refers_to string")


def expected(least=0):
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        leader = first.get(h or "") if len(data) >= least else None
        revisit = leader is not None and leader != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("roll,least", [(600, 0), (1 << 20, 0), (600, 2)])
def test_round_trip(spark, pages, tmp_path, roll, least):
    folder = str(tmp_path / "archive")
    manifest = warc.write(pages, folder, roll, least).collect()
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(least)
    assert all(r.stored_digest == r.payload_digest for r in got if r.record_type == "response")
    bodies = {(i, h or "") for i, _, h in ROWS}
    assert all((r.page_id, r.payload.decode()) in bodies for r in got if r.record_type == "response")
    assert sum(m.records for m in manifest) == len(ROWS)
    for m in manifest:
        data = Path(folder, m.file).read_bytes()
        assert len(data) == m.bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not [p for p in Path(folder).iterdir() if p.name.startswith("_temporary")]


def test_same_archive_twice(spark, pages, tmp_path):
    files = []
    for name in ("a", "b"):
        warc.write(pages, str(tmp_path / name), 600)
        files.append({p.name: p.read_bytes() for p in (tmp_path / name).glob("*.warc.gz")})
    assert files[0] == files[1] and len(files[0]) > 3


def test_readers_take_only_what_the_manifest_names(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "a"), 600)
    (tmp_path / "a" / "pages-999999-000000.warc.gz").write_bytes(b"half a file")
    (tmp_path / "a" / "_temporary-x").write_bytes(b"half a file")
    assert warc.read(spark, str(tmp_path / "a")).count() == len(ROWS)


def test_damage_is_noticed(spark, tmp_path):
    data = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    text = gzip.decompress(data).replace(b"payload\r\n", b"paybad!\r\n")
    (tmp_path / "x").write_bytes(gzip.compress(text))
    with (tmp_path / "x").open("rb") as stream, pytest.raises(ValueError, match="damaged"):
        list(warc.records(stream))


def test_ranges_are_sorted(spark, pages, tmp_path):
    manifest = warc.write(pages, str(tmp_path / "a"), 600).orderBy("file").collect()
    firsts = [m.first_id for m in manifest if m.first_id is not None]
    assert firsts == sorted(firsts)


def test_empty(spark, pages, tmp_path):
    assert warc.write(pages.limit(0), str(tmp_path / "a")).count() == 0
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(duck(SF), queries.ORACLE[name])


def test_each_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    pages = spark.range(60).selectExpr("id as page_id", "concat('http://a/', id) as url", "repeat(uuid(), 40) as html")
    written = warc.write(pages, str(tmp_path / "w"), roll=4000)
    back = warc.read(spark, str(tmp_path / "w"))
    n = written.count()
    assert n > 4 and back.rdd.getNumPartitions() == n
    tasks = back.select("page_id", warc.F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) == n and sum(r["count"] for r in tasks) == 60
