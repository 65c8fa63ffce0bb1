"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from rollcall.llm import queries
from rollcall.sources.lineage import cut_lineage
from tests.conftest import SF
from tests.llm.brute import base_spans, groups
from tests.llm.test_tokens_and_packing import checked


def norm(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def redacted(text):
    spans = sorted((a, b, k) for k, found in base_spans(text).items() for a, b in found)
    for a, b, k in reversed(spans):
        text = f"{text[:a]}[{k.upper()}]{text[b:]}"
    return text


def test_registered():
    assert "pipeline" in entry.queries()
    assert [n for n in entry.queries() if n[:2] == "op" and n[2].isdigit()] == list(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, now = docs.columns, [tuple(r) for r in docs.collect()]
    items = [norm(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        if name == "packing":
            rows = docs.collect()
            assert checked([r[:2] for r in now], rows, 2048) == -(-sum(r.length for r in rows) // 2048)
            break
        assert docs.columns == columns
        if name == "language":
            now = [r for r in now if r[1] and re.search(r"[^\W\d_]", r[1])]
        elif name == "near_duplicates":
            group = groups({r[0]: r[1] for r in now})
            now = [r for r in now if group[r[0]] == r[0]]
        elif name == "decontamination":
            now = [r for r in now if not any(x in norm(r[1]) for x in items)]
        else:
            now = [(i, redacted(t), lang, source, len(redacted(t))) for i, t, lang, source, _ in now]
        assert sorted(map(tuple, docs.collect())) == sorted(now), name


def test_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and another column pass every stage."""
    rows = [(None, "Text without an id.", "en", "s", 1, 7), (1, None, "en", "s", 0, 7), (2, "", None, "s", 0, 7), (3, "Mail x@y.com about it.", "en", None, None, 7),
            (3, "Mail x@y.com about it.", "en", None, None, 7), (4, "long " * 200_000, "en", "s", 10**6, 7), (5, "4041 8949 7460 8795 ist die Nummer", "de", "s", 1, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text int")
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, some in ((frame, True), (frame.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, str(tmp_path)))
            if name != "packing":
                assert docs.columns == frame.columns
                last = docs
        found = {r.doc_id: r.text for r in last.collect()}
        assert found.keys() == ({None, 3, 4, 5} if some else set())
        assert not some or (found[3] == "Mail [EMAIL] about it." and found[5] == "[CARD] ist die Nummer" and last.count() == 4)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
