import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import warc
from tallyloom.llm.shared import shared_dir

ROWS = [(1, "http://a/1", "<p>é</p>", 0), (2, "http://a/2", None, 0), (3, "http://a/3", "", 0), (5, None, "<p>é</p>", 0), (4, "http://a/4", "<p>é</p>", 0), (None, "http://a/n", "<p>é</p>", 0), (None, "http://n", "only here", 0), (9, "http://b/9", "x" * 300_000, 0), (1, "http://a/0", "<p>é</p>", 0), (10, "http://c", "a\r\n\r\nb", 0), (11, "http://d\r\n\r\nX-Page-ID: 3\t\x00", "odd url", 0)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, payload_bytes long").repartition(3)


def test_round_trip(spark, pages):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    groups = {}
    for r in ROWS:
        groups.setdefault(r[2] or "", []).append((r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for r in ROWS:
        first = min(groups[r[2] or ""])
        own = (r[0] is None, r[0] or 0, r[1] or "") == first
        want.append((r[0], len((r[2] or "").encode()), digest(r[2]), "response" if own else "revisit", None if own else first[1]))
    got = [tuple(x) for x in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_smaller_payloads_are_all_responses(spark, pages):
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(spark, pages.where("page_id is not null"), least=5).collect()}
    assert got[2] == got[3] == "response" and got[4] == "revisit"


def test_predicates_reach_the_reader(spark, pages):
    path = shared_dir(spark)
    warc.archived(spark, pages, path)
    assert spark.conf.get(PUSHDOWN) == "false"
    with warc.pushed_filters(spark):
        reads(spark, path)
    assert spark.conf.get(PUSHDOWN) == "false"


def reads(spark, path):
    df = spark.read.format("warc").option("path", path).load()
    some = df.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b"))
    assert [r["page_id"] for r in some.collect()] == [9]
    assert df.where(F.col("page_id").isin(4, 9, 77)).count() == 2
    long = {r[2] for r in ROWS if len((r[2] or "").encode()) > 5}  # a response for each payload
    assert df.where("payload_bytes > 5 and record_type = 'response'").count() == len(long)
    heads = spark.read.format("warc").option("path", path).option("payload", "false").load()
    assert heads.where("payload is not null").count() == 0


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def members(rows, zipped=True):
    out = io.BytesIO()
    for kind, html in rows:
        data = warc.record({"WARC-Type": kind, "WARC-Target-URI": "u"}, b"HTTP/1.1 200 OK\r\n\r\n" + html)
        out.write(warc.packed(data) if zipped == 1 else gzip.compress(data) if zipped else data)
    out.seek(0)
    return out


@pytest.mark.parametrize("zipped", [0, 1, 2])
def test_unwanted_payloads_are_not_decoded(zipped):
    rows = [("response", bytes([65 + k]) * 50_000) for k in range(6)]
    records = warc.Records(members(rows, zipped), bool(zipped))
    seen = []
    for k, (h, block) in enumerate(records):
        assert h["warc-target-uri"] == "u"
        if k == 3:
            seen.append(block())
    assert k == 5 and records.decoded == 1 and seen[0].endswith(b"D" * 50_000)


def test_others_read_our_files_and_failed_writes_are_not_read(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archived(spark, pages, path)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert b"WARC/1.1\r\nWARC-Type: " in gzip.decompress(files[0].read_bytes())
    (tmp_path / "w" / "left-over.warc.gz").write_bytes(files[0].read_bytes())
    with warc.pushed_filters(spark):
        assert spark.read.format("warc").option("path", path).load().count() == len(ROWS)


def test_partitions_hold_files_up_to_their_size(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * 100)
    r = warc.WarcReader({"path": f"file://{tmp_path}", "target": "250"})
    assert [len(p.names) for p in r.partitions()] == [2, 2, 1]


@pytest.mark.parametrize("zipped", [0, 1, 2])
@pytest.mark.parametrize("bad", [b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length", b"WARC/1.1\r\nContent-Length: many\r\n\r\nx\r\n\r\n", b"no record at all\r\n\r\n"])
def test_damaged_records_are_errors_or_skipped(zipped, bad):
    good = warc.record({"WARC-Type": "response", "WARC-Target-URI": "u"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    packed = warc.packed if zipped == 1 else gzip.compress if zipped else bytes
    data = packed(good) + packed(bad) + (b"" if zipped else b"\r\n") + packed(good)
    with pytest.raises(warc.Damaged):
        list(warc.Records(io.BytesIO(data), bool(zipped)))
    records = warc.Records(io.BytesIO(data), bool(zipped), skip=True)
    assert [block()[-4:] for _, block in records] == [b"body"] * 2 and records.skipped == 1


def test_members_that_are_cut_off():
    data = warc.packed(warc.record({"WARC-Type": "response"}, b"x" * 90_000))
    with pytest.raises(warc.Damaged):
        [block() for _, block in warc.Records(io.BytesIO(data[:60]), True)]
    with pytest.raises(warc.Damaged):
        list(warc.Records(io.BytesIO(gzip.compress(b"nothing of the kind")), True))


def test_a_very_common_payload_is_spread(spark):
    """Four of five pages are equal: the join back gives no task more than a few times the median."""
    from pyspark.sql import functions as F

    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise("error page").alias("html")).repartition(3)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("-1", "false", "16"), strict=True):
            spark.conf.set(n, v)
        plan = warc.planned(pages)
        sizes = sorted(r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect())
        got = plan.groupBy("record_type", "refers_to").count().collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2] and len(sizes) == 16
    assert {tuple(r) for r in got} == {("response", None, 801), ("revisit", 1, 3199)}
