import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from sievekit.llm import warc


def brute(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = max(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        other = first.get(html or "", page_id)
        revisit = len(raw) >= least and other != page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append(str((page_id, len(raw), digest, "revisit" if revisit else "response", other if revisit else None)))
    return sorted(out)


ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "", ""),
    (None, "http://a/n", "same"), (None, None, "only"), (None, None, "only"), (5, "http://a/x\r\nX-Evil: 1", "é\r\n\r\nWARC/1.1"),
    (6, "http://é/ü?q=a b", "x" * 3_000_000), (7, "u", "\x00\x1f\x8b binary-like"), (8, "u", "same "),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "own", "own") for r in ROWS],
                               "page_id long, url string, html string, payload_key string, refers_to string")
    got = warc.round_trip(df.repartition(3), min_revisit_bytes=least)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS, least)


def test_hot_payload(spark):
    rows = [(i, f"http://a/{i}", "hot" if i % 3 == 0 else f"page {i % 500}") for i in range(4000)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive():
    return b"".join(warc.make_record(i, f"http://a/{i}", f"page {i}".encode() * 50) for i in range(5)) \
        + warc.make_record(9, "http://a/9", b"page 1" * 50, refers_to=1)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_reader_takes_any_chunks(monkeypatch, size):
    monkeypatch.setattr(warc, "READ_BYTES", size)
    stream = io.BytesIO(archive())
    got = [(h["warc-type"], len(p)) for h, _, p in _records(stream, size)]
    assert got == [("response", 300)] * 5 + [("revisit", 0)]


def _records(stream, size):
    original = warc.members
    try:
        warc.members = lambda s: original(s, size)
        yield from warc.records(stream)
    finally:
        warc.members = original


def test_url_cannot_add_headers():
    head, _, _ = next(warc.records(io.BytesIO(warc.make_record(1, "http://a/\r\nX-Evil: 1", b"p"))))
    assert "x-evil" not in head and head["warc-target-uri"] == "http://a/%0D%0AX-Evil:%201"


@pytest.mark.parametrize("damage", ["cut", "byte", "length"])
def test_damage_is_found(damage):
    import zlib
    raw = zlib.decompress(warc.make_record(1, "u", b"payload " * 20), 31)
    if damage == "byte":
        raw = raw.replace(b"payload", b"paylord", 1)
    if damage == "length":
        raw = raw[:-9] + raw[-4:]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(raw) + packer.flush()
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data[:-20] if damage == "cut" else data)))


def test_archives_are_closed_at_their_size(spark):
    from sievekit.llm.common import run_dir
    df = spark.createDataFrame([(i, "u", f"{i}" * 100, None) for i in range(60)],
                               "page_id long, url string, html string, refers_to long").coalesce(1)
    manifest = warc.write_archives(df, run_dir(spark, "warc"), archive_bytes=2000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == 60


def test_archives_are_read_by_as_many_tasks(spark):
    """Their paths are few bytes, which adaptive execution would merge into one task."""
    pages = spark.range(240).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(cast(id as string), 50) html")
    folder = warc.run_dir(spark, "warc")
    manifest = warc.write_archives(warc.plan_revisits(pages.repartition(24), 0), folder)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    tasks = warc.read_archives(spark, manifest, folder).select(F.spark_partition_id().alias("p"), "page_id")
    assert manifest.count() >= 20
    assert tasks.select("p").distinct().count() > manifest.count() // 2
    assert tasks.select("page_id").distinct().count() == 240
