import hashlib
import uuid

import pytest
import zstandard

from hostlore.llm import warc
from hostlore.llm.common import shared_path


def pages(spark):
    long, other = "<p>" + "é" * 100 + "</p>", "<b>" + "x" * 200
    rows = [
        (5, "http://a/ b\n", long, "k"),
        (3, None, long, "k"),
        (9, "u", long, None),
        (9, "u", long, "k"),
        (1, "v", "short", "k"),
        (2, "v", "short", "k"),
        (7, "w", None, "k"),
        (8, "w", "", "k"),
        (None, "n", long, "k"),
        (11, "m", other * 50, "k"),
        (12, "m", other * 50 + "!", "k"),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def want(rows):
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        first = min((p for p, _, h, _ in rows if h == html and p is not None), default=None)
        revisit = len(body) >= 100 and page_id is not None and first < page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, df = pages(spark)
    path = shared_path(spark, "warc-test")
    warc.write_archives(df, path, frame_bytes=300, bundle_bytes=2000)
    back = warc.read_archives(spark, path)
    assert sorted((tuple(r)[:5] for r in back.collect()), key=str) == want(rows)
    assert back.select("bundle").distinct().count() > 1 and back.agg({"frame": "max"}).first()[0] > 0
    got = {r.page_id: bytes(r.payload).decode() for r in warc.fetch_records(spark, path, back.where("page_id in (3, 11, 1)")).collect()}
    assert got == {p: h for p, _, h, _ in rows if p in (3, 11, 1)}


def test_bundle_is_plain_zstandard(spark):
    bundle = warc.Bundle(100)
    raws = [warc.record(i, f"u{i}", f"payload {uuid.uuid4()}".encode(), "d", None, "1970-01-01T00:00:00Z") for i in range(20)]
    for i, raw in enumerate(raws):
        bundle.add(str(i), raw)
    data = bundle.finish()
    assert data.endswith(warc.END.encode())
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(raws)
    reader = warc.Reader(data)
    assert [reader.record(*spot[1:]) for spot in reversed(reader.index)] == raws[::-1]
    with pytest.raises(ValueError):
        warc.Reader(data[:-1] + b"x")


def test_empty(spark):
    _, df = pages(spark)
    path = shared_path(spark, "warc-empty")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
