"""Archives written and read back; ZIP directories of every kind."""

import gzip
import hashlib
import io
import zipfile

import pytest

from mnemoloom.llm import wacz as W


def ranges(data):
    return lambda at, n: data[at : at + n]


def brute(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, p in payload:
        if len(p) >= 1000 and i is not None:
            largest[p] = max(i, largest.get(p, i))
    out = []
    for i, p in payload:
        to = largest.get(p, i)
        revisit = i is not None and to != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    big = "é" * 500
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (7, "u v\r\nEvil: 1", "x" * 999), (8, "u", "x" * 999), (9, "u", None), (10, "u", ""), (5, "http://b", big), (None, "n", big), (11, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n" * 60_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    for run in (1 << 20, 300):
        monkeypatch.setattr(W, "RUN_BYTES", run)
        got = [tuple(x) for x in W.round_trip(df).collect()]
        assert sorted(got, key=str) == brute(rows)
    kept = {x.page_id: bytes(x.payload) for x in W.read_archives(W.write_archives(df)).collect() if x.record_type == "response"}
    assert kept[5] == big.encode() and kept[9] == b"" and len(kept[11]) == 60_000 * 24
    assert W.round_trip(df.limit(0)).count() == 0


def test_records_by_their_index():
    out = io.BytesIO()
    writer = W.ArchiveWriter(out)
    for k in range(5):
        writer.add(k, f"http://h/{k}", b"p" * k * 700, 4 if k == 3 else None)
    writer.close()
    data = out.getvalue()
    start, lines = W.read_index(ranges(data), len(data))
    for k, line in enumerate(lines):
        packed = data[start + line["offset"] : start + line["offset"] + line["length"]]
        got = W.parse_record(gzip.decompress(packed))
        assert (got["page_id"], got["payload_bytes"], got["refers_to"]) == (k, 700 * k, 4 if k == 3 else None)
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # it is a ZIP file to others as well
        assert z.testzip() is None and [i.compress_type for i in z.infolist()] == [0, 0]


@pytest.mark.parametrize("count, limit", [(3, None), (3, 50), (70_000, None)])
def test_directories(monkeypatch, count, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(count):
            z.writestr(f"member {k}", f"content {k} " * 10)
        z.writestr(zipfile.ZipInfo("packed"), b"q" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    data = out.getvalue()
    members = W.central_directory(ranges(data), len(data))
    assert len(members) == count
    local, size, _ = members[f"member {count - 1}"]
    start = W.member_start(ranges(data), local)
    assert data[start : start + size] == (f"content {count - 1} " * 10).encode()


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        W.central_directory(ranges(b"no archive"), 10)
    with pytest.raises(ValueError):
        W.parse_record(W.record(1, "u", b"abc", None).replace(b"abc", b"abd"))
