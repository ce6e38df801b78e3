"""WARC files read back, ids and dates as real archives have them, and header blocks of any length."""

import gzip
import random

import pytest

from textloom.llm import warc


def record(kind, uri, url, date, http, extra=""):
    body = http.encode()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {uri}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body


A, B, C = (f"<urn:uuid:0b0f-{x}-ff0000000012>" for x in "abc")
FULL = 'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\nbody é\r\n\r\nWARC/1.1 inside'
FILE = [
    record("warcinfo", "<urn:uuid:0>", "x", "2026-01-01T00:00:00Z", "software: y\r\n"),
    record("response", A, "http://a.org/", "2026-01-01T00:00:00.100Z", FULL),
    record("response", B, "http://a.org/", "2026-01-01T00:00:00.900Z", FULL.replace('"1"', '"2"')),
    record("revisit", C, "http://a.org/", "2026-01-01T00:00:00.950000Z", 'HTTP/1.1 304 Not Modified\r\nETag: "2"\r\n\r\n'),
]


def test_two_members_read_back(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(FILE[0] + b"\r\n\r\n" + FILE[1] + b"\r\n\r\n") + gzip.compress(FILE[2] + b"\r\n\r\n") + gzip.compress(FILE[3] + b"\r\n\r\n"))
    (tmp_path / "b.warc").write_bytes(b"\r\n\r\n".join(FILE) + b"\r\n\r\n")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    for end in ("a.warc.gz", "b.warc"):
        own = sorted((r for r in rows if r.path.endswith(end)), key=lambda r: r.place)
        assert [r.record.encode() for r in own] == FILE and {r.status for r in own} == {"whole"}
    parsed = warc.parse_records(warc.read_warc(spark, str(tmp_path / "b.warc")))
    # Ids stay whole and fractions of a second count: the latest earlier response is B.
    out = warc.resolve_revisits(parsed, id_col="record_uri", time_col="micros").collect()
    assert [(r.record_id, r.refers_to, r.outcome) for r in out] == [(C, B, "resolved")]
    assert {r.record_uri: r.record_id for r in parsed.collect()} == {A: None, B: None, C: None}


def test_broken_and_empty_files(spark, tmp_path):
    whole = gzip.compress(FILE[1] + b"\r\n\r\n")
    files = {"empty": b"", "blank": b"\r\n\r\n", "cut.gz": whole + gzip.compress(FILE[2])[:-30], "short": FILE[1][:-5], "bare": FILE[1] + b"\r\n\r\nWARC/1.1\r\nX: 1\r\n\r\nmore", "noise": b"no record at all"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).orderBy("place").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.status)
    assert got == {"cut.gz": ["whole", "cut"], "short": ["cut"], "bare": ["whole", "cut"], "noise": ["cut"]}


@pytest.mark.parametrize("step", [1, 7, 64, 5000])
def test_framing_by_pieces(step):
    data = b"\r\n\r\n".join(FILE) + b"\r\n\r\n"
    assert [r for _, r in warc.framed(data[k : k + step] for k in range(0, len(data), step))] == FILE
    packed = b"".join(gzip.compress(f + b"\r\n\r\n") for f in FILE)
    assert b"".join(warc.inflated(memoryview(packed), step)) == data


def test_header_blocks_of_any_length(spark):
    """Behind a field of 70,000 characters and 12,000 lines the entity tag still counts."""
    http = "HTTP/1.1 200 OK\r\nX-Long: " + "x" * 70_000 + "\r\n" + "".join(f"broken line {k}\r\n" for k in range(12_000)) + 'ETag: "end"\r\n\r\n' + "body" * 10
    df = spark.createDataFrame([(record("response", "<urn:n:7>", "http://a.org/", "2026-01-01T00:00:00Z", http).decode(),)], "record string")
    row = warc.parse_records(df).first()
    assert row.etag == '"end"' and len(row.headers["x-long"]) == 70_000 and row.record_id == 7


def test_a_hot_url_is_spread_over_slices(spark):
    rng = random.Random(3)
    rows = [(k, "http://hot/" if k % 3 else f"http://h/{k % 7}", rng.randrange(10**6), rng.choice(["response", "revisit"]), "t", None, None, None) for k in range(900)]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema), 16).collect()
    for r in got:
        own = next(x for x in rows if x[0] == r.record_id)
        before = [x for x in rows if x[3] == "response" and x[1] == own[1] and (x[2], x[0]) < (own[2], own[0])]
        assert r.refers_to == (max(before, key=lambda x: (x[2], x[0]))[0] if before else None)


def test_null_ids_and_times(spark):
    rows = [(None, "http://a/", 5, "response", "t", None, None, None), (2, "http://a/", 5, "revisit", "t", None, None, None), (None, "http://a/", None, "revisit", "t", None, None, None)]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id or 0, r.refers_to, r.outcome) for r in got) == [(0, None, "unresolved"), (2, None, "resolved")]
