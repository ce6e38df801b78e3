"""Not-modified revisit resolution for web captures, from WARC records on.

``parse_records`` reads a record's WARC fields and its HTTP status line and fields; a record
that is none, of another type, or a response whose status is not 200, gives no row.

A revisit record holds no body; it stands for the latest earlier full response of the
same canonical URL. That as-of join runs as windows over (URL, time slice): within a
slice the last response before each record, and across slices the last response of any
earlier slice, carried over from one row per URL and slice. A URL that holds a third of
all records is thus spread over ``slices`` tasks. Slices are cut at quantiles of time.

The response found must agree with the revisit: equal entity tags if both have one (weak
tags compare without their prefix), else equal modification dates if both have one, else
equal payload digests. Then the outcome is ``resolved`` and the headers are those of the
response, replaced by the ones of the revisit that a 304 answer may carry. Otherwise it is
``mismatch``, or ``unresolved`` where there is no earlier response, with the permitted
headers of the revisit alone.

Records of equal time are ordered by id, null ids and null times first. A null URL matches nothing. Repeated records are
resolved each on its own. Null header maps count as empty; header names are lower-cased,
and of names equal but for case the first stays. An empty table gives no rows; a very long URL,
field or body is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: The fields that a 304 answer may carry to update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without trailing slashes, query without tracking."""
    host = F.lower(F.regexp_extract(url, SCHEME + "([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, SCHEME + "[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(SCHEME), whole).otherwise(url)


def _first_of(entries: Column) -> Column:
    """A map of (key, value) structs in which the first of equal keys stays."""
    return F.map_from_entries(
        F.aggregate(
            entries,
            F.array().cast("array<struct<key:string,value:string>>"),
            lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)),
        )
    )


def _clean(headers: Column) -> Column:
    """Header names lower-cased; null maps empty; the first of equal names stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return _first_of(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def _fields(block: Column) -> Column:
    """The ``Name: value`` lines of a header block, below its first line, as a map by lower-cased name."""
    lines = F.split(block, "\r\n")
    lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.contains(x, F.lit(":")))
    return _first_of(
        F.transform(
            lines,
            lambda x: F.struct(
                F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")
            ),
        )
    )


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """The columns that ``resolve_revisits`` reads, of WARC records given as strings. Row-local.

    ``record_uri`` is the record's whole id, ``record_id`` the number at its end (null where none
    is or it has letters beside it), ``micros`` its date in microseconds, ``ts`` in seconds.
    Each step gives an array of at most one element per record, so nothing is computed twice.
    """
    gap = "\r\n\r\n"
    whole = F.coalesce(F.col(column).cast("string"), F.lit(""))
    heads = records.select(F.inline(F.filter(F.array(F.struct(whole.alias("whole"))), lambda r: r["whole"].startswith("WARC/1."))))
    heads = heads.select("whole", F.substring_index("whole", gap, 1).alias("head"))
    rows = heads.select(
        F.inline(
            F.array(
                F.struct(
                    _fields(F.col("head")).alias("warc"),
                    F.substring_index(F.substr("whole", F.char_length("head") + len(gap) + 1), gap, 1).alias("http"),
                )
            )
        )
    )
    known = lambda r: (r["kind"] == "revisit") | ((r["kind"] == "response") & (r["status"] == "200"))
    parsed = F.struct(
        F.col("warc")["warc-type"].alias("kind"), F.regexp_extract("http", r"^HTTP/\S+ (\d{3})", 1).alias("status"), "warc", _fields(F.col("http")).alias("headers")
    )
    field = F.col("warc")
    return rows.select(F.inline(F.filter(F.array(parsed), known))).select(
        field["warc-record-id"].alias("record_uri"),
        F.regexp_extract(field["warc-record-id"], r"(?:^|[^0-9A-Za-z])(\d+)>?$", 1).try_cast("long").alias("record_id"),
        field["warc-target-uri"].alias("url"),
        F.unix_timestamp(field["warc-date"].try_cast("timestamp")).alias("ts"),
        F.unix_micros(field["warc-date"].try_cast("timestamp")).alias("micros"),
        "kind",
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("last_modified"),
        field["warc-payload-digest"].alias("digest"),
        "headers",
    )


RECORD_END = b"\r\n\r\n"


def framed(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """(status, record) of a WARC file's bytes: each header and as many bytes as its Content-Length says.

    The status is ``whole``, or ``cut`` for a last record that the file ends in, or one without
    a length, with which reading ends.
    """
    held = b""
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        held += piece or b""
        return piece is not None

    while True:
        seen = 0
        while True:
            if held[:1] in (b"\r", b"\n"):
                held, seen = held.lstrip(b"\r\n"), 0
            end = held.find(RECORD_END, seen)
            seen = max(0, len(held) - 3)
            if end >= 0 or not more():
                break
        if end < 0:
            if held:
                yield "cut", held
            return
        length = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", held[:end])
        stop = end + len(RECORD_END) + int(length[1]) if length else -1
        parts, size = [held], len(held)
        while stop > size and (piece := next(pieces, None)) is not None:
            parts.append(piece)
            size += len(piece)
        held = b"".join(parts)
        if stop < 0 or stop > size:
            yield "cut", held
            return
        yield "whole", held[:stop]
        held = held[stop:]


def inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of gzip members one after the other or plain, in pieces of bounded size."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield bytes(data[at : at + step])
        return
    at, member, rest = 0, zlib.decompressobj(31), b""
    while True:
        if not rest:
            if at >= len(data):
                return
            rest, at = bytes(data[at : at + step]), at + step
        try:
            piece = member.decompress(rest, step)
        except zlib.error:
            return
        if piece:
            yield piece
        rest = member.unconsumed_tail
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(31)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, status, record) of the WARC files under a path, gzip members or plain.

    A file is read by one task (Spark's binary source holds files of up to 2 GB; archives are
    cut at half of that), member by member and record by record. Bytes that are no UTF-8 become
    replacement characters. What follows a broken member or a record without a length is lost,
    and the record it breaks in has the status ``cut``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for place, (status, record) in enumerate(framed(inflated(memoryview(content.as_buffer())))):
                    cells = [pa.array([name]), pa.array([place], pa.int64()), pa.array([status]), pa.array([record.decode("utf-8", "replace")])]
                    yield pa.RecordBatch.from_arrays(cells, names=["path", "place", "status", "record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, "path string, place long, status string, record string")


def resolve_revisits(records: DataFrame, slices: int = 64, *, id_col: str = "record_id", time_col: str = "ts") -> DataFrame:
    """One row per revisit of (record_id, url, ts, kind, etag, last_modified, digest, headers).

    kind is ``response`` or ``revisit``; other records are passed over. Ids are of any type that
    has an order, times whole numbers of any unit (``record_uri`` and ``micros`` of parsed
    records, for files whose ids are UUIDs). Result: record_id, canonical_url, refers_to,
    outcome, headers.
    """
    rows = records.where("kind IN ('response', 'revisit')").select(
        F.col(id_col).alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col(time_col).cast("long").alias("ts"),
        "kind", "etag", "last_modified", "digest",
        _clean(F.col("headers")).alias("headers"),
    )
    cuts = rows.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col("ts")))
    rows = rows.select(
        "*",
        F.coalesce("canonical_url", F.concat(F.lit("\x00"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).alias("key"),
        place.alias("slice"),
        F.when(
            F.col("kind") == "response",
            F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"),
        ).alias("full"),
    )
    before = Window.partitionBy("key", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(before)).where("kind = 'revisit'").drop("full")
    ends = rows.where("full IS NOT NULL").groupBy("key", "slice").agg(
        F.max_by("full", F.struct("ts", "record_id")).alias("end")
    )
    asked = near.where("near IS NULL").select("key", "slice").distinct()
    spans = asked.join(ends, ["key", "slice"], "full_outer")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "slice", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["key", "slice"], "left").withColumn("hit", F.coalesce("near", "carried"))

    tag = lambda c: F.regexp_replace(c, "^W/", "")
    hit = F.col("hit")
    agrees = (
        F.when(F.col("etag").isNotNull() & hit["etag"].isNotNull(), tag(F.col("etag")) == tag(hit["etag"]))
        .when(F.col("last_modified").isNotNull() & hit["last_modified"].isNotNull(), F.col("last_modified") == hit["last_modified"])
        .otherwise(F.coalesce(F.col("digest") == hit["digest"], F.lit(False)))
    )
    outcome = F.when(hit.isNull(), "unresolved").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    found = found.select("*", outcome.alias("outcome"), allowed.alias("sent"))
    kept = F.map_filter(hit["headers"], lambda k, _: ~F.map_contains_key("sent", k))
    return found.select(
        "record_id",
        "canonical_url",
        hit["record_id"].alias("refers_to"),
        "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, F.col("sent"))).otherwise(F.col("sent")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """WARC records made of ``pages``, which hold no crawl log of their own: (record).

    Of page p, the record numbered 10p + k is of that second. k = 0 (but where p mod 7 is 6)
    and, with a changed body, k = 4 (but where p mod 3 is 0) are full responses; k = 2, 6 and
    (where p mod 5 is 0) 8 are revisits. Later ones reach the page by other forms of its URL.
    By p mod 4 the validator is an entity tag (weak in the first response), a modification date,
    a digest alone, or the tag of the first response, which the second one makes stale.
    """
    p, k = F.col("p"), F.col("k")
    asked = F.array(
        *(F.when(rule, F.lit(i)) for i, rule in ((0, p % 7 != 6), (4, p % 3 != 0), (2, F.lit(True)), (6, F.lit(True)), (8, p % 5 == 0)))
    )
    rows = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.where("p IS NOT NULL").withColumn("k", F.explode(F.array_compact(asked)))
    full = k.isin(0, 4)
    of = F.when(full, k).when((k > 4) & (p % 3 != 0), 4).otherwise(0)  # the response that a record is, or stands for
    tag = lambda n: F.concat(F.lit('"'), F.md5(F.concat("html", F.when(n == 4, "!").otherwise(""))), F.lit('"'))
    date = lambda n: F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(10 * p + n), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    etag = F.when(p % 4 == 0, F.concat(F.when(k == 0, "W/").otherwise(""), tag(of))).when(p % 4 == 3, F.when(full, tag(of)).otherwise(tag(F.lit(0))))
    changed = F.when(p % 4 == 1, date(of))
    digest = F.when(full | (p % 4 == 2), F.concat(F.lit("md5:"), tag(of)))
    body = F.when(full, F.concat("html", F.when(of == 4, "!").otherwise(""))).otherwise("")
    url = F.when(k.isin(4, 6), F.concat("url", F.lit("#part"))).when(k == 8, F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    blank = F.lit("\r\n")
    http = F.concat_ws(
        "", F.when(full, "HTTP/1.1 200 OK\r\n").otherwise("HTTP/1.1 304 Not Modified\r\n"), F.when(full, "Content-Type: text/html\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")), line("Date", date(k)), line("ETag", etag), line("Last-Modified", changed),
        F.when(~full, "Cache-Control: max-age=60\r\n"), blank, body,
    )
    rows = rows.select(
        http.alias("http"), F.when(full, "response").otherwise("revisit").alias("kind"), (10 * p + k).cast("string").alias("id"),
        F.coalesce(url, F.col("url")).alias("url"), date(k).alias("date"), digest.alias("digest"),
    )
    return rows.select(
        F.concat_ws(
            "", F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), "id", F.lit(">"))),
            line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("digest")),
            line("Content-Length", F.octet_length("http").cast("string")), blank, F.col("http"),
        ).alias("record")
    )


def op7_revisits(spark, sf_dir: str) -> DataFrame:
    """Query: the revisits among the WARC records made of all ``pages``."""
    records, _ = stored(parse_records(captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))))  # read three times below
    out = resolve_revisits(records, time_col="micros")
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("headers", joined)


OP7_SQL = r"""
WITH p AS (
  SELECT page_id AS p, url, md5(coalesce(html, '')) AS tag0, md5(coalesce(html, '') || '!') AS tag4, strlen(coalesce(html, '')) AS n
  FROM pages WHERE page_id IS NOT NULL
), r AS (
  SELECT p.*, k.k, 10 * p + k.k AS id, CASE WHEN k.k > 4 AND p % 3 <> 0 THEN 4 WHEN k.k = 4 THEN 4 ELSE 0 END AS o,
    CASE WHEN k.k IN (4, 6) THEN url || '#part' WHEN k.k = 8 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x' ELSE url END AS u
  FROM p, (VALUES (0), (2), (4), (6), (8)) k(k)
  WHERE NOT (k.k = 0 AND p % 7 = 6) AND NOT (k.k = 4 AND p % 3 = 0) AND NOT (k.k = 8 AND p % 5 <> 0)
), c AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
      regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '')
      || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
      || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE u END AS canon
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM r)
), d AS (
  SELECT id, k, canon, CASE WHEN o = 4 THEN tag4 ELSE tag0 END AS body_tag,
    CASE p % 4 WHEN 0 THEN CASE WHEN k = 0 THEN 'W/' ELSE '' END || '"' || CASE WHEN o = 4 THEN tag4 ELSE tag0 END || '"'
               WHEN 3 THEN '"' || CASE WHEN k = 4 THEN tag4 ELSE tag0 END || '"' END AS etag,
    CASE WHEN p % 4 = 1 THEN strftime(make_timestamp((10 * p + o) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS changed,
    strftime(make_timestamp(id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS said, p % 4 = 2 AS by_digest, n + CASE WHEN o = 4 THEN 1 ELSE 0 END AS size
  FROM c
), j AS (
  SELECT v.*, f.id AS f_id, f.etag AS f_etag, f.changed AS f_changed, f.size AS f_size,
    CASE WHEN f.id IS NULL THEN 'unresolved'
         WHEN CASE WHEN v.etag IS NOT NULL AND f.etag IS NOT NULL THEN ltrim(v.etag, 'W/') = ltrim(f.etag, 'W/')
                   WHEN v.changed IS NOT NULL AND f.changed IS NOT NULL THEN v.changed = f.changed
                   ELSE v.by_digest AND v.body_tag = f.body_tag END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM (SELECT * FROM d WHERE k NOT IN (0, 4)) v ASOF LEFT JOIN (SELECT * FROM d WHERE k IN (0, 4)) f ON v.canon = f.canon AND v.id > f.id
)
SELECT id AS record_id, canon AS canonical_url, f_id AS refers_to, outcome,
  concat_ws(';', 'cache-control=max-age=60', CASE WHEN outcome = 'resolved' THEN 'content-length=' || f_size END,
    CASE WHEN outcome = 'resolved' THEN 'content-type=text/html' END, 'date=' || said,
    'etag=' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, f_etag) ELSE etag END,
    CASE WHEN outcome = 'resolved' THEN 'last-modified=' || f_changed END) AS headers
FROM j
"""
