"""Layouts of files by time against a plain version of the rules in loops."""

import calendar
import datetime as dt
import hashlib
import os
import random
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq

from textloom.llm import time_parts

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def moment_of(row):
    if row[1] is None:
        return None
    k = zlib.crc32(str(row[0]).encode()) % 128 if row[0] is not None else 64
    if k < 16:
        return row[1] - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = dt.datetime(row[1].year, row[1].month, row[1].day)
        return day - dt.timedelta(days=day.weekday())
    return row[1]


def children(path):
    if len(path) == 1:
        return [(*path, m) for m in range(1, 13)]
    if len(path) == 2:
        return [(*path, d) for d in range(1, calendar.monthrange(*path)[1] + 1)]
    return [(*path, h) for h in range(24)]


def leaves_by_loops(rows, most):
    """{leaf: its rows} by the rules, node by node."""
    timed = [(moment_of(r), r) for r in rows if r[1] is not None]
    out = {"null": [r for r in rows if r[1] is None]}
    under = lambda path: [r for m, r in timed if (m.year, m.month, m.day, m.hour)[: len(path)] == path]

    def place(siblings):
        runs, before = [], False
        for path in siblings:
            own = under(path)
            if len(own) > most and len(path) < 4:
                place(children(path))
                before = False
            elif len(own) > most:
                runs.append([path, path, own])
                before = False
            elif before and len(runs[-1][2]) + len(own) <= most:
                runs[-1] = [runs[-1][0], path, runs[-1][2] + own]
            else:
                runs.append([path, path, own])
                before = True
        for first, last, own in runs:
            digits = lambda p: [f"{x:0{4 if i == 0 else 2}d}" for i, x in enumerate(p)]
            out["/".join([*digits(first)[:-1], digits(first)[-1] + "-" + digits(last)[-1]])] = own

    if timed:
        years = [m.year for m, _ in timed]
        place([(y,) for y in range(min(years), max(years) + 1)])
    return {name: own for name, own in out.items() if own}


def key(row):
    low = lambda x: (x is not None, x)
    return tuple(map(low, (moment_of(row), row[2], row[0], *row[1:2], *row[3:])))


def files_by_loops(rows, most):
    out = {}
    for leaf, own in leaves_by_loops(rows, most).items():
        own = sorted(own, key=key)
        for at in range(0, len(own), most):
            out[leaf, at // most + 1] = own[at : at + most]
    return out


def digest(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def check(spark, tmp_path, rows, share=800):
    folder = str(tmp_path / f"files{random.random()}")
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = time_parts.clicks_laid_out(clicks, folder, share).collect()
    most = 1 + len(rows) // share
    early = lambda r: r[2] is not None and r[2] < dt.datetime(2024, 4, 1)
    first, last = files_by_loops([r for r in rows if early(r)], most), files_by_loops(rows, most)
    assert {(r.leaf, r.part) for r in got} == set(last) and len(got) == len(last)
    for r in got:
        own = last[r.leaf, r.part]
        stays = Counter(own) == Counter(first.get((r.leaf, r.part), ()))
        assert (r.n_rows, r.n_new, r.rewritten, r.ids_sha256) == (len(own), sum(not early(x) for x in own), not stays, digest(own))
        there = pq.read_table(unquote(urlparse(r.path).path), partitioning=None)
        assert there.column_names == clicks.columns
        assert list(zip(*(there[c].to_pylist() for c in clicks.columns))) == own
    on_disk = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert {os.path.realpath(f) for f in on_disk} == {os.path.realpath(unquote(urlparse(r.path).path)) for r in got}
    return got


def clicks(rng, n):
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.uniform(0, 150 * 86400) if rng.random() > 0.3 else rng.uniform(0, 7000))
        arrived = ts + dt.timedelta(seconds=rng.randrange(4000))
        rows.append((i, ts, arrived, i % 5, rng.choice("abc"), i / 3, None))
    return rows


def test_equals_the_rules_in_loops(spark, tmp_path):
    rng = random.Random(1)
    rows = clicks(rng, 1500)
    for i in rng.sample(range(1500), 60):
        rows[i] = (rows[i][0], None, *rows[i][2:])
    rows += rng.sample(rows, 40) + [(9000 + i, *[dt.datetime(2024, 8, 1 + i)] * 2, 1, "a", 1.0, None) for i in range(12)]
    got = check(spark, tmp_path, rows, share=60)
    kinds = Counter(r.leaf.count("/") for r in got)
    assert set(kinds) == {0, 1, 2, 3} and {r.rewritten for r in got} == {True, False}
    assert max(r.part for r in got) > 3


def test_equal_rows_and_moments(spark, tmp_path):
    """A third of all rows are one row; others share a moment; some lack an id or an arrival."""
    rng = random.Random(2)
    rows = clicks(rng, 200)
    rows += [(7000, dt.datetime(2024, 2, 5), dt.datetime(2024, 2, 5, 1), 1, "a", 1.0, "{}")] * 100
    rows += [(8000 + i % 3, dt.datetime(2024, 3, 4, 5), dt.datetime(2024, 3, 4, 6) if i % 2 else None, i, None, None, None) for i in range(30)]
    rows += [(None, dt.datetime(2024, 3, 4, 5, 59, 59, 999999), dt.datetime(2024, 5, 1), 3, "x", 2.0, None), (None, None, None, None, None, None, None)]
    check(spark, tmp_path, rows, share=20)


def test_small_tables(spark, tmp_path):
    day = dt.datetime(2024, 4, 2, 10)
    check(spark, tmp_path, [])
    check(spark, tmp_path, [(1, None, None, 1, "a", 1.0, None)])
    check(spark, tmp_path, [(1, day, day, 1, "a", 1.0, None), (2, day - dt.timedelta(days=9000), day - dt.timedelta(days=30), 1, "a", 1.0, None)])


def test_other_columns_and_names(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3), i % 4, "p") for i in range(40)]
    df = spark.createDataFrame(rows, "file long, `a.b` timestamp_ntz, layout_file int, place string")
    files = time_parts.lay_out(df, time_parts.local_micros(df["`a.b`"]), str(tmp_path / "x"), 9, order=["layout_file"], id_col="file").collect()
    assert sum(r.n_rows for r in files) == 40 and all(r.n_rows <= 9 for r in files)
    read = [x for r in files for x in pq.read_table(unquote(urlparse(r.path).path), partitioning=None)["file"].to_pylist()]
    assert sorted(read) == list(range(40))


def test_moments_before_1970_and_in_any_zone(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 31, 2, 30), dt.datetime(1900, 2, 28, 23), dt.datetime(4, 2, 29, 1, 2, 3)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = df.select(time_parts.local_micros(df.t).alias("m")).select("m", time_parts.hour_node(spark_col("m")).alias("node"), time_parts.node_start(time_parts.hour_node(spark_col("m"))).alias("start")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for t, r in zip(times, got):
        assert r.m == (t - EPOCH) // dt.timedelta(microseconds=1)
        assert r.node == int(f"{t.year}{t.month:02d}{t.day:02d}{t.hour:02d}")
        assert r.start == (t.replace(minute=0, second=0, microsecond=0) - EPOCH) // dt.timedelta(microseconds=1)


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
