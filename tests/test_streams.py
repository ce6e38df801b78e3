"""Keyed-state streams: what they give whatever the order of arrival, after restarts too."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import spans
from textloom.plans.queries import KIND_COLUMNS, kind_classes
from textloom.streaming import stateful, streams

DAY = dt.datetime(2024, 3, 1)


def arrive(spark, path, rows, schema, make, sink="parquet"):
    """Each list of rows arrives, the stream runs on what is there and ends; all on one checkpoint."""
    with stateful.rocksdb_state(spark):
        for some in rows:
            spark.createDataFrame(some, schema).coalesce(2).write.mode("append").parquet(f"{path}/source")
            stream = spark.readStream.schema(schema).parquet(f"{path}/source")
            make(stream).writeStream.format(sink).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_spans_of_shuffled_chunks(spark, tmp_path):
    rng = random.Random(3)
    texts = ["let total = 10 + 20 + 30", "x", "a   +   b * 42 - c / 7 + d", "9 9 9 + + + 9", "Word " * 40, " \n"]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (None, "no id")], "doc_id long, text string")
    want = sorted(tuple(r) for r in spans.document_spans(docs.where("doc_id IS NOT NULL"), kind_classes, KIND_COLUMNS).collect())
    rows = [tuple(r) for r in stateful.chunks(docs, kind_classes, KIND_COLUMNS, size=3).collect()]
    assert max(r[1] for r in rows) > 10 and sum(r[2] for r in rows) == len(texts)
    rows += rng.sample(rows, 12)
    rng.shuffle(rows)
    third = len(rows) // 3
    got = arrive(spark, str(tmp_path), [rows[:third], rows[third : 2 * third], rows[2 * third :], rows[:5]], stateful.CHUNK, stateful.streamed_spans)
    assert sorted((r["doc_id"], r["class"], r["start"], r["stop"], r["level"]) for r in got.collect()) == want


def test_open_spans_wait_for_their_last_chunk(spark, tmp_path):
    chunk = lambda k, last, cls, stop: (1, k, last, cls, stop, [4 - k] * len(cls))
    got = arrive(spark, str(tmp_path / "a"), [[chunk(1, False, [2, 2], [7, 9])], [chunk(0, False, [1, 2], [3, 5])]], stateful.CHUNK, stateful.streamed_spans)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0, 3, 4)]
    more = [chunk(0, False, [1, 2], [3, 5]), chunk(1, False, [2, 2], [7, 9])]
    got = arrive(spark, str(tmp_path / "b"), [more, [chunk(2, True, [2, 0], [10, 12])]], stateful.CHUNK, stateful.streamed_spans)
    assert sorted((r["class"], r["start"], r["stop"], r["level"]) for r in got.collect()) == [(0, 10, 12, 2), (1, 0, 3, 4), (2, 3, 10, 2)]


def test_bursts_settle_by_timers(spark, tmp_path):
    rng = random.Random(5)
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [(k, rng.randrange(3), at(rng.randrange(4000))) for k in range(150)] + [(900, 1, at(77)), (901, 1, at(77)), (902, None, at(5)), (903, 2, None)]
    schema = "id long, who long, at timestamp"
    batch = streams.debounced(spark.createDataFrame([r for r in rows if None not in r], schema), "who", "at", 30.0, "id")
    want = sorted((r.who, r.id) for r in batch.collect())
    # Up to 300 seconds out of order.
    rows.sort(key=lambda r: ((r[2] or at(0)) - DAY).total_seconds() + rng.uniform(0, 300))
    arrivals = [rows[k : k + 40] for k in range(0, len(rows), 40)] + [[(-1, -1, at(100_000))]]
    make = lambda s: stateful.quiet_events(s, "who", "at", "id", 30.0, "300 seconds")
    got = arrive(spark, str(tmp_path / "x"), arrivals, schema, make).where("place >= 0").collect()
    assert sorted((r.key, r.place) for r in got) == want
    # Without the end, what may still be followed has not been given out.
    early = arrive(spark, str(tmp_path / "y"), arrivals[:1], schema, make).collect()
    assert len(early) < len(want) and {(r.key, r.place) for r in early} <= set(want)


def requests(spark, path, arrivals, **options):
    schema = "id long, who long, parts long, text string"
    for rows in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/source")
        stream = spark.readStream.schema(schema).parquet(f"{path}/source")
        settings = {"order": "id", "parts": "parts", "broken": F.col("text") == "poison", "work": lambda good: good.select("id", "fused")} | options
        stateful.run_requests(stream, path=path, checkpoint=f"{path}/checkpoint", **settings).awaitTermination()
    read = lambda x: sorted(tuple(r) for r in spark.read.parquet(f"{path}/{x}").select("batch", "id", "fused").collect())
    return read("done"), read("rejected")


def test_a_broken_request_fails_its_batch_alone(spark, tmp_path):
    first = [(k, 1, 10, "poison" if k == 4 else "ok") for k in range(8)]
    done, rejected = requests(spark, str(tmp_path), [first, [(20, 1, 5, "ok")]], most=30)
    assert rejected == [(0, 3, 1), (0, 4, 1), (0, 5, 1)]
    assert done == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 6, 2), (0, 7, 2), (1, 20, 0)]


def test_the_latest_request_wins(spark, tmp_path):
    first = [(k, k % 2, 10, "poison" if k < 4 else "ok") for k in range(8)]
    done, rejected = requests(spark, str(tmp_path), [first, [(9, 0, 5, None), (8, 0, 50, "ok")]], key="who")
    assert done == [(0, 6, 0), (0, 7, 0), (1, 9, 0)] and rejected == []


@pytest.mark.parametrize("limit", [1, 5, 16_384])
def test_admission_closes_with_the_request_that_reaches_the_limit(spark, limit):
    sizes = [3, 1, 1, 5, 9, 1, 16_384, 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, parts long")
    got = [r.fused for r in stateful.fused_batches(df, "id", "parts", limit).orderBy("id").collect()]
    want, number, total = [], 0, 0
    for n in sizes:
        want.append(number)
        total += n
        if total >= limit:
            number, total = number + 1, 0
    assert got == want


def test_row_local_runs_equal_those_of_labelled_tables(spark):
    rng = random.Random(9)
    texts = ["", None, "  ", " a", "A1 b\n\n+", "é 😀 x", *("".join(rng.choice(["ab", "Cd", " ", "\n", "7", "+", "-"]) for _ in range(rng.randrange(60))) for _ in range(30)), "word " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from textloom.functions.parts import part_table

    cols = {"i": "int", "kind": "int", "start": "long", "stop": "long", "flags": "int", "first_char": "int"}
    parts = part_table(docs, columns=cols).toPandas()
    cls, level = kind_classes({c: parts[c].to_numpy() for c in cols})
    labelled = spark.createDataFrame(parts.assign(**{"class": cls, "level": np.asarray(level)}))
    pick = lambda df, *c: sorted(tuple(int(x) for x in r) for r in df.select("doc_id", *c).collect())
    merged = spans.merge_spans(labelled).withColumn("level", F.col("confidence") * 16 - 1)
    assert pick(spans.document_spans(docs, kind_classes, KIND_COLUMNS), "class", "start", "stop", "level") == pick(merged, "class", "start", "stop", "level")
    tiles = spans.merge_spans_lite(labelled.withColumn("class", F.col("class").cast("string"))).withColumn("class", F.when(F.col("class") == "plain", "0").otherwise(F.col("class")))
    assert pick(spans.document_tiles(docs, kind_classes, KIND_COLUMNS), "class", "start", "stop") == pick(tiles, "class", "start", "stop")
    runs = spans.run_lengths(labelled, 16)
    assert pick(spans.document_runs(docs, kind_classes, KIND_COLUMNS, 16), "block", "class", "length") == pick(runs, "block", "class", "length")


class Handle:
    """State and timers of one key in memory; counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = {}, set(), 0

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def exists(self):
                handle.asked += 1
                return name in handle.value

            def get(self):
                handle.asked += 1
                return handle.value.get(name)

            def update(self, value):
                handle.asked += 1
                handle.value[name] = value

            def clear(self):
                handle.asked += 1
                handle.value.pop(name, None)

        return Value()

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, seconds):
        self.now = seconds * 1000

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_of_documents_is_one_step():
    """Calls to the state don't grow with the documents of a bucket."""
    rng, rows, want = random.Random(2), [], set()
    for d in range(2000):
        n = rng.randrange(1, 6)
        runs = [[(rng.randrange(3), rng.randrange(4)) for _ in range(rng.randrange(1, 4))] for _ in range(n)]
        stop, spans_ = 0, []
        for k, part in enumerate(runs):
            stops = [stop := stop + rng.randrange(1, 5) for _ in part]
            rows.append((d, k, k == n - 1, *(np.array(x) for x in ([c for c, _ in part], stops, [v for _, v in part]))))
            for (c, v), z in zip(part, stops, strict=True):
                if spans_ and spans_[-1][0] == c:
                    spans_[-1][2:] = [z, min(v, spans_[-1][3])]
                else:
                    spans_.append([c, spans_[-1][2] if spans_ else 0, z, v])
        want |= {(d, *x) for x in spans_}
    rows += rng.sample(rows, 500)
    rng.shuffle(rows)
    handle, carry, got = Handle(), stateful.SpanCarry(), []
    carry.init(handle)
    for a in range(0, len(rows), 1000):
        some = pd.DataFrame(rows[a : a + 1000], columns=["doc_id", "chunk", "last", "classes", "stops", "levels"])
        for out in carry.handleInputRows((0,), iter([some[:300], some[300:]]), None):
            got += list(out.itertuples(index=False, name=None))
    assert len(got) == len(want) and set(got) == want
    assert handle.asked <= 10 * (len(rows) // 1000 + 1)


def test_a_bucket_of_keys_has_one_timer():
    """Calls to the state don't grow with the keys of a bucket, and one timer waits for all of them."""
    rng = random.Random(4)
    events = sorted({(rng.randrange(500), rng.randrange(40_000) * 1_000_000, p) for p in range(6000)}, key=lambda e: e[1])
    handle, quiet, got = Handle(), stateful.Quiet(30_000_000), []
    quiet.init(handle)
    for k, a in enumerate(range(0, len(events), 1000)):
        some = pd.DataFrame(events[a : a + 1000], columns=["key", "micros", "place"])
        clock = Clock(events[a - 1][1] // 1_000_000 if k else 0)
        for out in quiet.handleInputRows((0,), iter([some]), clock):
            got += list(out.itertuples(index=False, name=None))
        assert len(handle.timers) == 1

    class End:
        def getExpiryTimeInMs(self):
            return next(iter(handle.timers))

    for out in quiet.handleExpiredTimer((0,), Clock(10**6), End()):
        got += list(out.itertuples(index=False, name=None))
    want, by = set(), sorted(events, key=lambda e: (e[0], e[1], e[2]))
    for e, after in zip(by, [*by[1:], (-1, 0, 0)], strict=True):
        if after[0] != e[0] or after[1] - e[1] > 30_000_000:
            want.add(e)
    assert len(got) == len(want) and set(got) == want and handle.asked < 60
