"""Registered queries that stream the given tables, and their DuckDB statements.

Each writes its source, checkpoint and results to a new folder and leaves it there, and starts
its stream several times on one checkpoint, as after a failure.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.parts import part_values
from ..sources.folders import new_folder
from ..streaming import stateful
from .oracles import ORACLE_SQL as CORE_SQL
from .oracles import PATTERN, q
from .queries import KIND_COLUMNS, _table, kind_class, kind_classes
from .records import ORACLE_SQL as RECORD_SQL

def _buckets(rows, each):
    """Buckets of state of about ``each`` rows, so that what one holds doesn't grow with the table."""
    return max(32, -(-rows.count() // each))


def streamed_spans(spark, sf):
    """Spans of all documents, from chunks of parts that come in any order, every fifth one twice."""
    folder = new_folder(spark)
    buckets = _buckets(_table(spark, sf, "documents"), 2048)
    made = stateful.chunks(_table(spark, sf, "documents"), kind_classes, KIND_COLUMNS)
    mix = F.xxhash64("doc_id", "chunk")
    made.withColumn("mix", mix).write.parquet(f"{folder}/chunks")
    made = spark.read.parquet(f"{folder}/chunks")
    late = F.pmod(F.col("mix"), F.lit(2)) == 1
    arrivals = (made.where(~late), made.where(late | (F.pmod(F.col("mix"), F.lit(5)) == 0)))
    with stateful.rocksdb_state(spark):
        for rows in arrivals:
            rows.drop("mix").write.mode("append").parquet(f"{folder}/source")
            stream = spark.readStream.schema(stateful.CHUNK).parquet(f"{folder}/source")
            out = stateful.streamed_spans(stream, buckets).writeStream.format("parquet").option("path", f"{folder}/spans")
            out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    s = spark.read.schema(stateful.SPAN).parquet(f"{folder}/spans")
    return s.groupBy("doc_id", kind_class("class")).agg(
        F.count("*").alias("n_spans"), F.max(F.col("stop") - F.col("start")).alias("longest"), F.sum(F.col("level") + 1).cast("long").alias("sixteenths")
    )


def streamed_quiet_events(spark, sf):
    """Events that no other one of their user follows within an hour, settled by timers of event time."""
    folder = new_folder(spark)
    events = _table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    buckets = _buckets(events, 8192)
    third = F.floor(F.unix_micros("ts") / (10 * 86_400 * 1_000_000))
    events = events.withColumn("third", third)
    last = events.agg(F.max("ts").alias("ts")).first().ts
    thirds = sorted(r.third for r in events.select("third").distinct().collect())
    ends = spark.createDataFrame([(-1, -1, last + dt.timedelta(days=2))], events.drop("third").schema)
    with stateful.rocksdb_state(spark):
        # The stream's end is an event of nobody, behind which the watermark moves past the last gap.
        for rows in (*(events.where(F.col("third") == t).drop("third") for t in thirds), ends):
            rows.write.mode("append").parquet(f"{folder}/source")
            stream = spark.readStream.schema(ends.schema).parquet(f"{folder}/source")
            quiet = stateful.quiet_events(stream, "user_id", "ts", "event_id", 3600.0, buckets=buckets)
            out = quiet.writeStream.format("parquet").option("path", f"{folder}/quiet").option("checkpointLocation", f"{folder}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    quiet = spark.read.schema(stateful.QUIET).parquet(f"{folder}/quiet")
    return quiet.where("place >= 0").select(F.col("place").alias("event_id"), F.col("key").alias("user_id"))


def _requests(spark, folder, arrivals, rows, schema, **options):
    """The requests of each arrival wait when the stream starts: (done, rejected)."""
    for a in arrivals:
        rows.where(F.col("arrival") == a).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        stateful.run_requests(stream, path=folder, checkpoint=f"{folder}/checkpoint", **options).awaitTermination()
    return (spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{x}") for x in ("done", "rejected"))


def fused_requests(spark, sf):
    """Conversation turns as requests of so many parts, a quarter of the conversations at a time; a turn of 53, 106, ... letters is broken."""
    folder = new_folder(spark)
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.greatest(F.size(part_values(text)), F.lit(1)).cast("long").alias("parts"),
        F.char_length(text).alias("letters"), (F.col("conv_id") % 4).cast("int").alias("arrival"),
    )
    rows = rows.groupBy("id", "arrival").agg(F.max("parts").alias("parts"), F.max("letters").alias("letters"))
    broken = (F.col("letters") > 0) & (F.col("letters") % 53 == 0)
    done, rejected = _requests(
        spark, folder, range(4), rows, rows.schema, order="id", parts="parts", broken=broken, most=1024,
        work=lambda good: good.select("id", "arrival", "fused", "parts"),
    )
    cells = rows.select("id", "arrival", "parts")
    rejected = rejected.join(cells, "id").select("id", "arrival", "fused", "parts")
    return done.withColumn("done", F.lit(True)).unionByName(rejected.withColumn("done", F.lit(False)))


def latest_requests(spark, sf):
    """Events as requests for their user: of those that wait, the last one of each user runs."""
    folder = new_folder(spark)
    rows = _table(spark, sf, "events").select("event_id", "user_id", F.char_length("props").cast("long").alias("parts"), (F.dayofmonth("ts") % 3).alias("arrival"))
    done, _ = _requests(
        spark, folder, range(3), rows, rows.schema, order="event_id", parts="parts", key="user_id", broken=F.col("parts") < 0, most=400,
        work=lambda good: good.select("event_id", "user_id", "arrival", "fused"),
    )
    return done


QUERIES = {f.__name__: f for f in (streamed_spans, streamed_quiet_events, fused_requests, latest_requests)}

FUSED = """WITH RECURSIVE r AS ({rows}),
f AS (SELECT arrival, k, id, parts, parts AS filled, CAST(0 AS BIGINT) AS fused FROM r WHERE k = 1
  UNION ALL SELECT r.arrival, r.k, r.id, r.parts, CASE WHEN f.filled >= {most} THEN 0 ELSE f.filled END + r.parts, f.fused + CAST(f.filled >= {most} AS BIGINT)
  FROM f JOIN r ON r.arrival = f.arrival AND r.k = f.k + 1)"""
TURNS = f"""SELECT conv_id * 1000 + turn AS id, CAST(conv_id % 4 AS INTEGER) AS arrival, greatest(len(regexp_extract_all(coalesce(text, ''), {q(PATTERN)}, 0)), 1) AS parts,
  length(coalesce(text, '')) AS letters, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id * 1000 + turn) AS k FROM conversations"""
LAST = """SELECT arrival, id, user_id, parts, row_number() OVER (PARTITION BY arrival ORDER BY id) AS k
  FROM (SELECT CAST(day(ts) % 3 AS INTEGER) AS arrival, user_id, max(event_id) AS id, arg_max(length(props), event_id) AS parts FROM events GROUP BY ALL)"""

ORACLE_SQL = {
    "streamed_spans": CORE_SQL["kind_spans"],
    "streamed_quiet_events": RECORD_SQL["debounced_events"],
    "fused_requests": FUSED.format(rows=TURNS, most=1024) + """,
b AS (SELECT f.*, max(CAST(letters > 0 AND letters % 53 = 0 AS INTEGER)) OVER (PARTITION BY f.arrival, fused) AS bad FROM f JOIN (SELECT id, letters FROM r) USING (id))
SELECT id, arrival, fused, CAST(parts AS BIGINT) AS parts, bad = 0 AS done FROM b""",
    "latest_requests": FUSED.format(rows=LAST, most=400) + " SELECT f.id AS event_id, r.user_id, f.arrival, fused FROM f JOIN r USING (arrival, k)",
}
