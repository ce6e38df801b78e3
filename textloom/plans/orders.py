"""Registered queries of ordered choices: exact folds over given tables, with DuckDB statements that step through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parts
from ..operators import corpus, folds, graphs, training
from .oracles import OFFSETS
from .oracles import ORACLE_SQL as CORE_SQL
from .queries import _table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE b AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(n_chars))) AS BIGINT) END AS bucket,
  row_number() OVER (PARTITION BY CASE WHEN n_chars <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(n_chars))) AS BIGINT) END ORDER BY doc_id) AS k FROM documents WHERE n_chars > 0),
f AS (SELECT bucket, k, doc_id, n, CAST(n AS BIGINT) AS filled, CAST(0 AS BIGINT) AS batch FROM b WHERE k = 1
  UNION ALL SELECT b.bucket, b.k, b.doc_id, b.n, CASE WHEN f.filled + b.n > 20000 THEN b.n ELSE f.filled + b.n END, f.batch + CAST(f.filled + b.n > 20000 AS BIGINT)
  FROM f JOIN b ON b.bucket = f.bucket AND b.k = f.k + 1)
SELECT doc_id, bucket, batch FROM f""")
def greedy_length_batches(spark, sf):
    """Documents of like length (powers of two) in batches of 20,000 characters at most, one filled after the other."""
    n = F.col("n_chars")
    bucket = F.when(n <= 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(n)))).cast("long")
    docs = _table(spark, sf, "documents").where("n_chars > 0").select("doc_id", n.cast("long").alias("n"), bucket.alias("bucket"))
    return folds.greedy_batches(docs, ["bucket"], "doc_id", "n", 20_000).select("doc_id", "bucket", "batch")


@query("""WITH RECURSIVE d AS (SELECT lang AS language, text, max(doc_id) AS made, arg_max(source, doc_id) AS family FROM documents WHERE length(text) > 0 AND lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, text),
t AS (SELECT made, family, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units, row_number() OVER (PARTITION BY family ORDER BY made DESC) AS turn, max(made) OVER (PARTITION BY family) AS newest FROM d),
o AS MATERIALIZED (SELECT made, units, turn, row_number() OVER (ORDER BY turn, newest DESC, family) AS k FROM t WHERE turn <= 256),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS made, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS turn, false AS taken, false AS ended
  UNION ALL SELECT o.k, o.made, CASE WHEN (NOT f.ended AND o.turn <= f.turn + 1 AND f.n < 256 AND f.used + o.units <= 200000) THEN f.used + o.units ELSE f.used END, f.n + CAST((NOT f.ended AND o.turn <= f.turn + 1 AND f.n < 256 AND f.used + o.units <= 200000) AS BIGINT), CASE WHEN (NOT f.ended AND o.turn <= f.turn + 1 AND f.n < 256 AND f.used + o.units <= 200000) THEN o.turn ELSE f.turn END, (NOT f.ended AND o.turn <= f.turn + 1 AND f.n < 256 AND f.used + o.units <= 200000), f.ended OR o.turn > f.turn + 1
  FROM f JOIN o ON o.k = f.k + 1)
SELECT made, CAST(n - 1 AS INTEGER) AS place FROM f WHERE taken""")
def diverse_documents(spark, sf):
    """Documents as failures of a source: the latest of each text, sources in turns, in 200,000 units."""
    d = _table(spark, sf, "documents").where("length(text) > 0 AND lang IS NOT NULL AND source IS NOT NULL")
    entries = d.select(F.col("lang").alias("language"), F.col("source").alias("family"), F.sha2("text", 256).alias("source_sha256"), F.col("doc_id").alias("created_at"), F.col("text").alias("source"))
    return training.diverse_failures(entries, 256, 200_000).select(F.col("created_at").alias("made"), "place")


@query("""WITH RECURSIVE r AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE n_chars IS NOT NULL),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, [0::BIGINT, 0, 0, 0, 0, 0, 0] AS loads, 0 AS bin
  UNION ALL SELECT r.k, r.doc_id, list_transform(f.loads, lambda x, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN x + r.n ELSE x END), list_position(f.loads, list_min(f.loads)) - 1
  FROM f JOIN r ON r.k = f.k + 1)
SELECT doc_id, CAST(bin AS INTEGER) AS bin FROM f WHERE k > 0""")
def least_loaded_bins(spark, sf):
    """Documents by falling length, each to the least loaded of seven bins."""
    return folds.least_loaded(_table(spark, sf, "documents"), "doc_id", "n_chars", 7).select("doc_id", "bin")


@query("""WITH u AS (SELECT doc_id, lang, (CAST('0x' || substr(md5('5:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0 AS u, greatest(1.0, n_chars / 1000.0) AS w FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ln(u) / w DESC, doc_id) AS turn, min(doc_id) OVER (PARTITION BY lang) AS first FROM u)
SELECT doc_id, turn, row_number() OVER (ORDER BY turn, first, doc_id) AS place FROM t""")
def weighted_family_turns(spark, sf):
    """Documents with languages in turns, longer ones earlier by chance."""
    d = _table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return folds.weighted_turns(d, "doc_id", "lang", F.col("n_chars") / 1000.0, 5).select("doc_id", "turn", "place")


ALIASES = """p AS (SELECT client_id AS node, CASE WHEN master_id <> client_id THEN master_id WHEN client_id % 4 = 0 THEN NULL ELSE (client_id * 7 + 5) % 1009 END AS alias FROM clients)"""


def _aliases(spark, sf):
    """Clients stand for their master, and some masters for another client, in cycles too."""
    c, m = F.col("client_id"), F.col("master_id")
    alias = F.when(m != c, m).when(c % 4 == 0, F.lit(None)).otherwise((c * 7 + 5) % 1009)
    return _table(spark, sf, "clients").select(c.alias("node"), alias.alias("alias"))


@query(f"""WITH RECURSIVE {ALIASES}, q AS (SELECT node, min(CASE WHEN alias <> node THEN alias END) AS alias FROM p GROUP BY node),
w AS (SELECT node AS start, node AS here, 0 AS steps, [node] AS seen FROM q
  UNION ALL SELECT w.start, q.alias, w.steps + 1, list_append(w.seen, q.alias) FROM w JOIN q ON q.node = w.here WHERE q.alias IS NOT NULL AND NOT list_contains(w.seen, q.alias)),
e AS (SELECT start, arg_max(here, steps) AS here, max(steps) AS steps FROM w GROUP BY start)
SELECT start AS node, CASE WHEN q.alias IS NULL THEN here END AS root, CASE WHEN q.alias IS NULL THEN CAST(steps AS BIGINT) END AS steps, q.alias IS NOT NULL AS cyclic FROM e LEFT JOIN q ON q.node = e.here""")
def alias_roots(spark, sf):
    return graphs.resolved(_aliases(spark, sf), "node", "alias")


@query(f"""WITH RECURSIVE {ALIASES}, r AS (SELECT client_id AS node, 0 AS depth FROM clients WHERE segment = 'retail'
  UNION SELECT p.alias, r.depth + 1 FROM r JOIN p ON p.node = r.node WHERE p.alias IS NOT NULL AND r.depth < 60)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def alias_closure(spark, sf):
    """All that clients of one segment stand for, over any number of steps."""
    starts = _table(spark, sf, "clients").where("segment = 'retail'").select(F.col("client_id").alias("node"))
    return graphs.closure(_aliases(spark, sf).select("node", F.col("alias").alias("next")), starts)


@query("SELECT item_id, brand, row_number() OVER (PARTITION BY brand ORDER BY icu_sort_key(name, 'root'), item_id) AS place FROM items")
def locale_order(spark, sf):
    """Items of a brand in the order of their names as dictionaries have it."""
    items = _table(spark, sf, "items").select("item_id", "brand", "name")
    return folds.ranked(items, ["brand"], [F.collate("name", "UNICODE"), F.asc("item_id")], "place").select("item_id", "brand", "place")


@query(CORE_SQL["part_kind_counts"])
def sql_part_counts(spark, sf):
    """``part_kind_counts`` in SQL, by the table function."""
    parts.register_functions(spark)
    return spark.sql(
        "SELECT lang, kind, count(*) AS n_parts, sum(units) AS n_units FROM {docs} d, LATERAL text_parts(d.text) p GROUP BY lang, kind",
        docs=_table(spark, sf, "documents"),
    )


@query(f"""WITH {OFFSETS}, e AS (SELECT doc_id, max(stop) AS end FROM o GROUP BY doc_id),
c AS (SELECT doc_id, unnest(range(0, CAST(floor((e.end - 1) / 90) AS BIGINT) + 1)) * 90 AS a FROM e),
g AS (SELECT doc_id, a, least(a + 20, e.end) AS z FROM c JOIN e USING (doc_id)),
h AS (SELECT doc_id, i, value FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = o.doc_id AND g.a < o.stop AND g.z > o.start)),
v AS (SELECT doc_id, string_agg(value, chr(1) ORDER BY i) AS code FROM h GROUP BY doc_id),
n AS (SELECT doc_id, max(stop) AS units, count(*) AS n FROM o GROUP BY doc_id),
s AS (SELECT n.doc_id, d.lang, coalesce(code, '') AS code FROM n JOIN documents d USING (doc_id) LEFT JOIN v USING (doc_id) WHERE units >= 128 AND n >= 16)
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY coalesce(lang, ''), code""")
def labelled_dedup(spark, sf):
    """Documents that differ in comments alone, the first of each; 20 of every 90 units are labelled comments."""
    d = _table(spark, sf, "documents")
    ends = d.select("doc_id", parts.units_of(F.coalesce("text", F.lit(""))).alias("end")).where("end > 0")
    turns = ends.select("doc_id", "end", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - 1) / 90))).alias("k"))
    labels = turns.select("doc_id", (F.col("k") * 90).alias("start"), F.least(F.col("k") * 90 + 20, F.col("end")).alias("stop"))
    found = corpus.labelled_digests(d, labels, "lang").where("digest IS NOT NULL")
    return found.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")
