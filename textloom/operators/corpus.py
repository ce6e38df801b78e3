"""Corpus building: deduplication, limits, balanced selection, summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import map_parts, units_of

#: Fixed value: what trimming removes at both ends.
BLANK = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def trimmed(text: Column) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(unix, f"^{BLANK}", ""), f"{BLANK}$", "")


def exact_duplicates(docs: DataFrame, family: str, seq: str) -> DataFrame:
    """One row per different (family, trimmed text): the first ``seq`` and the number of copies.

    Aggregates by digest with partial sums, so a text that fills a third of the corpus
    costs one row per task.
    """
    key = F.sha2(F.concat_ws("\x00", F.col(family), F.lit("source"), trimmed(F.coalesce("text", F.lit("")))), 256)
    return docs.select(key.alias("digest"), seq).groupBy("digest").agg(F.min(seq).alias(seq), F.count("*").alias("copies"))


#: Fixed value: the parts' alternatives but for white space.
SOLID = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[^0-9A-Za-z_\x{80}-\x{10FFFF}\t\x0B\f \r\n]"
#: Comments of most languages at once, for texts of which neither labels nor the language tell.
COMMENTS = r"/\*[\s\S]*?\*/|<!--[\s\S]*?-->|(?m:^|\s)(?://|#)[^\n]*"


def structural_digest(text: Column, family: Column, least_units: int = 128, least_parts: int = 16, comments: str = COMMENTS) -> Column:
    """Digest of the parts that are neither white space nor in a comment; null for texts too short to tell.

    Length is in UTF-16 units and counts the whole text; the parts that must be there may be comments.
    """
    code = F.regexp_extract_all(F.regexp_replace(text, comments, " "), F.lit(SOLID), F.lit(0))
    return F.when(
        (units_of(text) >= least_units) & (F.regexp_count(text, F.lit(SOLID)) >= least_parts),
        F.sha2(F.concat_ws("\x00", family, F.lit("source"), F.array_join(code, "\x00")), 256),
    )


#: The comments of languages; a family that is not here has none.
C_LIKE = r"/\*[\s\S]*?\*/|//[^\n]*"
HASH = r"#[^\n]*"
MARKUP = r"<!--[\s\S]*?-->"
DASHES = r"--[^\n]*"
COMMENTS_OF = {
    "c": C_LIKE, "cpp": C_LIKE, "csharp": C_LIKE, "css": r"/\*[\s\S]*?\*/", "go": C_LIKE, "haskell": r"\{-[\s\S]*?-\}|--[^\n]*", "html": MARKUP, "java": C_LIKE,
    "javascript": C_LIKE, "kotlin": C_LIKE, "lua": r"--\[\[[\s\S]*?\]\]|--[^\n]*", "markdown": MARKUP, "perl": HASH, "php": C_LIKE + "|" + HASH, "python": HASH, "r": HASH,
    "ruby": HASH, "rust": C_LIKE, "scala": C_LIKE, "scss": C_LIKE, "shell": HASH, "sql": r"/\*[\s\S]*?\*/|--[^\n]*", "swift": C_LIKE, "toml": HASH, "typescript": C_LIKE,
    "xml": MARKUP, "yaml": HASH,
}


def structural_digest_of(text: Column, family: Column) -> Column:
    """``structural_digest`` that leaves out the comments of the text's own language only.

    A form counts wherever it stands, in strings too; labels (``labelled_digests``) know better.
    """
    digest = F.lit(None).cast("string")
    for form in sorted(set(COMMENTS_OF.values())):
        named = [f for f, own in COMMENTS_OF.items() if own == form]
        digest = F.when(family.isin(named), structural_digest(text, family, comments=form)).otherwise(digest)
    # What nothing matches keeps all of the text.
    return F.when(family.isin(list(COMMENTS_OF)), digest).otherwise(structural_digest(text, family, comments=r"(?!)"))


def labelled_digests(docs: DataFrame, labels: DataFrame, family: str, least_units: int = 128, least_parts: int = 16) -> DataFrame:
    """(doc_id, digest) of (doc_id, text, family) by its labelled comments (doc_id, start, stop).

    The digest is that of the values of all parts that touch no comment; null for texts of
    fewer units or parts. Labels meet the text by document: each document's comments come to it
    as one list, and the parts are told apart where the text lies.
    """
    spots = labels.where("stop > start").groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("comments"))
    rows = docs.select("doc_id", "text", F.col(family).alias("family")).join(spots, F.col("doc_id") == F.col("_d"), "left").drop("_d")

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        out, at = [], 0
        family, comments = b.column("family").to_pylist(), b.column("comments")
        for k, n in enumerate(sizes.tolist()):
            start, stop = parts["start"][at : at + n], parts["stop"][at : at + n]
            values = parts["value"].slice(at, n)
            at += n
            if n < least_parts or stop[-1] < least_units:
                out.append(None)
                continue
            spans = comments[k].values if comments[k].is_valid else None
            if spans is not None:
                # The furthest end of the comments that begin before a part ends.
                begin, end = (spans.field(c).to_numpy() for c in ("start", "stop"))
                last = np.searchsorted(begin, stop, side="left")
                reach = np.append(0, np.maximum.accumulate(end))[last]
                values = values.filter(pa.array(reach <= start))
            text = "\0".join([family[k] or "", "source", *values.to_pylist()])
            out.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "digest"])

    return map_parts(rows, {"start", "stop", "value"}, run, "doc_id long, digest string")


def deduplicate(docs: DataFrame, family: str, seq: str, shape: Callable[[Column, Column], Column] = structural_digest_of) -> DataFrame:
    """Rows kept after exact, then structural deduplication; the first in ``seq`` order stays.

    ``shape`` gives the structural digest of text and family, null for none.
    """
    digest = F.sha2(F.concat_ws("\x00", F.col(family), F.lit("source"), trimmed(F.coalesce("text", F.lit("")))), 256)
    marked = docs.select(seq, digest.alias("exact"), shape(F.coalesce("text", F.lit("")), F.col(family)).alias("shape"))
    exact = marked.groupBy("exact").agg(F.min(F.struct(seq, "shape")).alias("x")).select("x.*")
    shaped = exact.where("shape IS NOT NULL").groupBy("shape").agg(F.min(seq).alias(seq)).select(seq)
    return exact.where("shape IS NULL").select(seq).unionByName(shaped)


def running_sums(df: DataFrame, by: list[str], order: str, values: dict[str, Column], width: int = 4096) -> DataFrame:
    """Adds sums over the rows of a group up to and with each row, in ``order`` (a whole number).

    Blocks of ``width`` successive order values are summed first, so a group of any size is
    windowed in pieces: over its blocks, then within each block.
    """
    block = F.floor(F.col(order) / width)
    rows = df.withColumn("_block", block)
    for name, value in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    sums = rows.groupBy(*by, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    over = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_block").alias("_b_block"), *(F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_p_{n}") for n in values))
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    rows = rows.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in values))
    match = rows["_block"] == before["_b_block"]
    for c in by:
        match = match & rows[c].eqNullSafe(before[f"_b_{c}"])
    return rows.join(before, match).select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_p_{n}")).alias(n) for n in values))


def round_robin_limit(rows: DataFrame, repo: str, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows per repo, taken in turns from its groups, groups in first-seen order.

    The inner rank is limited first, which Spark does before the shuffle as well, so the
    outer window sees at most ``most`` rows per group.
    """
    inner = Window.partitionBy(repo, group).orderBy(order)
    ranked = rows.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= most)
    first = Window.partitionBy(repo, group)
    outer = Window.partitionBy(repo).orderBy("turn", "first_seen")
    ranked = ranked.withColumn("first_seen", F.min(order).over(first))
    return ranked.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= most).drop("first_seen")


def with_first(pool: DataFrame, by: list[str], source: str, seq: str) -> DataFrame:
    """Adds ``_first``, the first ``seq`` of the row's source in its group."""
    firsts = pool.groupBy(*(F.col(c).alias(f"_f_{c}") for c in by), F.col(source).alias("_source")).agg(F.min(seq).alias("_first"))
    same = F.col(source).eqNullSafe(F.col("_source"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return pool.join(firsts, same).drop("_source", *(f"_f_{c}" for c in by))


def take_in_turns(pool: DataFrame, by: list[str], source: str, seq: str, size: str, quota: Column, cap: Column | None = None) -> DataFrame:
    """(seq, by..., source, take): within each group of ``by``, records of its sources in turns until the group's quota is met.

    ``quota`` and ``cap``, which limits what one source gives, are constant in a group. The
    record that reaches the quota or cap is cut; records that give nothing are left out.
    Sources come in the order of ``_first`` (see ``with_first``).
    """
    rows = running_sums(pool, [*by, source], seq, {"_turn": F.lit(1), "_upto": F.col(size)})
    want = F.col(size) if cap is None else F.greatest(F.lit(0), F.least(F.col(size), cap - (F.col("_upto") - F.col(size))))
    rows = rows.withColumn("_want", want).where("_want > 0")
    # Units of all earlier turns, then of earlier sources within the turn.
    per_turn = rows.groupBy(*by, "_turn").agg(F.sum("_want").alias("_all_want"))
    per_turn = running_sums(per_turn, by, "_turn", {"_turn_upto": F.col("_all_want")})
    per_turn = per_turn.select(*(F.col(c).alias(f"_t_{c}") for c in by), F.col("_turn").alias("_t"), (F.col("_turn_upto") - F.col("_all_want")).alias("_before"))
    within = Window.partitionBy(*by, "_turn").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_turn") == F.col("_t")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    rows = rows.withColumn("_in_turn", F.coalesce(F.sum("_want").over(within), F.lit(0))).join(per_turn, match)
    take = F.greatest(F.lit(0), F.least(F.col("_want"), quota - F.col("_before") - F.col("_in_turn")))
    return rows.select(seq, *by, source, take.cast("long").alias("take")).where("take > 0")


def grouped_take(rows: DataFrame, group: str, source: str, seq: str, size: str, quotas: dict[str, int]) -> DataFrame:
    """(seq, group, source, take): each group's quota, up to an equal share from every source in turns, then in turns without a cap.

    The first pass gives each source of a group at most ceil(quota / sources) units; a record
    that is cut counts as used. The second pass fills the rest from unused records. The
    quotas, one per group, are a small table; records are metadata.
    """
    wanted = {k: v for k, v in quotas.items() if v > 0}
    if not wanted:
        return rows.select(seq, group, source, F.lit(0).cast("long").alias("take")).limit(0)

    def of_group(values: dict[str, int]) -> Column:
        """The group's number out of a few, as a literal."""
        return F.try_element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, int(v)))), F.col(group)).cast("long")

    pool = rows.select(seq, F.col(group).cast("string").alias(group), source, size).where(F.col(group).isin(*wanted))
    pool = with_first(pool, [group], source, seq)
    per = pool.select(group, F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("_s")).distinct().groupBy(group).agg(F.count("*").alias("n"))
    sources = {r[group]: r.n for r in per.collect()}  # one row per group
    if not sources:
        return rows.select(seq, group, source, F.lit(0).cast("long").alias("take")).limit(0)
    quota = of_group(wanted)
    first = take_in_turns(pool, [group], source, seq, size, quota, of_group({k: -(-wanted[k] // n) for k, n in sources.items()}))
    got = {r[group]: r.n for r in first.groupBy(group).agg(F.sum("take").alias("n")).collect()}  # one row per group
    short = {k: v - got.get(k, 0) for k, v in wanted.items() if got.get(k, 0) < v}
    if not short:
        return first
    unused = pool.where(F.col(group).isin(*short)).join(first.select(F.col(seq).alias("_used")), F.col(seq) == F.col("_used"), "left_anti")
    return first.unionByName(take_in_turns(unused, [group], source, seq, size, of_group(short)))


def balanced_take(rows: DataFrame, source: str, seq: str, size: str, quota: int) -> DataFrame:
    """(seq, source, take) of one quota over all rows: see ``grouped_take``."""
    taken = grouped_take(rows.select(seq, source, size).withColumn("_one", F.lit("all")), "_one", source, seq, size, {"all": quota})
    return taken.select(seq, source, "take")


def select_corpus(
    records: DataFrame,
    total: int,
    strata: dict[str, float],
    weights: dict[str, float],
    *,
    weighted: tuple[str, ...] = (),
    least: dict[str, int] | None = None,
    language_floors: dict[str, int] | None = None,
    minified_share: float = 0.0,
) -> DataFrame:
    """(seq, stratum, take) of (seq, stratum, family, language, source, minified, n) metadata, exactly ``total`` tokens.

    Strata have rounded shares, the last one the rest. In each stratum languages get their
    floors first, then families their targets by weight; what a family can't give goes to
    the others by weight, in rounds, then to any record in order. A share of the stratum
    ``compiled`` is kept for minified records. ValueError where tokens do not suffice.
    Each pass is a few window jobs over metadata; between passes only sums come to the driver.
    """
    out, floors, done = [], dict(language_floors or {}), 0
    names = list(strata)
    for stratum in names:
        quota = total - done if stratum == names[-1] else int(total * strata[stratum] + 0.5)
        pool = records.where(F.col("stratum") == stratum)
        chosen: list[DataFrame] = []
        reserved = 0
        if floors and quota:
            asked, room = {}, quota
            for language, n in floors.items():
                asked[language] = min(n, room)
                room -= asked[language]
            first = _kept(grouped_take(pool, "language", "source", "seq", "n", asked).select("seq", F.col("language").alias("by"), "take"))
            got = _sums(first)
            floors = {k: v - got.get(k, 0) for k, v in floors.items() if v > got.get(k, 0)}
            reserved = sum(got.values())
            chosen.append(first)
        parts = [(pool, quota - reserved)]
        if stratum == "compiled" and minified_share > 0:
            if reserved:
                raise ValueError("language floors cannot share a stratum with minified quotas")
            small = int(quota * minified_share + 0.5)
            is_small = F.coalesce(F.col("minified"), F.lit(False))
            parts = [(pool.where(is_small), small), (pool.where(~is_small), quota - small)]
        for part, n in parts:
            targets = allocate_targets(n, weights, (least or {}).get(stratum, 0)) if (stratum in weighted or len(parts) > 1) and n else None
            chosen += _fill(part, n, targets, chosen)
        for x in chosen:
            out.append(x.select("seq", F.lit(stratum).alias("stratum"), "take"))
        done += quota
    if floors:
        raise ValueError(f"not enough tokens of languages: {floors}")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _kept(df: DataFrame) -> DataFrame:
    """A pass's choice, cut off from the passes before it."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()


def _sums(taken: DataFrame) -> dict:
    return {r.by: r.n for r in taken.groupBy("by").agg(F.sum("take").alias("n")).collect()}  # one row per group


def _unused(pool: DataFrame, chosen: list[DataFrame]) -> DataFrame:
    for x in chosen:
        pool = pool.join(x.select(F.col("seq").alias("_used")), F.col("seq") == F.col("_used"), "left_anti")
    return pool


def _fill(pool: DataFrame, quota: int, targets: dict[str, int] | None, before: list[DataFrame]) -> list[DataFrame]:
    taken: list[DataFrame] = []
    left, asked = quota, targets
    while left > 0 and asked:
        more = _kept(grouped_take(_unused(pool, before + taken), "family", "source", "seq", "n", asked).select("seq", F.col("family").alias("by"), "take"))
        got = sum(_sums(more).values())
        taken.append(more)
        left -= got
        if left <= 0 or not got:
            break
        able = [r.family for r in _unused(pool, before + taken).where("n > 0").select("family").distinct().collect()]  # families
        able = {k: targets[k] for k in targets if k in able}
        asked, room = {}, left
        for k, w in able.items():
            asked[k] = min(room, max(1, int(left * w / max(1, sum(able.values())) + 0.5)))
            room -= asked[k]
    if left > 0:
        rest = _unused(pool, before + taken).select("seq", "n").withColumn("_all", F.lit(1))
        rest = running_sums(rest, ["_all"], "seq", {"_upto": F.col("n")})
        more = _kept(rest.select("seq", F.lit("").alias("by"), F.least(F.col("n"), left - (F.col("_upto") - F.col("n"))).cast("long").alias("take")).where("take > 0"))
        if sum(_sums(more).values()) < left:
            raise ValueError(f"not enough tokens; need {left - sum(_sums(more).values())} more")
        taken.append(more)
    return taken


def select_mining(records: DataFrame, total: int, minified_share: float = 0.0, family_floor: int = 0) -> DataFrame:
    """(seq, side, place, take) of (seq, stratum, family, source, n): a mining corpus of exactly ``total`` tokens.

    Minified records have their share. Of the others each family gets up to ``family_floor``
    tokens in order, families in the order they come; then (source, family) groups give
    whole records in turns. ``place`` and ``side`` interleave both pools one to one.
    """
    small = int(total * minified_share + 0.5)
    sides = []
    for side, pool, quota, floor in ((0, records.where("stratum = 'minified'"), small, 0), (1, records.where("stratum <> 'minified'"), total - small, family_floor)):
        got, taken = 0, []
        pool = pool.where("n > 0").withColumn("group", F.concat_ws(":", "source", "family"))
        if floor and quota:
            upto = running_sums(pool, ["family"], "seq", {"_upto": F.col("n")})
            want = upto.withColumn("_want", F.least(F.col("n"), floor - (F.col("_upto") - F.col("n")))).where("_want > 0")
            order = pool.groupBy(F.col("family").alias("_family")).agg(F.min("seq").alias("_first"))
            per = want.groupBy(F.col("family").alias("_family")).agg(F.sum("_want").alias("_n")).join(order, "_family").withColumn("_all", F.lit(1))
            per = running_sums(per, ["_all"], "_first", {"_sum": F.col("_n")}).select("_family", (F.col("_sum") - F.col("_n")).alias("_before"), "_first")
            want = want.join(F.broadcast(per), F.col("family") == F.col("_family"))  # one row per family
            left = quota - F.col("_before") - (F.col("_upto") - F.col("n"))
            first = want.select("seq", F.col("_first").alias("_o1"), F.col("seq").alias("_o2"), F.least(F.col("_want"), left).cast("long").alias("take")).where("take > 0")
            taken.append(_kept(first))
            got = taken[0].agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]
        if got < quota:
            rest = with_first(_unused(pool, taken).withColumn("_all", F.lit(1)), ["_all"], "group", "seq")
            more = take_in_turns(rest, ["_all"], "group", "seq", "n", F.lit(quota - got)).select("seq", "take")
            places = running_sums(rest, ["group"], "seq", {"_turn": F.lit(1)}).select(F.col("seq").alias("_seq"), (F.col("_turn") + F.lit(1 << 40)).alias("_o1"), F.col("_first").alias("_o2"))
            more = _kept(more.join(places, F.col("seq") == F.col("_seq")).select("seq", "_o1", "_o2", "take"))
            if got + (more.agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]) < quota:
                raise ValueError("not enough mining tokens")
            taken.append(more)
        for x in taken:
            sides.append(x.withColumn("side", F.lit(side)))
    if not sides:
        return records.select("seq", F.lit(0).alias("side"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("take")).limit(0)
    both = sides[0]
    for x in sides[1:]:
        both = both.unionByName(x)
    turn = Window.partitionBy("side", "_o1").orderBy("_o2")
    ranked = both.withColumn("_in", F.row_number().over(turn).cast("long"))
    steps = ranked.groupBy("side", "_o1").agg(F.count("*").alias("_n"))
    steps = running_sums(steps, ["side"], "_o1", {"_upto": F.col("_n")}).select(F.col("side").alias("_side"), F.col("_o1").alias("_step"), (F.col("_upto") - F.col("_n")).alias("_before"))
    return ranked.join(steps, (F.col("side") == F.col("_side")) & (F.col("_o1") == F.col("_step"))).select("seq", "side", (F.col("_before") + F.col("_in")).alias("place"), "take")


def missed_conditions(
    summary: DataFrame, total: int, strata: dict[str, float], *, families: tuple[str, ...] = (), languages: dict[str, int] | None = None, constructs: dict[str, int] | None = None
) -> DataFrame:
    """(condition, value, expected) rows of (dimension, value, n) sums that a selection violates; none if all hold."""
    spark = summary.sparkSession
    want = [("all", "", float(total), 0.0, None)]
    want += [("stratum", k, float(int(total * r + 0.5)), 1.0, None) for k, r in strata.items()]
    want += [("family", k, 1.0, None, "least") for k in families]
    want += [("language", k, float(n), None, "least") for k, n in (languages or {}).items()]
    want += [("construct", k, float(n), None, "least") for k, n in (constructs or {}).items()]
    table = spark.createDataFrame(want, "condition string, name string, expected double, slack double, kind string")
    j = F.broadcast(table).join(summary.select("dimension", F.col("value").alias("_value"), "n"), (F.col("condition") == F.col("dimension")) & (F.col("name") == F.col("_value")), "left")
    n = F.coalesce("n", F.lit(0))
    bad = F.when(F.col("kind") == "least", n < F.col("expected")).otherwise(F.abs(n - F.col("expected")) > F.col("slack"))
    return j.where(bad).select("condition", "name", n.cast("long").alias("n"), "expected")


def allocate_targets(total: int, weights: dict[str, float], least: int) -> dict[str, int]:
    """Split ``total`` by weight above a floor; rounding residue goes round in map order."""
    floor = min(least, total // len(weights))
    rest, whole = total - floor * len(weights), sum(weights.values())
    out = {k: floor + int(rest * w / whole + 0.5) for k, w in weights.items()}
    delta, names, k = total - sum(out.values()), list(weights), 0
    while delta:
        step = 1 if delta > 0 else -1
        out[names[k % len(names)]] += step
        delta, k = delta - step, k + 1
    return out


def stratum_quotas(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rounded shares; the last stratum takes the remainder."""
    names = list(ratios)
    out = {n: int(total * ratios[n] + 0.5) for n in names[:-1]}
    return out | {names[-1]: total - sum(out.values())}


def corpus_summary(rows: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures in total and by each dimension: (dimension, value, measures...)."""
    sets = rows.groupingSets([[], *([d] for d in dims)], *dims).agg(F.grouping_id().alias("_g"), *(m.alias(n) for n, m in measures.items()))
    k = len(dims)
    name, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dims):
        only = ((1 << k) - 1) ^ (1 << (k - 1 - i))
        name = F.when(F.col("_g") == only, d).otherwise(name)
        value = F.when(F.col("_g") == only, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), *measures)


def candidate_order(priority: str, *names: str) -> list[Column]:
    """Falling priority, then names."""
    return [F.desc(priority), *(F.asc(n) for n in names)]


def limit_per_group(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their ``place``; limited before the shuffle as well."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)


def distinct_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, names): the sorted different names of each group."""
    return rows.select(by, name).distinct().groupBy(by).agg(F.array_sort(F.collect_list(name)).alias("names"))


def missing_values(rows: DataFrame, column: str, required: list[str]) -> DataFrame:
    """The required values that no row has, as ``missing``."""
    want = rows.sparkSession.createDataFrame([(v,) for v in required], "missing string")
    return want.join(rows.select(F.col(column).alias("_v")).distinct(), F.col("missing") == F.col("_v"), "left_anti")


def shared_between(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(value, n_groups) of the values that occur in more than one group: a source may be in one split only."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.countDistinct(group).alias("n_groups")).where("n_groups > 1")


def with_minified(rows: DataFrame, text: str, minify, languages: tuple[str, ...], least_units: int = 16) -> DataFrame:
    """Rows and, of the languages given, their minified forms where these differ and are long enough: adds ``minified``.

    ``minify`` makes a column of a column: a minifier is not part of the engine.
    """
    small = rows.where(F.col("language").isin(*languages)).withColumn("_small", minify(F.col(text)))
    small = small.where((F.col("_small") != F.col(text)) & (units_of(F.col("_small")) >= least_units))
    small = small.withColumn(text, F.col("_small")).drop("_small").withColumn("minified", F.lit(True))
    return rows.withColumn("minified", F.lit(False)).unionByName(small)


def relabelled(records: DataFrame, label) -> DataFrame:
    """Records with their stored labels dropped and made anew by ``label`` (a column of (source, language))."""
    return records.drop("sourceLabels").withColumn("sourceLabels", label(F.col("source"), F.col("language")))


def compact_metadata(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    """The struct column without fields that say where and how it was made."""
    return rows.withColumn(column, F.col(column).dropFields(*fields))
