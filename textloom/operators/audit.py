"""Character and region audits of predicted against expected labels.

Documents are rasterized where they lie: label sets travel to them as arrays or are made there
of a text's length, the grids live for a bounded number of units, and only counts leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parts import PLACED, _part_columns, map_parts, part_values, units_of
from .align import Labeller, _aligned, given_labels, label_lists, with_labels
from .metrics import confusion, overall, per_class, ratio

COUNTS = (
    "eligible", "labelled", "covered", "correct", "uncovered_ranges", "spans_matched", "spans_expected", "spans_predicted",
    "boundaries_matched", "boundaries_expected", "boundaries_predicted",
)


#: Units of text that are rasterized at once, unless one text alone has more.
UNITS_AT_ONCE = 1 << 20


def _grid(sizes: np.ndarray, labels: dict) -> np.ndarray:
    """The class of each unit of texts one after another, -1 where no label lies."""
    out = np.full(int(sizes.sum()), -1, dtype=np.int16)
    doc, base = labels["doc"], np.cumsum(sizes) - sizes
    start, stop = (np.clip(labels[end], 0, sizes[doc]) for end in ("from", "to"))
    many = np.maximum(stop - start, 0)
    at = np.repeat(start + base[doc] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out[at] = np.repeat(labels["class"], many)
    return out


def _runs(grid: np.ndarray, scored: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of scored runs of one class; a run ends with its text and where a unit is not scored."""
    change = first.copy()
    change[1:] |= (grid[1:] != grid[:-1]) | (scored[1:] != scored[:-1])
    start = np.flatnonzero(change)
    stop = np.append(start[1:], len(grid))[: len(start)]
    keep = scored[start]
    return start[keep], stop[keep]


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-16 units of texts one after another, and how many each has."""
    data = [t.encode("utf-16-le", "surrogatepass") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(data), np.uint16), np.array([len(x) // 2 for x in data], dtype=np.int64)


def _audit(units: np.ndarray, sizes: np.ndarray, want: np.ndarray, got: np.ndarray, n_classes: int, blanks: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Counts, confusion and span counts of each text, from the classes of all units."""
    n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(units), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    eligible = np.ones(len(units), bool) if blanks else ~((units == 32) | ((units >= 9) & (units <= 13)))
    scored = eligible & (want >= 0)
    guess = np.maximum(got, 0)
    per = lambda mask, by=1, of=0: np.bincount(doc[mask] * by + (of[mask] if by > 1 else 0), minlength=n * by)
    matrix = per(scored, n_classes * n_classes, want.astype(np.int64) * n_classes + guess)
    # A unit and the one before it in its text.
    after = lambda mask: np.append(False, mask[:-1])[: len(mask)] & ~first
    bare = eligible & (want < 0)
    beside = scored & after(scored)
    edges = [beside & np.append(False, x[1:] != x[:-1])[: len(x)] for x in (want, guess)]
    (a, a_stop), (b, b_stop) = (_runs(x, scored, first) for x in (want, guess))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = a[i[(a_stop[i] == b_stop[j]) & (want[a[i]] == guess[b[j]])]]
    spans = np.stack([per(at, n_classes, x.astype(np.int64)).reshape(n, n_classes) for at, x in ((both, want), (a, want), (b, guess))], axis=1)
    counts = [
        per(eligible), per(scored), per(scored & (got >= 0)), per(scored & (want == guess)), per(bare & ~after(bare)), *(spans[:, k, 1:].sum(axis=1) for k in range(3)),
        per(edges[0] & edges[1]), per(edges[0]), per(edges[1]),
    ]
    return counts, matrix.reshape(n, -1), spans.reshape(n, -1)


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts that have ``UNITS_AT_ONCE`` units together at most, or one that has more."""
    at, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > at and held + n > UNITS_AT_ONCE:
            yield at, k - at
            at, held = k, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths) - at


def audit_labels(
    docs: DataFrame, expected: DataFrame | Labeller, predicted: DataFrame | Labeller, classes: tuple[str, ...], *, include_whitespace: bool = False, length: Column | None = None,
) -> DataFrame:
    """One row per document: the counts of ``COUNTS``, ``matrix`` and ``span_counts`` (arrays).

    Labels are (doc_id, from, to, class) in UTF-16 units, no two of a side overlapping. White
    space is left out unless asked for; units without an expected label are not scored, units
    without a predicted one count as the first class. Spans and boundaries (class changes
    between neighbouring scored units) count for classes but the first. A side that is a
    labeller is made where the texts lie, of each one's ``length`` (UTF-16 units unless given).
    """
    number = F.create_map(*(F.lit(x) for k, c in enumerate(classes) for x in (c, k)))
    side = lambda labels, name: labels.where(F.col("class").isin(*classes)).groupBy(F.col("doc_id").alias(f"_{name}")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"), F.try_element_at(number, F.col("class")).alias("class")))).alias(name)
    )
    text = F.coalesce("text", F.lit(""))
    sides = {"expected": expected, "predicted": predicted}
    makers = {name: None if isinstance(x, DataFrame) else x for name, x in sides.items()}
    rows = docs.select("doc_id", text.alias("text"), (length if length is not None else units_of(text)).cast("long").alias("_length"))
    rows = with_labels(rows, **{name: side(x, name) if isinstance(x, DataFrame) else x for name, x in sides.items()})
    n = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many in _slices(batch.column("_length").to_numpy()):
                b = batch.slice(at, many)
                units, sizes = _units(b.column("text"))
                grids = [_grid(sizes, given_labels(b, name, maker)) for name, maker in makers.items()]
                counts, *lists = _audit(units, sizes, *grids, n, include_whitespace)
                cols = [pa.array(x, pa.int64()) for x in counts]
                cols += [pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64())) for x in lists]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *COUNTS, "matrix", "span_counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", matrix array<long>, span_counts array<long>")


def _cells(audits: DataFrame, classes: tuple[str, ...], *by: str) -> DataFrame:
    """(by..., COUNTS, expected, predicted, n): sums of counts and of each cell of the matrix, in one pass over the audits."""
    side = len(classes)
    sums = audits.groupBy(*by).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS),
        F.array(*(F.coalesce(F.sum(F.get("matrix", F.lit(k))), F.lit(0)).cast("long") for k in range(side * side))).alias("_matrix"),
    )
    name = lambda k: F.get(F.lit(list(classes)), k.cast("int"))
    cells = sums.select(*by, *COUNTS, F.posexplode("_matrix").alias("_cell", "n"))
    return cells.select(*by, *COUNTS, name(F.floor(F.col("_cell") / side)).alias("expected"), name(F.col("_cell") % side).alias("predicted"), "n")


def audit_confusion(audits: DataFrame, classes: tuple[str, ...], *by: str) -> DataFrame:
    """(by..., expected, predicted, n) of all audited units."""
    return _cells(audits, classes, *by).where("n > 0").select(*by, "expected", "predicted", "n")


def audit_summary(audits: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One row: coverage, accuracy, prediction coverage, macro F1, false-color rate, majority baseline, span and boundary F1."""
    scores = per_class(_cells(audits, classes), *COUNTS)
    place = F.array_position(F.lit(list(classes)), F.col("class"))
    one = scores.groupBy(*COUNTS).agg(
        F.max_by("class", F.struct("support", -place)).alias("majority"), F.max("support").alias("majority_support"),
        (F.sum(F.when(F.col("class") != classes[0], F.col("f1"))) / (len(classes) - 1)).alias("macro_f1"),
        F.max(F.when(F.col("class") == classes[0], ratio(F.col("support") - F.col("hits"), F.col("support")))).alias("false_color_rate"),
    )
    f1 = lambda name: ratio(2 * F.col(f"{name}_matched"), F.col(f"{name}_expected") + F.col(f"{name}_predicted"))
    return one.select(
        *COUNTS, ratio(F.col("labelled"), F.col("eligible")).alias("coverage"), ratio(F.col("correct"), F.col("labelled")).alias("accuracy"),
        ratio(F.col("covered"), F.col("labelled")).alias("prediction_coverage"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"),
        F.coalesce("false_color_rate", F.lit(0.0)).alias("false_color_rate"), "majority", ratio(F.col("majority_support"), F.col("labelled")).alias("majority_accuracy"),
        f1("spans").alias("span_f1"), f1("boundaries").alias("boundary_f1"),
    )


def uncovered_ranges(lengths: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, from, to) stretches of (doc_id, length) documents that no label of (doc_id, from, to) covers."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("from", "to")
    ends = labels.select("doc_id", "from", "to").unionByName(lengths.select("doc_id", F.col("length").alias("from"), F.col("length").alias("to")))
    before = F.coalesce(F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("_b", before).where(F.col("_b") < F.col("from")).select("doc_id", F.col("_b").alias("from"), F.col("from").alias("to"))


def by_region(parts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(region, expected, predicted, n) of parts with an ``auxiliary`` bit mask; without a bit they are ``unscoped``."""
    bits = F.array(*(F.when(F.col("auxiliary").bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)))
    regions = F.when(F.col("auxiliary") == 0, F.array(F.lit("unscoped"))).otherwise(F.array_compact(bits))
    return confusion(parts.select(F.explode(regions).alias("region"), "expected", "predicted"), "region")


def disagreements(parts: DataFrame, left: str, right: str, *by: str) -> DataFrame:
    """(by..., n, differ): how often two predictions of a part differ."""
    return parts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(left).eqNullSafe(F.col(right))).alias("differ"))


def gap_points(a: Column, b: Column) -> Column:
    """a - b in percentage points; null if either is."""
    return 100 * (a - b)


def evaluate_sets(parts: DataFrame, sets: list[list[str]], *, n_classes: int, plain: str = "plain") -> DataFrame:
    """Accuracy, macro F1 and false-color rate of (expected, predicted) parts for each grouping, in one pass over them."""
    dims = sorted({c for s in sets for c in s})
    keys = F.array(*(F.to_json(F.struct(F.lit(",".join(s)).alias("grouping"), *(F.col(c).cast("string").alias(c) for c in s))) for s in sets))
    small = parts.groupBy(*dims, "expected", "predicted").agg(F.count("*").alias("n"))
    cells = small.select(F.explode(keys).alias("key"), "expected", "predicted", "n").groupBy("key", "expected", "predicted").agg(F.sum("n").alias("n"))
    scores = overall(cells, "key", exclude=(plain,), n_classes=n_classes)
    false = per_class(cells, "key").where(F.col("class") == plain).select(F.col("key").alias("_key"), ratio(F.col("support") - F.col("hits"), F.col("support")).alias("false_color_rate"))
    return scores.join(false, F.col("key") == F.col("_key"), "left").drop("_key").withColumn("false_color_rate", F.coalesce("false_color_rate", F.lit(0.0)))


def mismatch_report(parts: DataFrame, *by: str) -> DataFrame:
    """(by..., supervised, correct, accuracy) of supervised parts; the mismatches themselves are ``mismatches``."""
    n = parts.where("supervised").groupBy(*by).agg(F.count("*").alias("supervised"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"))
    return n.withColumn("accuracy", ratio(F.col("correct"), F.col("supervised")))


def mismatches(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("supervised") & (F.col("expected") != F.col("predicted")))


def neighbour_boundaries(parts: DataFrame, *by: str) -> DataFrame:
    """(by..., matched, expected, predicted) class changes between a document's successive supervised parts."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("i")
    rows = parts.where("supervised").select(
        "doc_id", *by, (F.lag("expected").over(w) != F.col("expected")).alias("_e"), (F.lag("predicted").over(w) != F.col("predicted")).alias("_p")
    )
    return rows.groupBy(*by).agg(
        F.count_if(F.col("_e") & F.col("_p")).alias("matched"), F.count_if("_e").alias("expected"), F.count_if("_p").alias("predicted")
    )


def first_difference(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at): the first position at which two ordered sets differ, null if they are equal."""
    r = right.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    j = left.select(key, order, value).join(r, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "full")
    differ = F.when(~F.col(value).eqNullSafe(F.col("_v")) | F.col(order).isNull() | F.col("_o").isNull(), F.coalesce(order, "_o"))
    return j.groupBy(F.coalesce(key, "_k").alias(key)).agg(F.min(differ).alias("at"))


def document_first_difference(docs: DataFrame, judge: Callable[[dict], tuple[np.ndarray, np.ndarray]], columns: set[str]) -> DataFrame:
    """``first_difference`` of two classes of parts where documents lie: (doc_id, at) of (doc_id, text).

    ``judge`` gives for all parts, from part columns: does it count, and do its classes differ.
    A document in which none counts has no row. Only a row a document is shuffled, for ids that recur.
    """

    def run(b: pa.RecordBatch, sizes: np.ndarray, parts: dict) -> pa.RecordBatch:
        counts, differs = judge(parts)
        some = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[some]
        none = np.iinfo(np.int32).max
        at = np.where(counts & differs, parts["i"], none)
        at, any_counts = (x.reduceat(y, begins) if len(some) else np.zeros(0, y.dtype) for x, y in ((np.minimum, at), (np.logical_or, counts)))
        some, at = some[any_counts], at[any_counts]
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array(at, pa.int32(), mask=at == none)], names=["doc_id", "at"])

    rows = map_parts(docs.select("doc_id", "text"), columns | {"i"}, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at int")
    return rows.groupBy("doc_id").agg(F.min("at").alias("at"))


def projection_audit(docs: DataFrame, labels: DataFrame | Labeller, classes: tuple[str, ...], *, length: Column | None = None) -> DataFrame:
    """(doc_id, labelled, projected, baseline): scored units, those right after each part takes its label, those right as plain.

    The label of a part is the one that ``align_documents`` gives it; ``labels`` and ``length`` as
    there. Parts tile a text, so their classes are its grid: neither parts nor units leave it.
    """
    text = F.coalesce("text", F.lit(""))
    maker = None if isinstance(labels, DataFrame) else labels
    rows = docs.select("doc_id", text.alias("text"), part_values(text).alias("_values"), (length if length is not None else units_of(text)).cast("long").alias("_length"))
    rows = with_labels(rows, labels=maker if maker is not None else label_lists(labels, classes, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many in _slices(batch.column("_length").to_numpy()):
                b = batch.slice(at, many)
                given = given_labels(b, "labels", maker)
                parts = np.diff(b.column("_values").offsets.to_numpy())
                p, doc = _part_columns(b.column("_values").flatten(), parts, set(PLACED)), np.repeat(np.arange(many), parts)
                got = np.repeat(_aligned(p, doc, given | {"n_docs": many}, len(classes))["class"], p["units"])
                units, sizes = _units(b.column("text"))
                counts, matrix, _ = _audit(units, sizes, _grid(sizes, given), got, len(classes), False)
                plain = matrix.reshape(many, len(classes), -1)[:, 0].sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts[1], counts[3], plain))], names=["doc_id", "labelled", "projected", "baseline"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, labelled long, projected long, baseline long")
