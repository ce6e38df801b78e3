"""Connected components of a graph given as links, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LINKS_A_TASK = 500_000


def contracted(links: DataFrame, per_task: int = LINKS_A_TASK) -> DataFrame:
    """Fewer links with the same components: each task keeps a star for each component it sees.

    Tasks get about ``per_task`` links each, whatever their number, so what a task holds is
    bounded; a group with many links per node shrinks to a few links per node.
    """
    links = cut(links.select("a", "b"))
    tasks = max(4, -(-links.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        kept = [(x, top(x)) for x in list(parent)]
        kept = [(x, r) for x, r in kept if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (1, 0)], names=["a", "b"])

    return links.repartition(tasks).mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a BIGINT, b BIGINT); comp is the least node.

    Each round takes the least label among a node and its neighbours, then follows the
    label's own label, so labels spread over paths that double in length. Aggregation is
    partial before each shuffle; a node of very many links is split by the skew join.
    A label falls in every round until none does, so the rounds end. No links, no rows.
    """
    links = contracted(links)
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        spread = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
            .withColumnRenamed("a", "n")
        )
        hooked = (
            labels.join(spread, F.col("node") == F.col("n"))
            .select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        )
        tops = labels.select(F.col("node").alias("t"), F.col("comp").alias("top"))
        moved = cut(
            hooked.join(tops, F.col("to") == F.col("t")).select("node", F.least("to", "top").alias("comp"), "was")
        )
        changed = moved.where("comp <> was").limit(1).count()
        labels = moved.select("node", "comp")
        if not changed:
            return labels
