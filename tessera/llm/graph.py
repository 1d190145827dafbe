"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Rounds after which the labelling must have settled; each round at least halves the depth of what is left.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is the smallest node of its component.

    Alternating large-star and small-star rounds: every node hangs its larger neighbours, then its smaller ones,
    on the smallest of them.  Rows never exceed the edges; each round is written to the shared folder.  Loops
    (a = b) and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    now = common.stored(_star(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    before = None
    for _ in range(MAX_ROUNDS):
        settled = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == settled:
            break
        before, last = settled, now
        now = common.stored(_star(_large_star(last)))
        common.discard(last)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """Small star: each node links its smaller neighbours and itself to the smallest of them (edges have u > v)."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("k"))
    return moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
