"""Connected components of an edge table: every node gets its component's smallest node.

Rounds of large-star and small-star steps (each node hands its neighbours on to
the smallest one it knows) between which every partition contracts the edges it
holds. A round costs a few shuffles of edge pairs; edges only get fewer; rounds
grow with the logarithm of a component's width. Minima are summed up before they
are shuffled, and are written before they are joined, so that both sides of a join
are plain shuffles: the planner splits the edges of a hub. Nothing goes to the driver but a
count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, materialize

EDGE = "a long, b long"


def contract(edges: DataFrame, n: int) -> DataFrame:
    """Each partition's edges, of n at most, as stars around their smallest nodes: (a, b), b < a. Not more edges than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (y := up.setdefault(root, root)) != root:
                root = y
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in up if (r := top(x)) != x]
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["a", "b"])

    return edges.coalesce(max(1, -(-n // FILE_ROWS))).mapInArrow(run, EDGE)


def star_round(edges: DataFrame, n: int) -> DataFrame:
    """n: how many edges there are; no table here has more than twice as many rows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", most_rows=2 * n)
    large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", most_rows=n)
    small = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small", most_rows=n)
    over = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return over.unionByName(small.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), a materialized table; root is the component's smallest node."""
    n = edges.count()
    now = materialize(contract(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), n), "edges")
    state = None
    for _ in range(max_rounds):
        now = materialize(contract(star_round(now, n), n), "edges")
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state, n = new, new[0]
    raise RuntimeError("components did not settle")
