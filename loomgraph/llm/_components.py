"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._scratch import Scratch

_JUMPS = 2


def components(scratch: Scratch, edges: DataFrame, n: int | None = None, small: int = 0) -> DataFrame | None:
    """Map each node of ``edges`` (a, b: long) to one node of its component: (node, comp).

    Each round every node joins the neighbour, or itself, of the least hash, and then
    what that one joined; the nodes that were joined are the next graph. A fresh hash
    each round shrinks chains as fast as stars, so the rounds grow with the logarithm
    of the graph.
    Aggregation is by partial minimum, so a hub's links are never gathered. None
    if there are no edges. A graph of ``small`` edges at most, given so or contracted to
    that, is solved on the driver; ``n`` is the number of edges where the caller knows it.
    """
    if n is not None and n <= small:
        return _solved(scratch, edges)
    now = scratch.save(_clean(edges), "edges")
    mapping, turn = None, 0
    while not now.isEmpty():
        if small and now.count() <= small:
            step = _solved(scratch, now)
            if mapping is None:
                return step
            moved = mapping.join(step.select(F.col("node").alias("v"), F.col("comp").alias("to")), mapping["comp"] == F.col("v"), "left")
            return scratch.save(moved.select("node", F.coalesce("to", "comp").alias("comp")), "mapping")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        ways = now.select(F.col("a").alias("v"), rank("b").alias("u")).union(now.select(F.col("b").alias("v"), rank("a").alias("u")))
        least = ways.groupBy("v").agg(F.min("u").alias("u"))
        step = scratch.save(least.select("v", F.least(rank("v"), F.col("u"))["x"].alias("to")), "step")
        for _ in range(_JUMPS):
            on = step.select(F.col("v").alias("to"), F.col("to").alias("on"))
            step = step.join(on, "to").select("v", F.col("on").alias("to"))
        step = scratch.save(step, "jumped")
        if mapping is None:
            mapping = step.select(F.col("v").alias("node"), F.col("to").alias("comp"))
        else:
            moved = mapping.join(step, mapping["comp"] == step["v"], "left").select("node", F.coalesce("to", "comp").alias("comp"))
            mapping = scratch.save(moved, "mapping")
        left, right = step.select(F.col("v").alias("a"), F.col("to").alias("x")), step.select(F.col("v").alias("b"), F.col("to").alias("y"))
        then = now.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        now = scratch.save(_clean(then), "edges")
        turn += 1
    return mapping


def _solved(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """The same map by union-find on the driver, for few edges."""
    found = edges.filter(F.col("a") != F.col("b")).select("a", "b").toArrow()
    if not found.num_rows:
        return None
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist()):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    table = pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array([top(x) for x in nodes], pa.int64())})
    return scratch.save(scratch.spark.createDataFrame(table), "solved")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
