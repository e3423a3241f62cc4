"""Connected components by random-order contraction, for graphs that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.runtime import discard, join_hot, materialize, tidy


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edge list; two nodes share a root exactly when a path joins them.

    Nodes are longs. They are renamed by XXH64, a bijection on longs, which puts them in random order; then every
    node steps to its least neighbour and on to that one's, and edges are redrawn between the nodes stepped to. A
    chain of n nodes shrinks by a constant share in each round, a star is done in two. Rounds write what they
    leave to the shared folder. Minima are combined before the shuffle, and joins leave AQE free to split a hub.

    Null ends are ignored; loops give a node of its own; no edges, no rows.
    """
    both = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).dropna()
    names = materialize(both.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.xxhash64("node").alias("h")), "nodes")
    live = materialize(both.filter("x <> y").select(F.xxhash64("x").alias("x"), F.xxhash64("y").alias("y")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        around = live.union(live.select("y", "x"))
        least = around.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("h"), F.least("x", "y").alias("up"))
        least = materialize(least, "least")
        twice = least.join(least.select(F.col("h").alias("up"), F.col("up").alias("upper")), "up", "left")
        step = materialize(twice.select("h", F.coalesce("upper", "up").alias("up")), "step")
        to = lambda c: step.select(F.col("h").alias(c), F.col("up").alias(f"{c}_up"))
        moved = live.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("x_up", "x").alias("x"), F.coalesce("y_up", "y").alias("y"))
        after = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        discard(live)
        discard(least)
        live = after
        steps.append(step)
    if not steps:
        return names.select("node", F.col("h").alias("root"))
    root = steps[-1]
    for step in reversed(steps[:-1]):
        # a node steps in its first round, and what it stepped to in those after
        root = step.join(root.select(F.col("h").alias("up"), F.col("up").alias("top")), "up", "left").select("h", F.coalesce("top", "up").alias("up"))
    return materialize(names.join(root, "h", "left").select("node", F.coalesce("up", "h").alias("root")), "roots")


@tidy
def component_ids(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) where component is the smallest node reachable."""
    roots = components(edges, a, b)
    least = materialize(roots.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")), "least")
    return join_hot(roots, least, "root", "inner").select("node", "component")
