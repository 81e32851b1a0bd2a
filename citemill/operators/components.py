"""Connected components of an undirected edge list, without bringing any of it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.runtime import materialize

#: Contracted edges of at most this number (two ids each) are finished by one task, in a few passes of numpy.
ONE_TASK = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex number reachable from each of the vertices 0 to n - 1, by hooking and full contraction."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return up


def _finished(live: DataFrame) -> DataFrame:
    """(id, to) for every vertex of a small edge list."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat([p[["a", "b"]] for p in parts], ignore_index=True)
        code, ids = pd.factorize(pd.concat([both["a"], both["b"]], ignore_index=True), sort=True)
        root = least_reachable(code[: len(both)], code[len(both) :], len(ids))
        yield pd.DataFrame({"id": ids, "to": np.asarray(ids)[root]})

    kind = live.schema["a"].dataType.simpleString()
    return live.repartition(1).mapInPandas(lambda it: run(it), f"id {kind}, to {kind}") if live.limit(1).count() else live.select(F.col("a").alias("id"), F.col("b").alias("to"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", one_task: int = ONE_TASK, rounds: list | None = None) -> DataFrame:
    """Label every vertex of `edges` with the smallest vertex id reachable from it.

    Returns (id, component). Each round hooks every vertex to its smallest neighbour, follows the hooks to
    their roots by doubling, and contracts the edges. Every vertex that is not a local minimum disappears in
    a round and a chain of hooks of any length takes a logarithmic number of doublings, so ids in any order,
    ordered chains included, take a logarithmic number of passes. What is left below `one_task` edges is
    finished by one task. Loops, repeated edges and null ends are ignored. The edges along hooks are dropped
    before the second join, so that a hub's own neighbours never meet in one task there. `rounds`, if given,
    receives the number of doublings of each round.
    """
    live = materialize(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    label = None
    while True:
        left = live.count()
        if left <= one_task or not left:
            step = materialize(_finished(live), "step")
            if label is None:
                return step.select("id", F.col("to").alias("component"))
            return materialize(_relabelled(label, step), "label")
        hooks = (
            live.select(F.col("a").alias("id"), F.col("b").alias("to"))
            .unionByName(live.select(F.col("b").alias("id"), F.col("b").alias("to")))
            .groupBy("id")
            .agg(F.min("to").alias("to"))
            .select("id", F.least("id", "to").alias("hook"))
        )
        step = materialize(hooks.withColumn("to", F.col("hook")), "hooks")
        doublings = 0
        while True:
            jump = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
            step = step.join(jump, "to", "left").select("id", "hook", F.coalesce("further", "to").alias("to"), (F.col("further") != F.col("to")).alias("moved"))
            step = materialize(step, "step")
            doublings += 1
            if not step.where("moved").limit(1).count():
                break
        if rounds is not None:
            rounds.append(doublings)
        step = step.select("id", "hook", "to")
        label = materialize(step.select("id", F.col("to").alias("component")) if label is None else _relabelled(label, step), "label")
        near = step.select(F.col("id").alias("a"), "hook", F.col("to").alias("ta"))
        far = step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        live = materialize(
            live.join(near, "a").where("b <> hook").join(far, "b").where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(),
            "edges",
        )


def _relabelled(label: DataFrame, step: DataFrame) -> DataFrame:
    after = step.select(F.col("id").alias("component"), "to")
    return label.join(after, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
