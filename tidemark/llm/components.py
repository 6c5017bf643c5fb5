"""Connected components of a graph given by its edges, by forests of tasks and alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, reduced to one edge from each node to the smallest node it reaches within a batch's forest.

    The forest is emptied when it is large, so that memory stays bounded; that only leaves more edges to the joins.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (up := parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    def emit() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield emit()
    yield emit()


#: Edges, one for each node at most, that one task joins; more are joined by star contractions.
SMALL = 200_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge that joins it to another node; root is the smallest node it reaches, for which no row comes.

    edges: two long columns; loops, repeats, either direction and nulls (ignored) are allowed. Each task reduces its edges to a forest; if
    these are few, one task joins them, and else rounds of star contractions do: each is two joins on written
    tables whose exchanges Spark can split where a node has very many edges; the number of edges never grows.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = store(pairs.mapInArrow(_forest, "u long, v long"), "edges")
    mark = _mark(e)
    if 0 < mark[0] <= SMALL:
        whole = store(e.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
        release(e)
        e, mark = whole, (0,)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = store(both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        rewired = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = store(rewired.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(e, near, large, least)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._stored = e._stored
    return out
