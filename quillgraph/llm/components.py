"""Connected components of an edge table.

Every task first contracts the edges that it holds to a forest of stars. Few edges that are left are
contracted by one task, which holds them in memory; more than that (the count is checked) go through
large-star and small-star rounds, all in DataFrames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import delete, materialize, new_path


#: Edges that one task contracts at most: some 100 bytes each while it does.
LOCAL_EDGES = 2_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the smallest of its component, and that smallest node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def _contract(batches):
    """Edges (u, v) to their stars, a bounded number of edges at a time."""
    held, n = [], 0

    def flush():
        u, v = (np.concatenate([t.column(i).to_numpy(zero_copy_only=False) for t in held]) for i in (0, 1))
        u, v = stars(u, v)
        kind = held[0].schema.types[0]
        return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= LOCAL_EDGES:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component: for every node of an edge the smallest node that it is connected with.

    In the rounds, each hangs the larger neighbours of every node on the smallest one (large star), then the smaller
    neighbours likewise (small star), until nothing changes: O(log n) rounds in practice. A round's edges are
    a table in the shared folder; only row counts and checksums come to the driver. Edges with a null end and
    self-loops are left out, repeated edges count once. No edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    path = new_path(spark, "edges")
    schema = ends.schema
    ends.mapInArrow(_contract, schema).write.parquet(path)
    now = spark.read.schema(schema).parquet(path)
    if now.count() <= local_edges:
        found = _nodes(materialize(now.coalesce(1).mapInArrow(_contract, schema), "stars"))
        delete(spark, path)
        return found
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        after_path = new_path(spark, "edges")
        _round(now).write.parquet(after_path)
        after = spark.read.schema(schema).parquet(after_path)
        after_state = _state(after)
        delete(spark, path)
        now, path = after, after_path
        if after_state == state:
            break
        state = after_state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return _nodes(now)


def _nodes(forest: DataFrame) -> DataFrame:
    roots = forest.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(pairs: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v in and out. The least neighbour of each node is an aggregate that combines
    before the shuffle, and joins back, so that a node with very many neighbours never meets one task."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Large star: neighbours above u go to the least of u and its neighbours.
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # Small star: u and its neighbours below go to the least of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components_of(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """nodes with component: its own id for a node without edges."""
    found = materialize(connected_components(edges, a, b), "components")
    return nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
