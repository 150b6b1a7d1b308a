"""Groups of all records linked directly or indirectly.

Union-find runs inside every partition of edges and keeps its spanning forest
only, as stars: one row (node, smallest node of its local component).  Forests
are then merged through fewer and fewer partitions, none of which ever takes
up more than ``bound`` rows at a time, until one bounded partition gives the
global components.  Where the nodes alone are more than that, the forests are
contracted by joins instead (every parent of a node hangs itself under the
smallest one, then pointers jump) until each component is one star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.plans.scratch import dropped, written

#: Rows that one union-find holds at a time: two ids each, about 100 MB with all working arrays.
BOUND = 2_000_000
#: Partitions merged into one at each level.
FAN_IN = 8


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return nodes, nodes[parent]


def _local(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, None

        def reduced():
            u = np.concatenate([x for x, _ in held])
            v = np.concatenate([x for _, x in held])
            return spanning_stars(u, v)

        def out(nodes, roots):
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[k : k + 100_000], kind), pa.array(roots[k : k + 100_000], kind)], names=["u", "v"]
                )

        for b in batches:
            kind = b.schema.field(0).type
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= bound:
                stars = reduced()
                held, n = [stars], len(stars[0])
                if n > bound // 2:  # the forest itself is large: hand it on rather than hold it
                    yield from out(*stars)
                    held, n = [], 0
        if held:
            yield from out(*reduced())

    return run


def connected_components(
    edges: DataFrame, a: str, b: str, bound: int = BOUND, fan_in: int = FAN_IN
) -> DataFrame:
    """(node, component): every id of a row with both ids, with the smallest id linked to it.

    Ids may be of any integer type or strings.  Rows with a null id link
    nothing and name no node; repeated, swapped and self pairs are fine; other
    columns are ignored; no rows give no rows.
    """
    kind = edges.schema[a].dataType
    pairs = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    run = _local(bound)
    schema = pairs.schema
    forest = written(pairs.mapInArrow(run, schema), "forest")
    rows = forest.count()
    tasks = max(1, -(-rows // bound))
    while tasks > 1:
        # another level: each task merges the forests of up to fan_in tasks
        fewer = max(1, -(-tasks // fan_in))
        merged = written(forest.repartition(fewer * max(1, fan_in // 2), "u").mapInArrow(run, schema), "forest")
        dropped(forest)
        forest, before = merged, rows
        rows = forest.count()
        tasks = max(1, -(-rows // bound))
        if tasks > 1 and rows > 0.7 * before:
            return _contracted(forest, run)
    return forest.coalesce(1).mapInArrow(run, schema).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _contracted(forest: DataFrame, run) -> DataFrame:
    """Components of more nodes than one task may hold."""
    while True:
        star = written(forest.groupBy("u").agg(F.min("v").alias("v")), "star")
        up = star.select(F.col("u").alias("v"), F.col("v").alias("w"))
        hung = (
            forest.join(star.withColumnRenamed("v", "w"), "u").where("v <> w")
            .select(F.col("v").alias("u"), F.col("w").alias("v"))
        )
        # AQE splits the rows that hang under one root of a large component
        jumped = star.unionByName(hung).join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        after = written(jumped.mapInArrow(run, forest.schema), "forest")
        many = after.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        unsettled = (
            many.where("lo <> hi").limit(1).count()
            or many.join(many.select(F.col("u").alias("lo"), F.col("lo").alias("top")), "lo").where("lo <> top").limit(1).count()
        )
        dropped(forest)
        dropped(star)
        forest = after
        if not unsettled:
            return forest.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
