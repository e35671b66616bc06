"""Connected groups of pairwise links, by union-find over edge blocks and merged spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceforge.operators.skew import heavy_keys, skew_lookup
from spliceforge.session import materialize, ship_package

#: Edges that one union-find holds in memory (about 150 bytes each while it works).
BLOCK_EDGES = 1_000_000
FOREST = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node linked to each: a forest of stars that connects what the edges connect."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        u, v = parent[u], parent[v]
        open_ = u != v
        if not open_.any():
            return nodes, nodes[parent]
        u, v = u[open_], v[open_]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))  # every root links to its smallest neighbour
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _forests(block_edges: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        def forest() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spanning_forest(np.concatenate(a), np.concatenate(b))], schema=FOREST)

        for batch in batches:
            if not batch.num_rows:
                continue
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= block_edges:
                yield forest()
                a, b, held = [], [], 0
        if held:
            yield forest()

    return emit


def connected_groups(links: DataFrame, left: str, right: str, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """node, group_id (both int64) of every node of a link; group_id is the smallest node linked to it in any number of steps.

    Each partition runs union-find over blocks of at most ``block_edges`` edges and passes on only a spanning forest (every
    node with its block's root). A node found in several blocks links their roots; these links, over fewer nodes each round,
    form the next level, in as many blocks as ``block_edges`` asks for, until one block holds them all. Then every level's
    nodes look up what became of their root, those of roots with very many nodes by broadcast. No node, link or group is ever gathered in the driver, and a node that a third
    of the links share reaches the shuffle once for each block.

    Links with a null end are left out; a link of a node with itself makes it a member of (at least) its own group; repeated
    and reversed links change nothing; an empty table gives no row.
    """
    spark = links.sparkSession
    ship_package(spark)
    kernel = _forests(block_edges)
    ends = [F.col(c).cast("long") for c in (left, right)]
    edges = links.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), *[e.alias(n) for e, n in zip(ends, "xy")]).where("x is not null and y is not null").select("a", "b")
    levels: list[DataFrame] = []
    while True:
        forest = edges.mapInArrow(kernel, "node long, root long")
        by_node = forest.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots"))
        level = materialize(by_node, "forest-level")
        levels.append(level)
        joins = level.where(F.size("roots") > 1)
        rest = joins.agg(F.sum(F.size("roots") - 1)).first()[0]
        if not rest:
            break
        edges = joins.select(F.get("roots", F.lit(0)).alias("a"), F.explode(F.slice("roots", F.lit(2), F.size("roots") - 1)).alias("b"))
        blocks = -(-rest // block_edges)
        # by ranges of the smaller end, chains of ascending nodes fall into one block
        edges = edges.repartition(1) if blocks == 1 else edges.repartitionByRange(blocks, "a")
    own = lambda level: level.select("node", F.get("roots", F.lit(0)).alias("up"))
    groups = own(levels[-1]).select("node", F.col("up").alias("group_id"))
    for level in reversed(levels[:-1]):
        # one root may stand for a third of all nodes
        above = groups.select(F.col("node").alias("above"), F.col("group_id").alias("of_up"))
        below = own(level)
        groups = skew_lookup(below, above, "up", "above", heavy_keys(below, "up"), "left").select("node", F.coalesce("of_up", "up").alias("group_id"))
    return groups
