"""Connected components of a table of links: forests within tasks, and star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stage

#: Links that one task contracts; their arrays take some 100 MB.
TASK_LINKS = 1_000_000


def union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v, each root under the smaller; afterwards every node points to its root."""
    while True:
        a, b = parent[u], parent[v]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def contract(links: DataFrame) -> DataFrame:
    """links with each partition's part replaced by stars around the least nodes: what was connected there stays so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = np.zeros((0, 2), np.int64)
        for b in batches:
            both = np.concatenate([stars, np.column_stack([np.asarray(b.column(0)), np.asarray(b.column(1))])])
            nodes, at = np.unique(both, return_inverse=True)
            at, parent = at.reshape(-1, 2), np.arange(len(nodes))
            union(parent, at[:, 0], at[:, 1])
            far = np.nonzero(parent != np.arange(len(nodes)))[0]
            stars = np.column_stack([nodes[far], nodes[parent[far]]])
        yield pa.record_batch([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def _to_least(links: DataFrame) -> DataFrame:
    """links (u, v) with the least of u and its v as `m`. A hub's links meet one row; joining on the hash besides u has both sides dealt anew, so Spark may split the hub."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.xxhash64("u").alias("h"), F.least("u", "m").alias("m"))
    return links.withColumn("h", F.xxhash64("u")).join(least, ["u", "h"]).select("u", "v", "m")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, task_links: int = TASK_LINKS, max_rounds: int = 60) -> DataFrame:
    """(node, least) for every node that occurs in links (u, v), both long and never null: the smallest node it reaches.

    Links are contracted in as many tasks as their number asks for. Where one task is enough, its stars are the answer.
    Otherwise rounds follow, each written and read again: large-star hangs a node's larger neighbours on its least neighbour,
    small-star the smaller ones, and tasks contract what they hold. When nothing changes, each component is a star around its
    least node.
    """
    links = stage(links.where("u <> v"))
    before = _state(links)
    for _ in range(max_rounds):
        tasks = -(-before[0] // task_links)
        if tasks <= 1:
            links = stage(contract(links.coalesce(1)))
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        links = stage(contract(linked.distinct().coalesce(tasks)))
        if (now := _state(links)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components have not settled in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("least"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
