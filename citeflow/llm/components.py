"""Connected components over a links table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of some links: (node, smallest node of its component), for nodes other than the smallest."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the links of a task in blocks of bounded size; only links are merged, so none is lost."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        u, v = contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n > 2_000_000:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """``links`` (a long, b long) -> (node long, root long): each linked node other than its component's smallest
    node, with that smallest node.

    Each round is a written table, so the driver sees two numbers a round and no link. Nulls and links of a node to
    itself are left out; repeated links count once; no links give no rows. The star steps join on the node, where
    AQE splits a hub's rows, and take minima with partial aggregation.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    edges = scratch.keep(pairs.mapInArrow(_contract_batches, "u long, v long").distinct(), f"{name}-0")
    seen = _mark(edges)
    for n in range(1, 100):
        if not seen[0]:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle in 99 rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free hash of all links: equal before and after a round that changed nothing."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())
