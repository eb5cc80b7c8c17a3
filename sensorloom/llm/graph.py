"""Connected components of a graph of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import dropped, saved


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges a-b, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up[x], up[y]):
            return nodes, nodes[up]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    held = [(none, none), *((x["a"].to_numpy(), x["b"].to_numpy()) for x in batches)]
    node, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
    leaf = node != root
    yield pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(root[leaf])], names=["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component; a, b long are the edges.

    In each round every partition contracts its own edges to stars, so that a node has one
    centre for each partition at most; the centres of a node are then hooked to the
    smallest of them, and each node moves on to its centre's centre. The edges do not
    grow beyond two for each node and partition, and rounds are logarithmic in practice.
    Every round ends in a checkpoint. Nodes without edges do not appear; null ends and
    loops are ignored; repeated edges count once.
    """
    e = edges.where("a <> b").select("a", "b")
    before = None
    for _ in range(rounds):
        centres = e.mapInArrow(_contract, "a long, b long").groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("s"))
        own = F.struct(F.col("a"), F.col("m").alias("b"), (F.size("s") > 1).alias("moved"))
        others = F.transform(F.filter("s", lambda x: x != F.col("m")), lambda x: F.struct(x.alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved")))
        hooked = centres.select(F.explode(F.concat(F.array(own), others)).alias("e")).select("e.*")
        up = hooked.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("above"))
        e = saved(hooked.join(up, F.col("b") == F.col("centre"), "left").select("a", F.coalesce("above", "b").alias("b"), (F.col("moved") | F.col("above").isNotNull()).alias("moved")))
        dropped(before)
        before = e
        if e.where("moved").isEmpty():
            break
        e = e.select("a", "b")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
