"""Graphs in DataFrames: connected components and sums up a forest, in rounds that grow with the logarithm of its depth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import broadcast_if_small, checkpointed

#: Links that one task looks at, at most about.
LINKS = 2_000_000


def connected_components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``, of one type that can be ordered): the least node it reaches.

    Nodes are numbered. While there are more than ``most`` links, tasks of about that many put a link from each node to one that stands for
    those it reaches by these alone, as long as links become half as many; the rest is one task's, or else goes in rounds.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    nodes = checkpointed(checkpointed(nodes).withColumn("__id", F.monotonically_increasing_id()))
    of = lambda c: broadcast_if_small(nodes.select(F.col("node").alias(c), F.col("__id").alias(f"__{c}")))
    edges = checkpointed(links.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    n = edges.count()
    while n > most:
        fewer = checkpointed(_stars(edges.repartition(-(-n // most), "a")))
        left = fewer.count()
        if left > n / 2:
            break
        edges, n = fewer, left
    labels = _by_rounds(edges) if n > most else _stars(edges.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))
    told = checkpointed(nodes.join(labels.withColumnRenamed("node", "__id"), "__id").select("node", F.col("component").alias("__root")))
    return told.join(broadcast_if_small(told.groupBy("__root").agg(F.min("node").alias("component"))), "__root").select("node", "component")


def _stars(edges: DataFrame) -> DataFrame:
    """``a, b``: each node of a task's ``edges`` with the least number that it reaches by these alone."""

    def of(parts):
        rows = [part for part in parts if len(part)]
        if not rows:
            return
        both = np.concatenate([part[c].to_numpy() for c in ("a", "b") for part in rows])
        nodes, at = np.unique(both, return_inverse=True)
        a, b = np.split(at, 2)
        root = np.arange(len(nodes))
        while True:
            p, q = root[a], root[b]
            apart = p != q
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
        yield pd.DataFrame({"a": nodes, "b": nodes[root]})

    return edges.mapInPandas(of, "a long, b long")


def _by_rounds(links: DataFrame) -> DataFrame:
    """``node, component`` as above, all by joins.

    Each round a node takes the least label among its neighbours', tells it to the node that its own label names, and then
    takes that node's label; whole trees of labels join, so rounds are few on long chains too. Joins have one row a node on
    the side of the labels.
    """
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        heard = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(heard, F.col("node") == F.col("a")).select(F.col("label").alias("a"), "near")
        offers = heard.unionByName(told).groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(offers, F.col("node") == F.col("a"), "left").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        over = lower.select(F.col("node").alias("up"), F.col("low").alias("over"))
        jumped = lower.join(over, F.col("low") == F.col("up")).select("node", F.least("low", "over").alias("label"), "was")
        labels = checkpointed(jumped.select("node", "label", (F.col("label") != F.col("was")).alias("changed")))
    return labels.select("node", F.col("label").alias("component"))


def summed_up(nodes: DataFrame, *sums: str) -> DataFrame:
    """``nodes`` (``node``, ``up``: the next one or null, and numbers ``sums``) with each number added over all nodes from which the way up comes by.

    A round hands each node's sum to the node 1, 2, 4, … steps up, and so doubles the depth that sums cover; the nodes
    below another at one depth are all different, so nothing counts twice. The ways must not run in circles.
    """
    state = checkpointed(nodes.select("node", "up", *sums))
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy(F.col("up").alias("to")).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
        further = state.select(F.col("node").alias("mid"), F.col("up").alias("beyond"))
        added = state.join(sent, F.col("node") == F.col("to"), "left").join(further, F.col("up") == F.col("mid"), "left")
        state = checkpointed(added.select("node", F.col("beyond").alias("up"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums]))
    return state.select("node", *sums)


def summed_down(nodes: DataFrame, value: str) -> DataFrame:
    """``nodes`` (``node``, ``up``, ``value``) with ``value`` added over the nodes on its way from each one on, its own included; ways must end."""
    state = checkpointed(nodes.select("node", "up", value))
    while not state.where("up is not null").isEmpty():
        further = state.select(F.col("node").alias("mid"), F.col("up").alias("beyond"), F.col(value).alias("more"))
        on = state.join(further, F.col("up") == F.col("mid"), "left")
        state = checkpointed(on.select("node", F.col("beyond").alias("up"), (F.col(value) + F.coalesce("more", F.lit(0))).alias(value)))
    return state.select("node", value)


def least_around(nodes: DataFrame) -> DataFrame:
    """``node, least`` of nodes on rings (``node`` and ``up``, the next one; every node is the next of one): the least node of its ring.

    A round doubles how far ahead a node has looked. When none has found less in a round, all have been around.
    """
    state = checkpointed(nodes.select("node", "up", F.col("node").alias("least"), F.lit(True).alias("changed")))
    while not state.where("changed").isEmpty():
        further = state.select(F.col("node").alias("mid"), F.col("up").alias("beyond"), F.col("least").alias("there"))
        on = state.join(further, F.col("up") == F.col("mid"))
        state = checkpointed(on.select("node", F.col("beyond").alias("up"), F.least("least", "there").alias("least"), (F.col("there") < F.col("least")).alias("changed")))
    return state.select("node", "least")
