"""Comparing the members of groups in tiles of bounded size, and joining links into components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a tile's side.
SIDE = 512


def tiles(members: DataFrame, group: str, member: str, side: int = SIDE) -> DataFrame:
    """members dealt out to tiles: adds __block, __i and __j.

    A group of up to `side` members is one tile. A larger one is cut into blocks by a hash of the member, and each pair of
    blocks is a tile, so the largest task is two blocks, whatever a group holds, and no pair is left out. Groups of one are dropped.
    """
    blocks = members.groupBy(group).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(group).alias("__g"), F.ceil(F.col("__n") / side).cast("int").alias("__blocks"))
    dealt = members.join(blocks, F.col(group) == F.col("__g")).drop("__g").withColumn("__block", F.pmod(F.xxhash64(member, F.lit(5)), F.col("__blocks")).cast("int"))
    other = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return other.withColumn("__i", F.least("__block", "__o")).withColumn("__j", F.greatest("__block", "__o")).drop("__o", "__blocks")


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the least place in each place's component."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, component), the component's smallest node; nodes without an edge are left out.

    Large-star and small-star by turns (Kiveris et al., 2014): each round joins the edges to their nodes' least
    neighbours, an aggregate that is combined before the shuffle, and the joins split hot nodes. Each round is written to the shared folder. Nothing
    comes to the driver but two numbers a round. Ends when a round changes nothing.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen or not now["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        seen = (now["n"], now["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(small)
