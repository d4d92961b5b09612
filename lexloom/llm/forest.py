"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits a node by a random direction at a random middle quantile of a sample. Vectors close to the threshold go to both sides. Trees of
different directions separate a close pair independently, so few trees miss few pairs; a group in which any split would part links is not split. Pairs are compared exactly within
leaves; the links found are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, written
from .pairs import components, local_roots, tiles


#: The normal distribution function at _AT.
_AT = np.linspace(-8, 8, 3201)
_BELOW = np.array([0.5 + 0.5 * math.erf(x / math.sqrt(2)) for x in _AT])


class Forest:
    """Trees over unit vectors of one dimension. Nodes are (direction, threshold, left, right), a leaf's number, or None where earlier trees suffice."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = 24, leaf: int = 512, least: float = 0.95, seed: int = 11, floor: float = 0.6, missed: float = 1e-4, ways: int = 4):
        """sample: unit vectors; rows: how many the index will hold, which sets the depth; least: the cosine of a link.

        Of each sampled vector the forest reckons how likely a neighbour at the cosine `least`, in any direction, is still beside it. A node is not split
        where that would fall under `floor` on average: in a group as dense as the spill is wide every split parts links, so the group is one leaf.
        A node also ends as a leaf when its share of rows is `leaf` at most, when fewer than 8 of the sample are in it, or when its sample is so
        tight that a split would part links; leaves over a tile's size are compared tile by tile, so none is cut short. Trees are added, `trees` at
        most, until such a neighbour is missed by all of them with probability `missed` at most; a part of the space that is there sooner has no leaf in later trees.
        """
        self.dim = sample.shape[1] if len(sample) else 0
        self.near = np.sqrt(2 - 2 * least) / np.sqrt(max(1, self.dim))  # deviation of a link's length along a random direction
        self.spill = 0.25 * self.near
        self.leaves, self.least, self.floor, self.goal, self.ways = 0, least, floor, missed, ways
        draw = np.random.default_rng(seed)
        self.roots: list = []
        open_ = np.ones(len(sample))  # how likely each vector's neighbour is missed so far
        while len(sample) and len(self.roots) < trees and open_.mean() > missed:
            kept = np.zeros(len(sample))
            self.roots.append(self._node(sample, np.arange(len(sample)), np.ones(len(sample)), open_, kept, rows / len(sample), leaf, draw))
            open_ = open_ * (1 - kept)
        self.missed = float(open_.mean()) if len(sample) else 0.0

    def _node(self, sample: np.ndarray, rows: np.ndarray, beside: np.ndarray, open_: np.ndarray, kept: np.ndarray, each: float, leaf: int, draw: np.random.Generator):
        """rows: the node's part of the sample; beside: how likely a neighbour of each has come here with it."""
        if open_[rows].mean() <= self.goal:
            return None
        part, best = sample[rows], None
        if len(rows) * each > leaf and len(rows) >= 8 and np.linalg.norm(part.mean(axis=0)) < np.sqrt(self.least):
            for _ in range(self.ways):
                way = draw.standard_normal(self.dim)
                way /= np.linalg.norm(way)
                at = part @ way
                cut = float(np.quantile(at, draw.uniform(0.4, 0.6)))
                gap = at - cut
                left, right = gap < self.spill, gap > -self.spill
                larger = max(left.sum(), right.sum()) / len(rows)
                if larger == 1:
                    continue
                after = beside * np.where(left & right, 1.0, np.interp((np.abs(gap) + self.spill) / self.near, _AT, _BELOW))
                price = np.log(beside.mean() / after.mean()) / -np.log(larger)
                if min(after[left].mean(), after[right].mean()) >= self.floor and (best is None or price < best[0]):
                    best = price, way, cut, left, right, after
        if best is not None:
            _, way, cut, left, right, after = best
            return way, cut, *(self._node(sample, rows[x], after[x], open_, kept, each, leaf, draw) for x in (left, right))
        kept[rows] = np.maximum(kept[rows], beside)
        self.leaves += 1
        return self.leaves - 1

    def place(self, vectors: np.ndarray) -> list[list[int]]:
        """The leaves of each unit vector, in ascending order."""
        out: list[list[int]] = [[] for _ in range(len(vectors))]

        def down(node, rows: np.ndarray) -> None:
            if not len(rows) or node is None:
                return
            if isinstance(node, int):
                for r in rows.tolist():
                    out[r].append(node)
                return
            way, cut, left, right = node
            at = vectors[rows] @ way
            down(left, rows[at < cut + self.spill])
            down(right, rows[at > cut - self.spill])

        for root in self.roots:
            down(root, np.arange(len(vectors)))
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tile(least: float):
    def compare(part: pd.DataFrame) -> pd.DataFrame:
        """A tile's links: of each vector how many others it links (copies counted) and the least of those it hangs together with."""
        part = part.sort_values("rep", ignore_index=True)
        v, block, n = unit(np.stack(part["embedding"].to_numpy())), part["__block"].to_numpy(), part["n"].to_numpy()
        linked = v @ v.T >= least
        np.fill_diagonal(linked, False)
        if part["__i"].iat[0] != part["__j"].iat[0]:
            linked &= block[:, None] != block[None, :]
        if linked.any():
            leaf = part["leaf"].iat[0]
            own = [x[x < leaf] for x in part["leaves"]]
            earlier = np.unique(np.concatenate(own))
            if len(earlier):  # a pair counts in the first leaf that it shares
                shares = np.zeros((len(part), len(earlier)), np.float32)
                for i, x in enumerate(own):
                    shares[i, np.searchsorted(earlier, x)] = 1
                linked &= shares @ shares.T == 0
        rep, root = part["rep"].to_numpy(), local_roots(linked)
        at = np.flatnonzero(linked.any(axis=1))
        return pd.DataFrame({"rep": rep[at], "links": (linked[at] @ n).astype(np.int64), "to": rep[root[at]]})

    return compare


def near_duplicates(vectors: DataFrame, least: float = 0.95, sample: int = 20_000, trees: int = 24, leaf: int = 512) -> DataFrame:
    """vectors (vec_id, embedding; others ignored) to vec_id, n_links, component_id, kept, a row for each row.

    Links are pairs found with cosine >= least, in double precision. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing and are components of their own. Equal vectors are one in the forest and count as links of each other.
    Rows of null id link with nothing and have a null component; rows that repeat an id and a vector count as copies.
    Only vectors of one length are compared; the forest serves the commonest length, and those of any other length are compared tile by tile.

    sample bounds the vectors that the trees are fitted on (those of the smallest hashes of ids); every vector is placed in every tree.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as floats
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = base.withColumn("ok", F.coalesce(whole, F.lit(False))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    ids = written(keyed.select("vec_id", "ok", "h1", "h2", F.size("embedding").alias("dim")))
    reps = ids.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"))
    reps = written(reps)
    dims = reps.groupBy("dim").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dim").first()
    found = base.where(whole).join(reps, F.col("vec_id") == F.col("rep")).where((F.xxhash64("embedding") == F.col("h1")) & (F.xxhash64(F.lit(7), "embedding") == F.col("h2")))
    found = written(found.groupBy("rep", "h1", "h2").agg(F.first("n").alias("n"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding")).drop("h1", "h2"))
    if dims is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim, rows = dims["dim"], dims["rows"]
    seen = found.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toPandas()["embedding"]
    forest = Forest(unit(np.stack(seen.to_numpy())), rows, trees, leaf, least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [[-int(d)] for d in batch["dim"]]  # other lengths: a leaf of their own
            at = np.flatnonzero(batch["dim"].to_numpy() == dim)
            if len(at):
                for i, x in zip(at.tolist(), forest.place(unit(np.stack(batch["embedding"].to_numpy()[at]))), strict=True):
                    own[i] = x
            yield batch[["rep", "n", "embedding"]].assign(leaves=own)

    placed = found.mapInPandas(place, f"rep long, n long, embedding {kind}, leaves array<int>")
    placed = written(placed)
    members = placed.withColumn("leaf", F.explode("leaves"))
    out = written(tiles(members, "leaf", "rep", 2 * leaf).groupBy("leaf", "__i", "__j").applyInPandas(_tile(least), "rep long, links long, to long"))
    parts = components(out.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = out.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("h1", "h2", "rep", "n").join(links.withColumnRenamed("rep", "r1"), F.col("rep") == F.col("r1"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    rows_out = ids.join(known, F.col("ok") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "vec_id")
    return rows_out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
