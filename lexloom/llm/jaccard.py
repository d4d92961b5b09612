"""Near-duplicate documents by n-gram Jaccard similarity, with Bayesian pruning of candidates.

Documents that share a band of MinHash values are candidates, each pair in the first band it shares. There, tile by tile, pairs are compared
sixteen MinHash values at a time; a pair is dropped as soon as the posterior probability that its similarity reaches the threshold is
below a tolerance. What is left is verified on the whole sets of n-grams: what hangs together is cut into tiles, and a set goes only to
tiles in which it has a partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, groups, mixed, read, rounds, slices, whole_row, window_hashes, written
from .pairs import components, local_roots, tiles

#: MinHash values in a band, bands, and values that are compared at a time.
ROWS, BANDS, STEP = 4, 24, 16
HASHES = ROWS * BANDS
_DRAW = np.random.default_rng(20)
_A = _DRAW.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x6A09E667F3BCC909)
_B = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)


def shingles(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct n-grams of words as sorted 64-bit hashes; a text of fewer words is one n-gram, one of none has none."""
    out: list[np.ndarray] = []
    for a, b in rounds(texts):
        words = Words(texts[a:b])
        grams = window_hashes(words.hashes, width)
        for i in range(b - a):
            first, n = words.first[i], words.count[i]
            if n >= width:
                out.append(np.unique(grams[first : first + n - width + 1]))
            else:
                out.append(window_hashes(words.hashes[first : first + n], n) ^ np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of sets, none of them empty."""
    out = np.empty((len(sets), HASHES), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size, to = size + len(sets[to]), to + 1
        all_of, starts = np.concatenate(sets[at:to]), np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat(all_of * _A[k] + _B[k], starts)
        at = to
    return out


def needed(least: float, tolerance: float) -> list[int]:
    """For n compared values the matches below which a pair is dropped: with a flat prior the posterior probability that
    the similarity is `least` or more, given m matches of n, is that of at most m successes in n + 1 draws."""
    out = []
    for n in range(HASHES + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(signs: np.ndarray, allowed: np.ndarray, least: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j, allowed[i, j]) that no round of comparisons drops."""
    limit = needed(least, tolerance)
    i, j = np.nonzero(np.triu(allowed, 1))
    matches = np.zeros(len(i), np.int32)
    for at in range(0, HASHES, STEP):
        for part in range(0, len(i), 1 << 16):
            s = slice(part, part + (1 << 16))
            matches[s] += (signs[i[s], at : at + STEP] == signs[j[s], at : at + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= limit[at + STEP]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets i and j: pair by pair if few, else by products of incidence matrices."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = times[column] > 1
    row, column = row[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), step), np.float32)
        x[row[low:high], column[low:high] - at] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def bands_of(signs: np.ndarray) -> np.ndarray:
    """Signatures as one long a band: 16 bits of each of its values. Equal values stay equal; others are taken for equal once in 65,536 times,
    which adds candidates and takes none away."""
    return np.ascontiguousarray(mixed(signs).astype(np.uint16)).view(np.int64)


def cells(nodes: np.ndarray) -> np.ndarray:
    """31 bits of each node, whose first bits are its block in a group that is cut into blocks."""
    return (mixed(nodes.astype(np.int64).view(np.uint64) ^ _SECOND) >> np.uint64(33)).astype(np.int32)


def _allowed(part: pd.DataFrame) -> np.ndarray:
    """Which pairs are a tile's own: all within one block, else those of its two blocks."""
    block = part["__block"].to_numpy()
    return np.ones((len(part), len(part)), bool) if part["__i"].iat[0] == part["__j"].iat[0] else block[:, None] != block[None, :]


def _matrix(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    return linked


def _bucket(part: pd.DataFrame, least: float, tolerance: float) -> pd.DataFrame:
    """Of a tile of a bucket the nodes with partners: pairs that share no earlier band and that no comparison drops."""
    part = part.sort_values("node", ignore_index=True)
    bands = np.stack(part["bands"].to_list()).astype(np.int64, copy=False)
    allowed = _allowed(part)
    for b in range(int(part["k"].iat[0])):
        allowed &= bands[:, b][:, None] != bands[:, b][None, :]
    linked = _matrix(len(part), *survivors(np.ascontiguousarray(bands).view(np.uint16), allowed, least, tolerance))
    node, at = part["node"].to_numpy(), np.flatnonzero(linked.any(axis=1))
    cell = cells(node)
    return pd.DataFrame({"node": node[at], "root": node[local_roots(linked)[at]], "own": cell[at], "others": pd.Series([cell[linked[x]] for x in at], dtype=object)})


def candidates(nodes: DataFrame, least: float, tolerance: float, side: int = 512) -> DataFrame:
    """nodes (node, bands) to (node, root, own, others): the partners of a node are the nodes that share a band with it and that no comparison
    drops; each is in one row's `others`, by its cell. own is the node's cell; rows (node, root) join what partners join. A row a node and tile.

    Of buckets with the same members (a count and 128 bits of them) the first has all their pairs, so only that goes on: near copies
    travel once and not for each band they share. A larger bucket is cut into tiles.
    """
    keyed = nodes.select("node", F.posexplode("bands").alias("k", "band"))
    buckets = keyed.groupBy("k", "band").agg(F.count("*").alias("n"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y")).where("n > 1")
    first = buckets.groupBy("n", "m", "x", "y").agg(F.min(F.struct("k", "band")).alias("f")).select(F.col("f.k").alias("__k"), F.col("f.band").alias("__b"), F.monotonically_increasing_id().alias("bucket"))
    first = written(first)
    members = written(keyed.join(first, (F.col("k") == F.col("__k")) & (F.col("band") == F.col("__b"))).select("bucket", "k", "node"))
    signed = members.join(nodes.select(F.col("node").alias("__m"), "bands"), F.col("node") == F.col("__m")).drop("__m")
    keys = ["bucket", "__i", "__j"]
    dealt = tiles(signed, "bucket", "node", side).repartition(slices(nodes), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches, keys):
            yield _bucket(part, least, tolerance)

    return dealt.mapInPandas(compare, "node long, root long, own int, others array<int>")


def _tile(part: pd.DataFrame, least: float, tolerance: float) -> pd.DataFrame:
    """A tile's links, verified on whole sets: of each node how many rows it links with, and where its links lead."""
    part = part.sort_values("node", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in part["grams"]]
    signs = np.stack(part["bands"].to_list()).astype(np.int64, copy=False)
    i, j = survivors(np.ascontiguousarray(signs).view(np.uint16), _allowed(part), least, tolerance)
    size = np.array([len(s) for s in sets])
    both = common(sets, i, j)
    ok = both >= least * (size[i] + size[j] - both) - 1e-9
    linked = _matrix(len(part), i[ok], j[ok])
    node, at = part["node"].to_numpy(), np.flatnonzero(linked.any(axis=1))
    return pd.DataFrame({"node": node[at], "links": (linked[at] @ part["n"].to_numpy()).astype(np.int64), "to": node[local_roots(linked)[at]]})


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, tolerance: float = 1e-8, side: int = 256, bits: int = 64) -> DataFrame:
    """docs (doc_id, text; others ignored) to doc_id, tx, class_id, n_links, kept, a row for each row of docs.

    Links are pairs with Jaccard similarity >= least over whole sets of n-grams of `width` words. n_links counts the other rows
    linked directly, class_id is the smallest doc_id of those that links join, kept is true for the one row with it (of rows that repeat that id,
    those with the smallest tx). Texts with equal sets, known by 128 bits, are one node with a number of copies, so copies are never paired; a node goes by `bits` of
    them, and nodes that these do not tell apart get others. Null and empty texts link with nothing; texts of fewer than `width` words are one n-gram. Null ids count as largest and are their class's id only if it has no other.

    A pair of similarity 0.8 shares none of 24 bands of 4 values with probability 3e-6; the tolerance adds 1e-8 a round.

    Scale: texts are read twice, once for signatures, and again only of one row of each node that has a candidate. Work is by pairs that
    outlive the comparisons, not by what bands join: a long chain of part-alike documents costs its own pairs.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            sets = shingles([t if isinstance(t, str) else None for t in texts], width)
            some = [i for i, s in enumerate(sets) if len(s)]
            signs = signatures([sets[i] for i in some])
            node, second = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            bands: list[np.ndarray | None] = [None] * len(sets)
            with np.errstate(over="ignore"):
                for i in some:
                    other = mixed(sets[i] ^ _SECOND)
                    node[i], second[i] = mixed(np.array([sets[i].sum() + np.uint64(len(sets[i])) ^ np.bitwise_xor.reduce(mixed(sets[i])), other.sum() ^ np.bitwise_xor.reduce(mixed(other))], np.uint64)).view(np.int64) >> (64 - bits, 0)
            if some:
                for i, band in zip(some, bands_of(signs), strict=True):
                    bands[i] = band
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tx": batch["tx"], "node": pd.array([int(x) if len(s) else None for x, s in zip(node, sets, strict=True)], "Int64"), "second": second, "bands": bands})

    signed = written(base.withColumn("tx", F.xxhash64("text")).mapInPandas(sign, "doc_id long, tx long, node long, second long, bands array<long>"))
    clash = signed.where("node is not null").groupBy(F.col("node").alias("__c")).agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo < hi")
    clash = written(clash)
    if not clash.isEmpty():
        joined = signed.join(clash, F.col("node") == F.col("__c"), "left")
        signed = written(joined.withColumn("node", F.when(F.col("lo") < F.col("second"), F.xxhash64("node", "second")).otherwise(F.col("node"))).drop("__c", "lo", "hi"))
    # one row of each node has its bands
    nodes = written(signed.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "tx")).alias("rep"), F.first("bands").alias("bands")))
    near = written(candidates(nodes.select("node", "bands"), least, tolerance, 2 * side))
    group = written(components(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    chosen = group.join(nodes.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).select("node", "n", "bands", F.col("rep.d").alias("__d"), F.col("rep.tx").alias("__t"))
    texts = base.join(chosen, (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("__d")) & (F.xxhash64("text") == F.col("__t")))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["node", "n", "bands"]].assign(grams=[s.tobytes() for s in shingles(batch["text"].tolist(), width)])

    members = texts.select("node", "n", "bands", "text").mapInPandas(grams, "node long, n long, bands array<long>, grams binary")
    members = members.groupBy(F.col("node").alias("__m")).agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    # a group is cut into blocks by its nodes' cells, and a node's set goes to the tiles of its block and those that have a partner of it
    cut = group.groupBy(F.col("component").alias("__g")).agg((31 - F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / side)))).cast("int").alias("__bits"))
    placed = group.join(cut, F.col("component") == F.col("__g")).select(F.col("node").alias("__n"), F.col("component").alias("group"), "__bits")
    block = lambda cell: F.call_function("shiftright", cell.cast("long"), F.col("__bits")).cast("int")
    reach = near.join(placed, F.col("node") == F.col("__n")).select("group", "node", block(F.col("own")).alias("__block"), F.array_distinct(F.transform("others", block)).alias("__others"))
    reach = reach.groupBy("group", "node", "__block").agg(F.array_distinct(F.flatten(F.collect_list("__others"))).alias("__others"))
    asked = reach.select("group", "node", "__block", F.explode("__others").alias("__o")).select("group", F.least("__block", "__o").alias("__i"), F.greatest("__block", "__o").alias("__j"), "__block", "node")
    keys = ["group", "__i", "__j"]
    parts = slices(docs)
    dealt = asked.join(members, F.col("__m") == F.col("node")).drop("__m").repartition(parts, *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches, keys):
            yield _tile(part, least, tolerance)

    found = written(dealt.mapInPandas(compare, "node long, links long, to long"))
    joined = components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "__c")
    links = found.groupBy(F.col("node").alias("__l")).agg(F.sum("links").alias("links"))
    known = nodes.join(links, F.col("node") == F.col("__l"), "left").join(joined, F.col("node") == F.col("__c"), "left").select("node", "rep", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = written(known)
    heads = known.groupBy(F.col("component").alias("__h")).agg(F.min("rep").alias("head"))
    known = known.join(heads, F.col("component") == F.col("__h")).select(F.col("node").alias("__n"), "links", "head")
    out = signed.select("doc_id", "tx", "node").join(known, F.col("node") == F.col("__n"), "left")
    class_id = F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("head.d"), F.lit((1 << 63) - 1)))
    kept = F.col("__n").isNull() | ((F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("head.d")) & (F.col("tx") == F.col("head.tx")))
    return out.select("doc_id", "tx", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of near duplicates, all columns as they are, whatever they are called; rows without n-grams stay.

    Of rows that repeat the id and the text that stay, the first by all their columns.
    """
    decided = written(near_duplicates(docs, **options))
    i, t, kept = fresh(docs, "__id", "__tx", "__row")
    gone = decided.where("not kept").select(F.col("doc_id").alias(i), F.col("tx").alias(t)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t))
    left = docs.join(gone, same, "left_anti")
    repeated = decided.where("kept and n_links > 0").groupBy(F.col("doc_id").alias(i), F.col("tx").alias(t)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated)
    if repeated.isEmpty():
        return left
    one = left.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(t)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), whole_row(docs)).alias(kept)).select(f"{kept}.*")
    return left.join(repeated, same, "left_anti").unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("tx")
