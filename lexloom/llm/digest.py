"""Improbable-feature digests of texts.

A feature is a window of 64 bytes. Its rarity is the rank of its Shannon entropy among the entropies of all windows of the corpus: the fewer windows share
an entropy, the rarer. Among 64 windows in a row the rarest scores a point; windows with 16 points or more are a text's improbable
features. They go in order into a chain of Bloom filters of 2,048 bits, five bits a feature, 160 features a filter. Two
digests are as like as their filters' common bits, less those that chance would set, are to the most they could have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, mixed, read, slices

WINDOW, SPAN, POINTS, BITS, PER_FILTER, BITS_EACH = 64, 64, 16, 2048, 160, 5
#: Entropies are told apart in thousandths of the largest, 6 bits; those below LOW are of runs and never rare.
STEPS, LOW = 1000, 100
#: Likeness below this share of the way from chance to the most is none.
NOISE = 0.15
MARK = "ipf1"
#: Bytes of text in a round of work, so that its arrays stay in the processor's cache.
ROUND = 1 << 17

_COUNTS = np.arange(WINDOW + 2)
_BITS_OF = np.round(_COUNTS * np.log2(np.maximum(1, _COUNTS)) * (1 << 20)).astype(np.int64)
_ONE_MORE = np.diff(_BITS_OF)


def entropies(x: np.ndarray) -> np.ndarray:
    """Of each window of 64 bytes in x the Shannon entropy, in STEPS. Exact: sums of whole numbers, whatever stands before.

    The sum of n log n over a window's byte counts changes by the first byte's count and by the next byte's as the window moves, and
    those counts are the number of equal bytes among 63 neighbours.
    """
    n = len(x) - WINDOW + 1
    after, before = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for d in range(1, WINDOW):
        same = (x[:-d] == x[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    first = _BITS_OF[np.bincount(x[:WINDOW], minlength=256)].sum()
    total = np.empty(n, np.int64)
    total[0] = first
    if n > 1:
        np.cumsum(_ONE_MORE[before[WINDOW:]] - _ONE_MORE[after[: n - 1]], out=total[1:])
        total[1:] += first
    full = WINDOW * 6 << 20
    return ((full - total) * STEPS // full).astype(np.int32)


def _rounds(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= ROUND:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, those shorter than a window filled with zeros; each text's first place and its number of windows."""
    full = [t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts]
    lengths = np.fromiter(map(len, full), np.int64, len(full))
    return np.frombuffer(b"".join(full), np.uint8), np.cumsum(lengths) - lengths, lengths - WINDOW + 1


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy."""
    out, texts = np.zeros(STEPS + 1, np.int64), [t for t in texts if t]
    for a, b in _rounds(texts):
        x, first, n = _joined(texts[a:b])
        own = np.zeros(len(x), np.int8)
        own[first] += 1
        ends = first + n
        own[ends[ends < len(x)]] -= 1
        out += np.bincount(entropies(x)[np.cumsum(own)[: len(x) - WINDOW + 1] > 0], minlength=STEPS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Of each entropy its rank: 0 for the one that fewest windows have."""
    order = np.lexsort((np.arange(STEPS + 1), counts))
    out = np.empty(STEPS + 1, np.int64)
    out[order] = np.arange(STEPS + 1)
    out[:LOW] = STEPS + 1
    return out


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters (rows of BITS / 8 bytes); none for an empty text."""
    out: list[np.ndarray] = [np.zeros((0, BITS // 8), np.uint8)] * len(texts)
    for a, b in _rounds(texts):
        at = [i for i in range(a, b) if texts[i]]
        if not at:
            continue
        x, first, n = _joined([texts[i] for i in at])
        size = len(x) - WINDOW + 1
        key = rank[entropies(x)] << 40 | np.arange(size)
        inside = np.zeros(size + 1, np.int8)
        inside[first] += 1
        np.subtract.at(inside, np.minimum(first + n, size), 1)
        key[np.cumsum(inside)[:size] <= 0] = np.iinfo(np.int64).max
        least = np.concatenate([key, np.full(SPAN, np.iinfo(np.int64).max)])
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        spans = np.maximum(1, n - SPAN + 1)
        starts = np.repeat(first, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        points = np.bincount(least[starts] & ((1 << 40) - 1), minlength=size)
        enough = np.minimum(POINTS, np.maximum.reduceat(points, first))
        places = np.flatnonzero(points)
        doc = np.searchsorted(first, places, "right") - 1
        chosen = points[places] >= enough[doc]
        places, doc = places[chosen], doc[chosen]
        powers, inverse = _powers(len(x) + 1)
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)], out=run[1:])
        hashes = mixed((run[places + WINDOW] - run[places]) * inverse[places])
        order = np.lexsort((places, hashes, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        keep = np.sort(order[new])
        doc, hashes = doc[keep], hashes[keep]
        per = np.bincount(doc, minlength=len(at))
        chain = -(-per // PER_FILTER)
        begin = np.cumsum(chain) - chain
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        filter_no = begin[doc] + nth // PER_FILTER
        bits = np.zeros((int(chain.sum()), BITS), np.uint8)
        for k in range(BITS_EACH):
            bits[filter_no, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        packed = np.packbits(bits, axis=1)
        for i, f, c in zip(at, begin, chain, strict=True):
            out[i] = packed[f : f + c]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of the shorter chain's filters the mean of their best normalised overlap with one of the other's. Two empty chains: 1; one: 0."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, na, strict=True):
        common = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        most, chance = np.sqrt(n * nb), n * nb / BITS  # the most is what equal filters share
        floor = chance + NOISE * (most - chance)
        total += float(np.max((common - floor) / np.maximum(1e-9, most - floor), initial=0.0))
    return min(1.0, max(0.0, total / len(a)))


def text_of(chain: np.ndarray) -> str:
    return f"{MARK}:{len(chain)}:{chain.tobytes().hex()}"


def chain_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.split(":")[2]), np.uint8).reshape(-1, BITS // 8)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """The ranks of entropies over all windows of all texts: a pass that sends at most 1,001 sums a batch, and as many rows to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            total += histogram([_bytes(t) for t in batch["text"]])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"entropy": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(STEPS + 1, np.int64)
    for r in rows:
        counts[r["entropy"]] = r["n"]
    return ranks(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint: a row for each row of docs. Null and empty texts: an empty chain. Equal texts: equal fingerprints.

    rank: entropy_ranks() of a corpus; fingerprints compare only under the same ranks. By default those of docs.
    """
    rank = entropy_ranks(docs) if rank is None else rank

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [text_of(c) for c in filters([_bytes(t) for t in batch["text"]], rank)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(make, "doc_id long, fingerprint string")


def following(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt out by ranges of ids, a range a task, in descending order within __range; each range ends with the row that
    comes after its last (__tail = 1), so that a task finds every row's next one in its own stream. After the last comes the first.

    Null ids come last; rows with one id in order of a hash of their texts. The driver sees one row a range.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = slices(docs)
    bounds = np.unique(np.array(base.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n), np.float64)) if n > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype(np.float64), "right"))).astype("int32")

    tx = F.xxhash64("text")
    ids = base.select("doc_id", tx.alias("__tx")).withColumn("__range", range_of("doc_id"))
    # the first row of each range in descending order: the largest id, and of its rows the first by hash
    firsts = ids.groupBy("__range").agg(F.min(F.struct((-F.col("doc_id")).alias("d"), F.col("__tx").alias("t"))).alias("a"), F.count("doc_id").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct((-F.col("doc_id")).alias("d"), F.col("__tx").alias("t")))).alias("b")).collect()
    heads = {r["__range"]: ((-r["b"]["d"], r["b"]["t"]) if r["b"] is not None else (None, r["a"]["t"])) for r in firsts}
    order = sorted(heads, reverse=True)
    sent = [(*heads[to], frm) for frm, to in zip(order, [*order[1:], *order[:1]], strict=True)]
    own = base.withColumn("__tx", tx)
    at = own.sparkSession.createDataFrame(sent, "__id long, __t long, __range int")
    tails = own.join(F.broadcast(at), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tx") == F.col("__t"))).select("doc_id", "text", "__tx", "__range", F.lit(1).alias("__tail"))
    every = own.withColumn("__range", range_of("doc_id")).withColumn("__tail", F.lit(0)).unionByName(tails)
    return every.repartitionById(n, F.col("__range")).sortWithinPartitions("__range", "__tail", F.col("doc_id").desc_nulls_last(), "__tx")


def edited(text: str, other: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def compare_with_edited(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document (see following())."""
    rank = entropy_ranks(docs) if rank is None else rank

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        """part: rows in order, of which the last only follows."""
        texts = part["text"].fillna("").tolist()
        ranges = part["__range"].to_numpy()
        chains = filters([_bytes(t) for t in texts], rank)
        out = [i for i in range(len(texts) - 1) if part["__tail"].iat[i] == 0 and ranges[i] == ranges[i + 1]]
        changed = [_bytes(edited(texts[i], texts[i + 1])) for i in out]
        others = filters(changed, rank)
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"].iloc[out].astype("Int64").array,
                "n_chars": [len(texts[i]) for i in out],
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
                "fingerprint": [text_of(chains[i]) for i in out],
                "edited_fingerprint": [text_of(x) for x in others],
                "near_edited": [likeness(chains[i], x) for i, x in zip(out, others, strict=True)],
                "near_next": [likeness(chains[i], chains[i + 1]) for i in out],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                part = part if held is None else pd.concat([held, part])
                held = part.iloc[-1:]
                yield rows(part)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return following(docs).select("doc_id", "text", "__range", "__tail").mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(read(spark, sf_dir, "documents"))
