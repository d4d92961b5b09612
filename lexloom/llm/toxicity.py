"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of every example is a term; none is chosen or left out. A term's weight in a text is (1 + log of its count) times its IDF times the
square root of what it tells of the label (mutual information, over all labelled rows), so that cosines are about the words that labels go with and not
about rare words that two texts share by chance. Examples are put in order by splitting them along their main directions and cut into blocks; each term keeps its
largest weight in each block. A query adds up those maxima, visits blocks from the largest bound down, and stops when the bound falls below the
k-th best cosine found, so the k nearest are exact. Their votes, weighted by squared cosine and by what each example stands for among
all labelled rows, give a score, which leave-one-out scores of the examples calibrate (isotonic regression).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, read, slices, trim, window_hashes, written

_LETTERS = re.compile(r"[^\W\d_]+")
#: No term's information is below this, so each has a weight.
LEAST_INFORMATION = 1e-12
#: The index that this process has built last, by its key: a Python worker serves many tasks.
_BUILT: dict[str, dict] = {}


def counted(text: str | None) -> Counter:
    """How often each word (a run of letters, in lower case) is in the text."""
    return Counter(_LETTERS.findall((text or "").lower()))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """64 bits of each run of `width` words, each once; a shorter text is one run."""
    words = _LETTERS.findall((text or "").lower())
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return np.unique(window_hashes(mixed(own + np.uint64(1)), min(width, len(words)))) if words else own


def families(own: np.ndarray, bands: int = 10, rows: int = 3) -> list[int]:
    """Bands of MinHash values of a text's shingles: near copies (0.8) share one with probability 0.999. None without shingles."""
    if not len(own):
        return []
    least = np.array([mixed(own + np.uint64((k + 1) << 40)).min() for k in range(bands * rows)], np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * np.uint64(0xD1342543DE82EF95) + least[:, r])
    return key.view(np.int64).tolist()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out), dtype=out.dtype)
    return out


class Index:
    """Labelled examples as unit vectors of their words (one a line), in blocks. Example i has the terms place[first[i]:first[i + 1]], times[...] each."""

    def __init__(self, words: str, weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray, first: np.ndarray, place: np.ndarray, times: np.ndarray, empty_rate: float, k: int = 15, block: int = 256):
        self.words, self.weight, self.ids, self.toxic, self.stands_for = words, weight, ids, toxic, stands_for
        self.first, self.place, self.times, self.empty_rate, self.k, self.block = first, place.astype(np.int32), times.astype(np.int32), empty_rate, k, block
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        self.key = uuid.uuid4().hex

    def _index(self) -> dict:
        if self.key not in _BUILT:
            _BUILT.clear()
            words = self.words.split("\n") if self.words else []
            row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
            value = (1 + np.log(self.times)) * self.weight[self.place]
            norm = np.sqrt(np.bincount(row, value**2, len(self.ids)))
            order = np.argsort(self.place, kind="stable")
            row, value, term = row[order].astype(np.int32), (value / norm[row])[order], self.place[order]
            new = np.ones(len(row), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] // self.block != row[:-1] // self.block)
            entry = np.flatnonzero(new)  # a term's postings in a block
            most = np.maximum.reduceat(value, entry) if len(entry) else np.zeros(0)
            _BUILT[self.key] = {
                "place": {w: i for i, w in enumerate(words)}, "row": row, "value": value, "entry": np.append(entry, len(row)), "block": row[entry] // self.block, "most": most,
                "of_term": np.searchsorted(term[entry], np.arange(len(words) + 1)), "known": {},
            }
        return _BUILT[self.key]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places and the weights, as a unit vector, of the text's words that any example has."""
        place, words = self._index()["place"], counted(text)
        at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        times = np.fromiter(words.values(), np.float64, len(words))
        order = np.argsort(at)[int((at < 0).sum()) :]
        return self._unit(at[order], times[order])

    def of_example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[i], self.first[i + 1])
        order = np.argsort(self.place[own])
        return self._unit(self.place[own][order].astype(np.int64), self.times[own][order].astype(np.float64))

    def _unit(self, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(times)) * self.weight[at]
        return at, weight / np.linalg.norm(weight) if len(at) else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int | None = None, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosines above 0, and those; of equal ones (to 12 places), those first in the index. The example `without` is left out."""
        built, k = self._index(), k or self.k
        begin = built["of_term"][at]
        size = built["of_term"][at + 1] - begin
        entries, own = _ranges(begin, size), np.repeat(weight, size)
        block = built["block"][entries]
        bound = np.bincount(block, own * built["most"][entries], -(-len(self.ids) // self.block))
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        order, to, step = np.argsort(-bound, kind="stable"), 0, 8
        while to < len(order):
            part, to, step = order[to : to + step], to + step, 4 * step
            part = part[(bound[part] > 0) & ((len(best_s) < k) | (bound[part] >= (best_s[-1] if len(best_s) else 0) - 1e-11))]
            if not len(part):
                break
            visit = np.zeros(len(bound), bool)
            visit[part] = True
            some = visit[block]
            at_entry = built["entry"][entries[some]]
            many = built["entry"][entries[some] + 1] - at_entry
            postings = _ranges(at_entry, many)
            score = np.bincount(built["row"][postings], built["value"][postings] * np.repeat(own[some], many), len(self.ids))
            rows = np.flatnonzero(score > 0)
            rows = rows[rows != without]
            if len(rows) > 4 * k:  # most can't be among the k
                rows = rows[score[rows] >= np.partition(score[rows], -k)[-k] - 1e-11]
            best_i, best_s = np.concatenate([best_i, rows]), np.concatenate([best_s, score[rows]])
            first = np.lexsort((best_i, -np.round(best_s, 12)))[:k]
            best_i, best_s = best_i[first], best_s[first]
        return best_i, best_s

    def vote(self, i: np.ndarray, cosine: np.ndarray) -> float:
        if not len(i):
            return self.empty_rate
        w = cosine**2 * self.stands_for[i]
        return float((w @ self.toxic[i] + self.empty_rate) / (w.sum() + 1))

    def calibrated(self, raw: float) -> float:
        if self.knots is None:
            return raw
        return 0.98 * float(np.interp(raw, *self.knots)) + 0.02 * raw

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """The score, and the ids and cosines of the examples that gave it; of texts without any known word the rate of such examples."""
        known, key = self._index()["known"], hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in known:
            if len(known) > 10_000:
                known.clear()
            i, cosine = self.nearest(*self.vector(text))
            known[key] = (min(1.0, max(0.0, self.calibrated(self.vote(i, cosine)))), self.ids[i].tolist(), np.round(cosine, 6).tolist())
        return known[key]


def arranged(first: np.ndarray, place: np.ndarray, value: np.ndarray, terms: int, block: int = 256) -> np.ndarray:
    """An order of the examples in which those near each other are mostly in one block: parts are halved along their main direction."""
    done: list[np.ndarray] = []
    waiting = [np.arange(len(first) - 1)]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        size = np.diff(first)[rows]
        own = _ranges(first[:-1][rows], size)
        row, at, x = np.repeat(np.arange(len(rows)), size), place[own], value[own]
        way = np.sin(np.arange(len(rows)) + 1.0)  # any start serves
        for _ in range(6):
            way -= way.mean()
            way = np.bincount(row, x * np.bincount(at, x * way[row], terms)[at], len(rows))
            way /= np.linalg.norm(way) or 1.0
        order = rows[np.argsort(way, kind="stable")]
        half = -(-len(rows) // (2 * block)) * block
        waiting += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing steps nearest to y by weighted squares (pool adjacent violators), as knots of a line."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value, weight, first x, last x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][3] == a:
            p = pools[-1]
            p[0], p[1] = (p[0] * p[1] + b * c) / (p[1] + c), p[1] + c
        else:
            pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, u, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v * u) / (p[1] + u), p[1] + u, last
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] for p in pools for _ in (0, 1)])


def held_out(doc_id: str, folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def without_copies(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """rows (doc_id, toxic, text, _h, _tx) without near copies: of each label, a row whose shingles are like those of an earlier row (by _h) goes.

    A row is compared on whole sets with the first row of each of its bands, so work is in proportion to the rows; rows that only share vocabulary stay.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t) for t in batch["text"]]
            yield batch[["doc_id", "toxic", "_h", "_tx"]].assign(bands=[families(x) for x in own], own=[x.view(np.int64) for x in own])
            del batch, own
            trim()

    key = F.struct("_h", "doc_id", "_tx")
    marked = written(rows.mapInPandas(mark, "doc_id long, toxic int, _h long, _tx long, bands array<long>, own array<long>").withColumn("key", key))
    each = marked.select("key", "toxic", F.explode("bands").alias("band"))
    first = each.groupBy("toxic", "band").agg(F.min("key").alias("first"))
    pairs = each.join(first, ["toxic", "band"]).where(F.col("first") < F.col("key")).select("key", "first").distinct()
    pairs = pairs.join(marked.select("key", "own"), "key").join(marked.select(F.col("key").alias("first"), F.col("own").alias("other")), "first")
    common = F.size(F.array_intersect("own", "other"))
    copies = pairs.where(common >= least * (F.size("own") + F.size("other") - common)).select("key.doc_id", "key._tx").distinct()
    return rows.join(copies, ["doc_id", "_tx"], "left_anti")


def examples(docs: DataFrame, known: DataFrame, totals: dict[int, int], per_class: int) -> DataFrame:
    """doc_id, toxic, text: of each label the per_class rows with the smallest hashes of their ids that are no near copies, or all there are."""
    take = 2 * per_class
    while True:
        chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take) for y in (0, 1)]
        chosen = chosen[0].unionByName(chosen[1])
        picked = docs.select("doc_id", "text").join(F.broadcast(chosen) if take == 2 * per_class else chosen, "doc_id")
        rows = written(picked.withColumns({"_h": F.xxhash64("doc_id"), "_tx": F.xxhash64("text")}).dropDuplicates(["doc_id", "_tx"]).select("doc_id", "toxic", "text", "_h", "_tx"))
        rows = written(without_copies(rows))
        left = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if all(left.get(y, 0) >= per_class or totals.get(y, 0) <= take for y in (0, 1)):
            one = [rows.where(F.col("toxic") == y).orderBy("_h", "doc_id", "_tx").limit(per_class).select("doc_id", "toxic", "text") for y in (0, 1)]
            return one[0].unionByName(one[1])
        take *= 2  # copies took places


def likely(docs: DataFrame, known: DataFrame, ids: int, most: int = 1 << 26) -> DataFrame:
    """The rows of docs whose id is in known, and some others, so that few texts are shuffled by a join that follows. A bitmap of hashed ids, 8 MB at most, decides; a full one only lets more pass."""
    bits = min(most, max(1 << 15, 8 * ids))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    marks = known.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    packed = np.zeros((max((r["bucket"] for r in marks), default=1), 4096), np.uint8)  # buckets count from 1
    for r in marks:
        packed[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    packed = np.resize(np.append(packed.ravel(), np.zeros(-(-bits // 8), np.uint8)), max(packed.size, -(-bits // 8)))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return docs.where(marked(place))


def word_rows(labelled: DataFrame, joined: str) -> DataFrame:
    """place, rows, toxic: of how many labelled rows, and toxic ones, each of the words (one a line) is. Each task counts in two arrays and sends the words that it met."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(joined.split("\n"))}
        seen = np.zeros((2, len(place)), np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                met = [i for w in set(_LETTERS.findall((text or "").lower())) if (i := place.get(w)) is not None]
                seen[0, met] += 1
                if y:
                    seen[1, met] += 1
        at = np.flatnonzero(seen[0])
        for a in range(0, len(at), 1 << 16):
            own = at[a : a + (1 << 16)]
            yield pd.DataFrame({"place": own.astype(np.int32), "rows": seen[0, own], "toxic": seen[1, own]})
        del place, seen
        trim()

    return labelled.mapInPandas(count, "place int, rows long, toxic long").groupBy("place").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))


def information(rows: np.ndarray, toxic: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Mutual information, in nats, of a word's presence (in `rows` of n rows, `toxic` of `positive` toxic ones) and the label."""

    def part(cell: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
        cell, expected = cell / n, a / n * (b / n)
        return np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    clean = rows - toxic
    return part(toxic, rows, positive) + part(clean, rows, n - positive) + part(positive - toxic, n - rows, positive) + part(n - positive - clean, n - rows, n - positive)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, folds: int = 5, k: int = 15) -> Index:
    """Learns from labelled rows outside the held-out fold.

    per_class bounds the rows of each label that are examples (those with the smallest hashes of their ids, near copies among them once): the one
    bound there is. All words of the examples are terms; their document frequencies and their information on the label are counted over all labelled
    rows. No labelled row, or one label only: every score is the rate of toxic rows, 0 without any. Null labels and ids are left out; of an
    id with several labels the largest counts. Repeated rows of an id with one text are one row.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id", folds)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = written(known)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = examples(docs, known, totals, per_class)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [counted(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": ["\n".join(c) for c in own], "times": [np.fromiter(c.values(), "<i4", len(c)).tobytes() for c in own]})

    found = rows.mapInPandas(keep, "doc_id long, toxic int, words string, times binary").toArrow().to_pandas().sort_values(["doc_id", "words"], ignore_index=True)
    toxic = found["toxic"].to_numpy(np.float64)
    size = {y: int((toxic == y).sum()) for y in (0, 1)}
    share = np.array([totals.get(y, 0) / max(1, size[y]) for y in (0, 1)])[toxic.astype(int)] if len(found) else np.zeros(0)
    prior = float(share @ toxic / share.sum()) if len(found) else 0.0
    place: dict[str, int] = {}
    listed = [np.array([place.setdefault(w, len(place)) for w in x.split("\n")] if x else [], np.int32) for x in found.pop("words")]
    times = [np.frombuffer(x, "<i4") for x in found.pop("times")]
    bare = np.array([not len(x) for x in listed], bool)
    empty_rate = float((share[bare] @ toxic[bare] + prior) / (share[bare].sum() + 1))
    own = np.flatnonzero(~bare)
    first = np.concatenate([[0], np.cumsum([len(listed[i]) for i in own])]).astype(np.int64)
    places, counts = (np.concatenate([x[i] for i in own]) if len(own) else np.zeros(0, np.int32) for x in (listed, times))
    words, many = "\n".join(place), len(place)
    del listed, times, place
    trim()
    in_rows, in_toxic = np.zeros(many), np.zeros(many)
    labelled = likely(docs.select("doc_id", "text"), known, sum(totals.values())).join(known, "doc_id").select("text", "toxic")
    if many:
        labelled = written(labelled)
        n, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        met = word_rows(labelled, words).toArrow().to_pandas()
        in_rows[met["place"]], in_toxic[met["place"]] = met["rows"], met["toxic"]
    else:
        n = positive = 0
    told = np.maximum(LEAST_INFORMATION, information(in_rows, in_toxic, n, positive)) if n else in_rows
    weight = (np.log((1 + n) / (1 + in_rows)) + 1) * np.sqrt(told)
    row = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(first))
    value = (1 + np.log(counts)) * weight[places]
    value /= np.sqrt(np.bincount(row, value**2, len(own)))[row]
    del row
    order = arranged(first, places, value, many)
    del value
    size_of = np.diff(first)[order]
    taken = _ranges(first[:-1][order], size_of)
    index = Index(words, weight, found["doc_id"].to_numpy(np.int64)[own][order], toxic[own][order], share[own][order], np.concatenate([[0], np.cumsum(size_of)]).astype(np.int64), places[taken], counts[taken], empty_rate, k)
    del places, counts, taken
    trim()
    if not len(own):
        return index

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["id"].to_numpy()
            yield pd.DataFrame({"id": at, "raw": [index.vote(*index.nearest(*index.of_example(i), without=i)) for i in at.tolist()]})
        _let_go()

    spark = docs.sparkSession
    raw = spark.range(0, len(own), 1, min(slices(docs), -(-len(own) // 500))).mapInPandas(leave_one_out, "id long, raw double").toArrow().to_pandas().sort_values("id")["raw"].to_numpy()
    index.knots = isotonic(np.append(raw, empty_rate), np.append(index.toxic, empty_rate), np.append(index.stands_for, max(1e-9, share[bare].sum())))
    index.key = uuid.uuid4().hex
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), neighbours and their cosines: a row for each row of docs, from its whole text.

    Null and empty texts, and those without any word of an example, get the rate of toxic rows among examples without words. Equal texts score
    alike. No shuffle. A task builds the index from the examples' words and lets it go at its end.
    """

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [index.score(t) for t in batch["text"]]
            s = np.array([x[0] for x in found])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype(int), "neighbours": [x[1] for x in found], "cosines": [x[2] for x in found]})
        _let_go()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rate, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>")


def _let_go() -> None:
    _BUILT.clear()
    trim()


def clean(docs: DataFrame, index: Index, most: float = 0.5) -> DataFrame:
    """The rows of docs that score less than `most`, all columns as they are, whatever they are called; no shuffle."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([index.score(t)[0] < most for t in batch.column(at).to_pylist()], pa.bool_()))
        _let_go()

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "neighbours", "cosines")
