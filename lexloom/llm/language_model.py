"""Language-model scores by deleted interpolation.

P(w | context) = l * c(context w) / c(context) + (1 - l) * P(w | shorter context), down to P(w) = l * c(w) / N + (1 - l) / (V + 1).
The weight l of a context depends on its frequency, by powers of two. It is learned by expectation-maximisation on held-out counts: each training token in
turn is deleted from the counts that predict it.

Counts are of all training tokens and exact up to 64-bit hashes of n-grams. Texts become chunks, a row each: the chunk's vocabulary and its
texts as places in it. For each order, a chunk sends each of its distinct n-grams once, with its own count, to the n-gram's
bucket, and gets back the corpus's count. So a frequent n-gram costs a row a chunk, never a row an occurrence, and nothing that grows comes to
the driver: it sees histograms.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _remove, mixed, read, rounds, shared_folder, slices, trim

_ODD, _END, _START = np.uint64(0xD1342543DE82EF95), np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)
#: Frequencies of contexts by powers of two; steps of an octave in which ratios of estimates are told apart, and their middle.
CONTEXTS, FINE, MIDDLE = 48, 16, 60
BINS = 2 * MIDDLE * FINE + 1


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<u8"), dtype=np.uint64)


def training(doc_id, folds: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds != 0


class Chunk:
    """A chunk's tokens as arrays: key of each token's n-gram of each order, and the corpus's counts as they come in."""

    def __init__(self, row):
        self.first = _unpack(row.first, "<i8")
        self.ids, self.flags = _unpack(row.ids, "<i8"), _unpack(row.held, "u1")  # flags: 1 held out, 2 without an id
        self.held = self.flags % 2 == 1
        self.vocabulary, self.places = _unpack_sorted(row.vocabulary), _unpack(row.places, "<u4")
        self.keys, self.opening = self.vocabulary[self.places], self.first[:-1]
        self.train = np.repeat(~self.held, np.diff(self.first))
        self.order = 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams to send, how often the chunk's training texts have them, and its held-out ones.

        An n-gram is sent if its count is not settled by those of its two shorter parts: of training texts, if both are there twice or
        both are in held-out texts too, which will ask for it; of held-out texts, if both are in training texts. All chunks
        decide alike, since they go by the corpus's counts.
        """
        if self.order == 1:
            self.asked = np.ones(len(self.keys), bool)
            keys, self.inverse = self.vocabulary, self.places
        else:
            known = np.minimum(self.totals[-1], self.context[-1])
            self.asked = np.where(self.train, (known >= 2) | self.elsewhere, known >= 1)
            keys, self.inverse = np.unique(self.keys[self.asked], return_inverse=True)
        train = self.train[self.asked]
        return keys, np.bincount(self.inverse[train], minlength=len(keys)), np.bincount(self.inverse[~train], minlength=len(keys))

    def answer(self, counts: np.ndarray, train_docs: int) -> None:
        """Takes the answers to what distinct() sent (twice the corpus's count, and 1 more if held-out texts have it), and goes on to the next order."""
        self.distinct()
        total, held = self.train.astype(np.int64), ~self.train
        total[self.asked] = counts[self.inverse] >> 1
        held[self.asked] = counts[self.inverse] & 1
        if self.order == 1:
            self.totals, self.context, self.words = [], [], self.keys
        self.totals.append(total)
        before, held_before = np.concatenate([[0], total[:-1]]), np.concatenate([[True], held[:-1]])
        before[self.opening], held_before[self.opening] = train_docs, True
        self.context.append(before)  # of the next order
        self.elsewhere = held & held_before
        previous = np.concatenate([np.zeros(1, np.uint64), self.keys[:-1]])
        previous[self.opening] = _START
        self.keys = mixed(previous * _ODD + self.words)
        self.inverse = self.asked = None  # as large as the chunk, and of no more use
        self.order += 1

    def probability(self, model: Model, order: int, deleted: int) -> np.ndarray:
        """Of each token under the orders up to `order`; deleted: 1 takes the token itself out of all counts."""
        p = model.weight(0, 0) * np.maximum(0, self.totals[0] - deleted) / max(1, model.tokens - deleted) + (1 - model.weight(0, 0)) / (model.words + 1)
        for n in range(2, order + 1):
            ml, context = self.estimate(n, deleted)
            weight = model.table[n - 1][_octave(context)]
            p = weight * ml + (1 - weight) * p
        return p

    def estimate(self, order: int, deleted: int) -> tuple[np.ndarray, np.ndarray]:
        context = np.maximum(0, self.context[order - 2] - deleted)
        return np.where(context > 0, np.maximum(0, self.totals[order - 1] - deleted) / np.maximum(1, context), 0.0), context


def _octave(counts: np.ndarray) -> np.ndarray:
    """0: none; k: 2^(k-1) and above, below 2^k."""
    return np.minimum(CONTEXTS - 1, np.frexp(counts.astype(np.float64))[1])


class Model:
    """tokens, words: of the training texts; table: by order and octave of the context the weight of the longest estimate."""

    def __init__(self, tokens: int, words: int, docs: int, table: list[np.ndarray]):
        self.tokens, self.words, self.docs, self.table = tokens, words, docs, table

    def weight(self, order: int, octave: int) -> float:
        return float(self.table[order][octave])


def learned(histogram: np.ndarray, ratios: np.ndarray, steps: int = 300) -> np.ndarray:
    """Expectation-maximisation of a weight a row: histogram counts deleted tokens by the ratio of the longest estimate to the rest."""
    total = histogram.sum(axis=1)
    weight = np.where(total > 0, 0.5, 0.0)
    for _ in range(steps):
        part = weight[:, None] * ratios
        weight = np.divide((histogram * (part / np.maximum(1e-300, part + 1 - weight[:, None]))).sum(axis=1), total, out=np.zeros(len(total)), where=total > 0)
    return np.minimum(weight, 1 - 1e-6)


def _ratio_bins(ratio: np.ndarray) -> np.ndarray:
    """0: no ratio; else its logarithm in steps."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.round(np.log2(ratio) * FINE) + MIDDLE * FINE, 1, BINS - 1), 0).astype(np.int64)


_RATIOS = np.concatenate([[0.0], 2.0 ** ((np.arange(1, BINS) - MIDDLE * FINE) / FINE)])

_CHUNK = "chunk long, ids binary, held binary, first binary, vocabulary binary, places binary, train_docs long, tokens long"


def chunks(docs: DataFrame, folds: int, tokens: int = 1_000_000) -> tuple[DataFrame, int]:
    """Texts as chunks of about `tokens` tokens, in a table bucketed by chunk, so that answers can join it without moving it."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        null: list[bool] = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            nonlocal made
            every = np.concatenate(hashes)
            vocabulary, places = np.unique(every, return_inverse=True)
            held = np.array([False if n else not training(i, folds) for i, n in zip(ids, null, strict=True)])
            row = {"chunk": (part << 24) + made, "ids": _pack(np.array(ids, "<i8")), "held": _pack(held.astype("u1") + 2 * np.array(null, "u1")), "first": _pack(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")), "vocabulary": _pack_sorted(vocabulary), "places": _pack(places.astype("<u4")), "train_docs": int((~held).sum()), "tokens": len(every)}
            made += 1
            for x in (ids, null, counts, hashes):
                x.clear()
            return pd.DataFrame([row])

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            own = batch["doc_id"].astype("Int64")
            empty = own.isna().tolist()
            own = own.fillna(0).tolist()
            for a, b in rounds(texts):
                words = Words(texts[a:b], lower=True)
                counts.append(words.count + 1)
                hashes.append(np.insert(words.hashes, words.first[1:], _END))
                ids += own[a:b]
                null += empty[a:b]
                if sum(map(len, hashes)) >= tokens:
                    yield flush()
        if ids:
            yield flush()

    n = max(slices(docs), min(1 << 16, _bytes_of(docs) >> 26))
    return _by_chunk(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(build, _CHUNK), n), n


def _bytes_of(docs: DataFrame) -> int:
    """What Spark reckons the table's size to be: of files, their length; 0 where it does not know and says the largest number."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def _dropped(spark, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session has ended, and its catalog with it
        pass
    _remove(spark, path)


def _by_chunk(rows: DataFrame, parts: int) -> DataFrame:
    """Writes rows as a table bucketed by chunk: tables so written join on it without a shuffle. The table is dropped when the driver's process ends."""
    spark, name = rows.sparkSession, f"lexloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows.write.bucketBy(parts, "chunk").option("path", path).saveAsTable(name)
    atexit.register(_dropped, spark, name, path)
    return spark.table(name)


def _loaded(batches: Iterator[pd.DataFrame], orders: int, train_docs: int) -> Iterator[Chunk]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            chunk = Chunk(row)
            for n in range(1, orders + 1):
                chunk.answer(np.concatenate([_unpack(x["counts"], "<i8") for x in getattr(row, f"a{n}")] or [np.zeros(0, np.int64)]), train_docs)
            yield chunk
            del chunk  # before the next one is unpacked
            trim()


#: About how many n-grams, of all chunks together, a bucket holds.
BUCKET = 1 << 21


def _asked(table: DataFrame, answers: list[DataFrame], parts: int, train_docs: int, tokens: int) -> DataFrame:
    """Each chunk's questions of the next order by bucket, answered: chunk, bucket, counts; and for order 1 rows of statistics.

    There are as many buckets as keep each at about BUCKET n-grams whatever the corpus, and a task holds one bucket at a time.
    """
    bits = max(0, (parts - 1).bit_length(), (tokens // BUCKET).bit_length())
    orders = len(answers)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch["chunk"].tolist()
            for name, chunk in zip(names, _loaded(iter([batch]), orders, train_docs), strict=True):
                keys, train, held = chunk.distinct()
                edge = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)] if bits else [0, len(keys)]
                rows = [(name, b, _pack_sorted(keys[at:to]), _pack(np.concatenate([train[at:to], held[at:to]]).astype("<i8"))) for b, (at, to) in enumerate(zip(edge, edge[1:], strict=False)) if to > at]
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "counts"])

    asked = _joined(table, answers).mapInPandas(ask, "chunk long, bucket int, keys binary, counts binary")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def close() -> pd.DataFrame:
            keys = [_unpack_sorted(k) for _, k, _ in held]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sent = [_unpack(c, "<i8").reshape(2, -1) for _, _, c in held]
            total = np.bincount(inverse, np.concatenate([x[0] for x in sent]), len(found)).astype(np.int64)
            others = np.bincount(inverse, np.concatenate([x[1] for x in sent]), len(found)) > 0
            edges, both = np.cumsum([0, *map(len, keys)]), total * 2 + others
            rows = [(name, bucket, _pack(both[inverse[at:to]]), None, None, None) for (name, _, _), at, to in zip(held, edges, edges[1:], strict=False)]
            if not orders:
                total = total[total > 0]
                bins = np.floor(np.log2(total) * FINE).astype(np.int64)
                at, first, n = np.unique(bins, return_index=True, return_counts=True)
                rows.append((-1, bucket, None, at.tolist(), n.tolist(), np.bincount(bins, weights=total)[at].astype(np.int64).tolist()))
            held.clear()
            trim()
            return pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "bins", "words", "tokens"])

        bucket = None
        for batch in batches:
            for name, b, k, c in zip(batch["chunk"].tolist(), batch["bucket"].tolist(), batch["keys"], batch["counts"], strict=True):
                if held and b != bucket:
                    yield close()
                bucket = b
                held.append((name, k, c))
        if held:
            yield close()

    dealt = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    out = dealt.mapInPandas(count, "chunk long, bucket int, counts binary, bins array<long>, words array<long>, tokens array<long>")
    per = out.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("answers"), F.flatten(F.collect_list(F.arrays_zip("bins", "words", "tokens"))).alias("seen"))
    return _by_chunk(per, parts)


def _joined(table: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The chunks with their answers of each order; both sides are bucketed, so nothing moves."""
    out = table
    for n, a in enumerate(answers, 1):
        own = a.where("chunk >= 0").select(F.col("chunk").alias(f"c{n}"), F.col("answers").alias(f"a{n}"))
        out = out.join(own.hint("merge"), F.col("chunk") == F.col(f"c{n}"), "left").drop(f"c{n}").withColumn(f"a{n}", F.coalesce(f"a{n}", F.expr("cast(array() as array<struct<bucket:int,counts:binary>>)")))
    return out


def fit_and_score(docs: DataFrame, order: int = 3, folds: int = 10) -> DataFrame:
    """docs (doc_id, text; others ignored) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row a row.

    Learns from rows whose crc32(doc_id as text) mod folds is not 0. Lower-cases A-Z; tokens are words, then one end. A null
    text is an empty one: only its end is scored. Rows of null id are training rows. Rows that repeat count as often as they come. score is the
    log10 probability of the whole text under the model, base_score under unigrams with 0.1 added to each count.
    """
    table, parts = chunks(docs, folds)
    train_docs, every = (int(x or 0) for x in table.agg(F.sum("train_docs"), F.sum("tokens")).first())
    answers = [_asked(table, [], parts, train_docs, every)]
    zipped = answers[0].where("chunk < 0").select(F.explode("seen").alias("s"))
    seen = zipped.groupBy("s.bins").agg(F.sum("s.words").alias("words"), F.sum("s.tokens").alias("tokens")).collect()
    tokens, words = sum(r["tokens"] for r in seen), sum(r["words"] for r in seen)
    ratios = np.array([[max(0.0, r["tokens"] / r["words"] - 1) / max(1, tokens - 1) * (words + 1) for r in seen] or [0.0]])
    first = learned(np.array([[float(r["tokens"]) for r in seen] or [0.0]]), ratios)
    model = Model(tokens, words, train_docs, [first])
    for n in range(2, order + 1):
        answers.append(_asked(table, answers, parts, train_docs, every))

        def histogram(batches: Iterator[pd.DataFrame], n: int = n, model: Model = model) -> Iterator[pd.DataFrame]:
            total = np.zeros(CONTEXTS * BINS, np.int64)
            for chunk in _loaded(batches, n, train_docs):
                rest = chunk.probability(model, n - 1, 1)[chunk.train]
                ml, context = chunk.estimate(n, 1)
                ml, context = ml[chunk.train], context[chunk.train]
                total += np.bincount(_octave(context) * BINS + _ratio_bins(ml / rest), minlength=CONTEXTS * BINS)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "n": total[at]})

        counted = np.zeros(CONTEXTS * BINS)
        for r in _joined(table, answers).mapInPandas(histogram, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counted[r["at"]] = r["n"]
        weight = learned(counted.reshape(CONTEXTS, BINS), _RATIOS[None, :])
        weight[0] = 0.0
        for k in range(2, CONTEXTS):  # frequencies without a training token: as the next lower ones
            if not counted.reshape(CONTEXTS, BINS)[k].sum():
                weight[k] = weight[k - 1]
        model = Model(tokens, words, train_docs, [*model.table, weight])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _loaded(batches, order, train_docs):
            sums = lambda x: np.add.reduceat(x, chunk.opening)  # noqa: E731, B023
            c = chunk.totals[0]
            yield pd.DataFrame(
                {
                    "doc_id": pd.arrays.IntegerArray(chunk.ids.copy(), chunk.flags >= 2),
                    "held_out": chunk.held,
                    "n_tokens": np.diff(chunk.first),
                    "n_known": sums((c > 0).astype(np.int64)),
                    "train_tokens": np.int64(tokens),
                    "base_score": sums(np.log10((c + 0.1) / (tokens + 0.1 * (words + 1)))),
                    "score": sums(np.log10(chunk.probability(model, order, 0))),
                }
            )

    return _joined(table, answers).mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(read(spark, sf_dir, "documents"))
