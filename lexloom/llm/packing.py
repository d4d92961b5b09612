"""Harmonic packing of token sequences.

Lengths fall into classes by reciprocal capacity: class k holds lengths in (capacity / (k + 1), capacity / k], and each of its bins takes
exactly k pieces. Classes need no knowledge of one another and a worker none of the others, so each worker fills its own bins with
one counter a class. Documents are cut first: into whole sequences, and their rest into powers of two, which are the lengths at the upper ends
of their classes, so that full bins have no padding; a worker's last bins hold a power of two of pieces and need none either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rounds, slices

PIECE = "doc_id long, tx long, start long, length long, ids_crc32 long, doc_tokens long"


Encoder = Callable[[list[str]], list[list[int]]]


def _whole(text: str) -> str:
    """The text with lone surrogates, which have no UTF-8, as U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def tokenizer_file(path: str, end_id: int | None = 0) -> Callable[[], Encoder]:
    """Ids of each text by a file of the tokenizers library, without special tokens, then end_id."""

    def make() -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        tail = [] if end_id is None else [end_id]
        return lambda texts: [x.ids + tail for x in coder.encode_batch_fast(list(map(_whole, texts)), add_special_tokens=False)]

    return make


def byte_bpe(ranks: str, pattern: str, special: str = "<|endoftext|>", special_id: int = 50256, end_id: int | None = 0) -> Callable[[], Encoder]:
    """Ids of a byte-level BPE by its ranks, then end_id. The special token's own string in a text is its id, as the tokenizers library has it."""

    def make() -> Encoder:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=known, special_tokens={special: special_id})
        tail = [] if end_id is None else [end_id]
        return lambda texts: [coder.encode(_whole(t), allowed_special="all") + tail for t in texts]

    return make


def public_byte_bpe(end_id: int | None = 0) -> Callable[[], Encoder]:
    """The ids of byte_bpe_50k.json, from the same vocabulary as ranks: in a quarter of the tokenizers library's time (README); tests hold both equal."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=end_id)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then powers of two from the largest."""
    out = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at = n - n % capacity
    left = n - at
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((at, size))
        at, left = at + size, left - size
    return out


def pieces(docs: DataFrame, tokenizer: Callable[[], Encoder], capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, tx, start, length, ids_crc32, doc_tokens, and ids where asked for.

    A null text is an empty one. capacity is a power of two. A document is tokenized whole, however long.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = PIECE + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer()
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "tx", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            doc_ids, txs = batch["doc_id"].tolist(), batch["tx"].tolist()
            for a, b in rounds(texts):
                for doc_id, tx, ids in zip(doc_ids[a:b], txs[a:b], encode(texts[a:b]), strict=True):
                    raw = np.asarray(ids, "<u4").tobytes()
                    n = len(raw) // 4
                    for start, length in cuts(n, capacity):
                        own = raw[4 * start : 4 * (start + length)]
                        for c, v in zip(rows, (doc_id, tx, start, length, zlib.crc32(own), n, own if with_ids else None), strict=True):
                            rows[c].append(v)
            frame = pd.DataFrame({c: v for c, v in rows.items() if c != "ids" or with_ids})
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tx"), F.col("text").cast("string").alias("text")).mapInPandas(cut, schema)


def pack(cut: DataFrame, capacity: int = 1024, workers: int | None = None) -> DataFrame:
    """Places pieces (any frame with doc_id, tx, start and length) in sequences: adds sequence_id and offset.

    Pieces go to a worker by a hash of their document, and a worker takes them in order of id and start, so a task that runs again
    gives the same sequences. A worker keeps a counter a class: bounded memory, no sort beyond Spark's own, which spills. Class k's bins
    take k pieces. The number that a worker has left over in a class is made up of bins of 2^a, 2^b... pieces, as in its binary
    form. sequence_id: worker, class and bin in one long.

    An empty table gives an empty result. Lengths are 1 to capacity; powers of two waste nothing, any others
    less than a class's width a piece.
    """
    names = cut.columns
    workers = workers or slices(cut)
    from pyspark.sql import types as T

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = cut.withColumn("__worker", F.pmod(F.xxhash64("doc_id", "tx"), F.lit(workers))).repartition(workers, "__worker").sortWithinPartitions("__worker", "doc_id", "tx", "start")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], pd.DataFrame] = {}  # less than a bin's pieces of each class

        def close(worker: int, k: int, rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            nonlocal made
            size = len(rows) if last else len(rows) // k * k
            at = 0
            while at < size:
                n = size // k * k if not at and size >= k else 1 << ((size - at).bit_length() - 1)
                part = rows.iloc[at : at + n]
                each = min(k, n)
                lengths = part["length"].to_numpy().reshape(-1, each)
                bins = made.get((worker, k), 0) + np.repeat(np.arange(len(lengths)), each)
                made[worker, k] = made.get((worker, k), 0) + len(lengths)
                yield part[names].assign(sequence_id=((np.int64(worker) * (capacity + 1) + k) << 32) + bins, offset=(lengths.cumsum(axis=1) - lengths).ravel())
                at += n

        made: dict[tuple[int, int], int] = {}
        for batch in batches:
            batch = batch.assign(__class=capacity // batch["length"])
            for (worker, k), rows in batch.groupby(["__worker", "__class"], sort=True):
                rows = pd.concat([held.pop((worker, k)), rows]) if (worker, k) in held else rows
                yield from close(worker, k, rows, False)
                if len(rows) % k:
                    held[worker, k] = rows.iloc[len(rows) // k * k :]
        for (worker, k), rows in sorted(held.items()):
            yield from close(worker, k, rows, True)

    return dealt.mapInPandas(fill, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, with_ids: bool = True, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text, others ignored) as packed sequences: a row a piece, with its ids (unsigned little-endian 32-bit)."""
    return pack(pieces(docs, public_byte_bpe(end_id), capacity, with_ids), capacity).drop("tx")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = pack_documents(read(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
