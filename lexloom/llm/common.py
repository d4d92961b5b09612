"""What the operators of this folder share: words, row keys, written tables, streamed groups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read  # noqa: F401  the operators of this folder take it from here

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder; a temporary one only where the session names none and all its
    executors are threads of the driver. Several hosts share no temporary folder, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's own clean-up
        pass


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and returns a scan of it.

    Every executor sees the files, so a lost executor costs no more than the tasks it was running.
    The files live until the driver's process ends, since the caller's plan reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns beside those of df, whatever those are called."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one text, to put repeated rows in a fixed order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def slices(df: DataFrame, least: int = 1) -> int:
    """How many partitions to deal out by key: the session's number for shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cuts a stream of batches sorted by keys into one frame a key; holds one group at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        frame = batch[keys]
        new = np.ones(len(batch), bool)
        new[1:] = (frame.iloc[1:].to_numpy() != frame.iloc[:-1].to_numpy()).any(axis=1)
        if held and (held[-1][keys].iloc[-1].to_numpy() == frame.iloc[0].to_numpy()).all():
            new[0] = False
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[0] > 0:
            held.append(batch.iloc[: cuts[0]])
        for at, to in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            if held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            held = [batch.iloc[at:to]]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def trim() -> None:
    """Gives freed memory back to the system; a worker lives on for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each of x (multiply and shift, as in splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a batch of texts as arrays, without a Python object a word.

    data: the texts' UTF-8 bytes, one space after each; begin, end: byte places of each word;
    doc: the text's number of each word; first: number of each text's first word, and one more at the end;
    hashes: 64 bits of each word's bytes.
    """

    _ODD = 0x9E3779B97F4A7C15

    def __init__(self, texts: list[str | None], hashed: bool = True, lower: bool = False):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(encoded) + b" "
        self.raw = joined
        data = np.frombuffer(joined, np.uint8)
        if lower:  # A-Z only
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        ends_of_texts = np.cumsum(np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded)))
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
        self.begin = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends_of_texts)]).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(encoded)), self.count)
        if hashed:
            self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        """A polynomial in each word's bytes, by differences of prefix sums (mod 2^64), then mixed with its length."""
        n, out = len(self.begin), []
        step = 1 << 17  # words a round, to keep the work in small arrays
        for at in range(0, n, step):
            b, e = self.begin[at : at + step], self.end[at : at + step]
            low, high = int(b[0]), int(e[-1])
            powers, inverse = _powers(high - low + 1)
            run = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=run[1:])
            out.append(mixed((run[e - low] - run[b - low]) * inverse[b - low] + (e - b).astype(np.uint64) * np.uint64(self._ODD)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverses mod 2^64; the base is odd, so it has one."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        base = 0x9E3779B97F4A7C15 | 1
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def rounds(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of about `most` characters, so that a round's arrays stay small; a longer text is a run of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64 bits of each run of `width` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mixed(out)
