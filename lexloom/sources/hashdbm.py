"""A reader for on-disk hash-table dictionaries (a header of 128 bytes, a bucket array of offsets, chained records).

Register with spark.dataSource.register(HashDictionary) and read with spark.read.format("hashdbm").load(path): key and value, both
binary, of every live record, or with .option("key", k) of one key, found through its bucket; so is, with
.option("pushdown", "true"), a key that a filter asks for (Spark then wants spark.sql.python.filterPushdown.enabled). The file is split by buckets. .option("magic", m) holds the nine bytes that files of the caller's
writer begin with (as text, \\n for a line end); other files are refused. Without it any nine bytes pass, and the other fields of the header decide.

The path is one that the driver and every executor see as a local file (a shared mount, or a copy on each host), since records are found by seeking.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# Fixed values of the format.
MAGIC_SIZE, META, ALIGN = 9, 128, 4096
VOID, SET, REMOVE, ADD = 0xC0, 0x80, 0x40, 0x00
SEED, MULTIPLIER = 19780211, 0xC6A4A7935BD1E995
_MASK = (1 << 64) - 1


def murmur(data: bytes, seed: int = SEED) -> int:
    """F-16: MurmurHash2 of 64 bits, with a block's multiplication before its exclusive or, as the format has it."""
    h = seed ^ (len(data) * MULTIPLIER & _MASK)
    whole = len(data) // 8 * 8
    for at in range(0, whole, 8):
        k = int.from_bytes(data[at : at + 8], "little") * MULTIPLIER & _MASK
        h = (h * MULTIPLIER & _MASK) ^ ((k ^ k >> 47) * MULTIPLIER & _MASK)
    if len(data) > whole:
        h = (h ^ int.from_bytes(data[whole:], "little")) * MULTIPLIER & _MASK
    h = (h ^ h >> 47) * MULTIPLIER & _MASK
    return h ^ h >> 47


def bucket_of(key: bytes, buckets: int) -> int:
    """F-16: the bucket of a key; hashes are folded to 32 bits for tables of fewer buckets than that."""
    h = murmur(key)
    if buckets <= 0:
        return h % _MASK
    if buckets <= (1 << 32) - 1:
        low, second, third, high = (h >> at & 0xFFFF for at in (0, 16, 32, 48))
        h = (third ^ low) << 16 | (high ^ second)
    return h % buckets


def varint(data, at: int) -> tuple[int, int]:
    """A-04: a number in groups of seven bits, the highest first, and the place after it."""
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
        if not b & 0x80:
            return n, at


@dataclass
class Header:
    """A-01: what the first 128 bytes say; raises ValueError for a file that is not readable as such."""

    crc: int
    width: int
    align: int
    buckets: int
    records: int
    size: int

    @classmethod
    def of(cls, data, magic: bytes | None = None) -> Header:
        if len(data) < META:
            raise ValueError("not a hash dictionary: shorter than its header")
        if magic is not None and bytes(data[:MAGIC_SIZE]) != magic:
            raise ValueError(f"not a hash dictionary: begins with {bytes(data[:MAGIC_SIZE])!r}")
        flags, width, align = data[12], data[13], data[14]
        if not 3 <= width <= 6:
            raise ValueError(f"offsets of {width} bytes")
        if flags >> 4 & 0x7:
            raise ValueError("compressed records")
        number = lambda at: int.from_bytes(data[at : at + 8], "big")
        made = cls((0, 1, 2, 4)[flags >> 2 & 0x3], width, align, number(16), number(24), number(40))
        if made.buckets < 1 or META + made.buckets * width > len(data):
            raise ValueError(f"{made.buckets} buckets in {len(data)} bytes")
        return made

    @property
    def base(self) -> int:
        step = max(ALIGN, 1 << self.align)
        return -(-(META + self.buckets * self.width) // step) * step


class Table:
    """A file's records, by bucket or key (A-02, A-03, A-05, A-06)."""

    def __init__(self, path: str, magic: bytes | None = None):
        self.path = path
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.header = Header.of(self.data, magic)

    def _offset(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + self.header.width], "big") << self.header.align

    def chain(self, bucket: int) -> Iterator[tuple[bytes, bytes | None]]:
        """The bucket's records, the newest first; None for a removed key."""
        at = self._offset(META + bucket * self.header.width)
        while at:
            kind = self.data[at] & 0xC0
            following = self._offset(at + 1)
            key_size, p = varint(self.data, at + 1 + self.header.width)
            value_size, p = varint(self.data, p)
            _, p = varint(self.data, p)  # padding
            p += self.header.crc
            if kind != VOID:
                value = None if kind == REMOVE else self.data[p + key_size : p + key_size + value_size]
                yield self.data[p : p + key_size], value
            at = following

    def live(self, first: int, last: int) -> Iterator[tuple[bytes, bytes]]:
        for bucket in range(first, last):
            seen = set()
            for key, value in self.chain(bucket):
                if key not in seen:
                    seen.add(key)
                    if value is not None:
                        yield key, value

    def get(self, key: bytes) -> bytes | None:
        return next((v for k, v in self.chain(bucket_of(key, self.header.buckets)) if k == key), None)

    def __contains__(self, key: bytes) -> bool:
        return self.get(key) is not None


class _Buckets(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("parts", 8))
        self.key = options["key"].encode() if "key" in options else None
        self.magic = options["magic"].replace("\\n", "\n").encode() if "magic" in options else None

    def partitions(self):
        if self.key is not None:
            return [_Buckets(0, 0)]
        n = Table(self.path, self.magic).header.buckets
        parts = max(1, min(self.parts, n))
        return [_Buckets(n * i // parts, n * (i + 1) // parts) for i in range(parts)]

    def read(self, partition):
        table = Table(self.path, self.magic)
        if self.key is not None:
            value = table.get(self.key)
            if value is not None:
                yield self.key, value
            return
        yield from table.live(partition.first, partition.last)


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A-02: an equal key is found through its bucket; Spark filters by the rest, and by a second key."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None and isinstance(f.value, bytes | bytearray):
                self.key = bytes(f.value)
            else:
                yield f


class HashDictionary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hashdbm"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema):
        return (_PushReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)
