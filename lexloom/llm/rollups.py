"""Token counts kept as additive rollups by source, language and tokenizer version.

A change is signed: an insert adds a text's count, a delete takes it away, a revision does both. A batch of changes is reduced to one row a group
and written to a folder of its own; a marker file under the batch's id, created once and never over another, names that folder. Totals are the sums of
the folders that markers name. A batch that comes again, whole or after a crash, or from two writers at once, counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, shared_folder

#: Versions that are counted by default: what a token is, as a pattern.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORD)),
    "letters-1": lambda text: F.regexp_count(text, F.lit("[A-Za-z]+")),
}
_DELTA = "source string, lang string, version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, text, source, lang and, of a revision, old_text, old_source, old_lang) as rows of sign, text, source, lang.

    op: insert, delete or revise; any other fails the job. Null texts count 0 tokens; null sources and languages are groups of their own.
    """
    new = F.struct(F.lit(1).alias("sign"), "text", "source", "lang")
    gone = F.struct(F.lit(-1).alias("sign"), "text", "source", "lang")
    old = F.struct(F.lit(-1).alias("sign"), F.col("old_text").alias("text"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"))
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(new, old)).otherwise(F.array(F.struct(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int").alias("sign"), "text", "source", "lang")))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def delta(changes: DataFrame, counters: dict[str, Callable[[Column], Column]] = COUNTERS) -> DataFrame:
    """source, lang, version, docs, tokens of a batch. Sums are combined before the shuffle, so a group of any size costs a row a task."""
    rows = signed(changes)
    counted = [F.coalesce(count(F.col("text")), F.lit(0)).cast("long").alias(f"n{i}") for i, count in enumerate(counters.values())]
    sums = rows.select("sign", "source", "lang", *counted).groupBy("source", "lang").agg(F.sum("sign").cast("long").alias("docs"), *[F.sum(F.col("sign") * F.col(f"n{i}")).alias(f"n{i}") for i in range(len(counters))])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(counters)]))
    return sums.select("source", "lang", "docs", each.alias("v")).select("source", "lang", "v.version", "docs", "v.tokens")


class Rollup:
    """A folder of committed batches, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _marker(self, batch: str) -> str:
        return f"{self.root}/committed/{batch.encode().hex()}"

    def _named(self, path: str) -> str | None:
        """The folder that a marker names; None without a marker, or with one whose writer died before its end."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            text = bytes(stream.readNBytes(1 << 10)).decode()
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def committed(self, batch: str) -> bool:
        return self._named(self._marker(batch)) is not None

    def prepare(self, changes: DataFrame, counters: dict[str, Callable[[Column], Column]] = COUNTERS) -> str:
        """Writes a batch's delta to a folder that no total reads yet, and returns its name."""
        name = uuid.uuid4().hex
        delta(changes, counters).write.parquet(f"{self.root}/deltas/{name}")
        return name

    def mark(self, batch: str, name: str) -> bool:
        """Makes a prepared delta count as the batch; False, and the delta goes, if the batch has one already.

        The file system creates the marker or refuses, in one step (as HDFS does, and object stores with conditional writes); nothing is moved. A marker
        without its last character is of a writer that died, and is replaced.
        """
        fs, at = self._fs(self._marker(batch))
        if fs.exists(at) and not self.committed(batch):
            fs.delete(at, False)
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as error:
            if not fs.exists(at):
                raise error
            delta_fs, folder = self._fs(f"{self.root}/deltas/{name}")
            delta_fs.delete(folder, True)
            return False
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        return True

    def commit(self, batch: str, changes: DataFrame, counters: dict[str, Callable[[Column], Column]] = COUNTERS) -> bool:
        """Writes the batch's delta and marks it; False if the batch was there before.

        Of two writers of one batch, at any pace, one makes the marker and the other drops its copy. A job that dies leaves a folder
        that no marker names, which no total reads.
        """
        if not batch:
            raise ValueError("a batch needs an id")
        if self.committed(batch):
            return False
        return self.mark(batch, self.prepare(changes, counters))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches; groups that came back to nothing are left out. One small file a batch is read by the driver."""
        fs, at = self._fs(f"{self.root}/committed")
        markers = [x.getPath().toString() for x in fs.listStatus(at)] if fs.exists(at) else []
        folders = [f"{self.root}/deltas/{name}" for name in map(self._named, sorted(markers)) if name]
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*folders)
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents come in; those of several lines are revised to lose their first; copies of a smaller doc_id go. Each batch comes twice."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rest = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    blank = [F.lit(None).cast("string").alias(f"old_{c}") for c in ("text", "source", "lang")]
    revised = docs.where(rest.isNotNull()).select(F.lit("revise").alias("op"), rest.alias("text"), "source", "lang", *[F.col(c).alias(f"old_{c}") for c in ("text", "source", "lang")])
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"))
    copies = docs.join(first, (F.sha2("text", 256) == F.col("h")) & (F.col("doc_id") > F.col("first"))).select(F.lit("delete").alias("op"), F.coalesce(rest, "text").alias("text"), "source", "lang", *blank)
    store = Rollup(spark, f"{shared_folder(spark)}/lexloom-rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        store.commit("load", docs.select(F.lit("insert").alias("op"), "text", "source", "lang", *blank))
        store.commit("first lines", revised)
        store.commit("copies", copies)
    return store.totals()


_W, _L = r"len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))", "len(regexp_extract_all(t, '[A-Za-z]+'))"
SQL = f"""
WITH kept AS (
  SELECT source, lang, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS t
  FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, doc_id::text || chr(0)) ORDER BY doc_id) = 1),
counted AS (
  SELECT source, lang, 'words-1' AS version, coalesce({_W}, 0) AS n FROM kept
  UNION ALL SELECT source, lang, 'letters-1', coalesce({_L}, 0) FROM kept)
SELECT source, lang, version, count(*) AS docs, cast(sum(n) AS bigint) AS tokens FROM counted GROUP BY ALL
"""
