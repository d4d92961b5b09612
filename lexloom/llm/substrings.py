"""Removal of repeated passages by super-k-mer partitioning.

A window is 50 words in a row; its minimiser is the least hash of its runs of 16 words. Consecutive windows with one minimiser
make a super-k-mer. Equal windows have equal minimisers, so only a minimiser that several documents have can hold a repeat. Equal
super-k-mers, known by 128 bits of their words, count once with their smallest document. Where a minimiser has several different ones, each
travels as one packed string of its words to the minimiser's bucket, and there its windows are sorted word by word: equal ones take
the smallest document of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _powers, fresh, mixed, read, rounds, slices, window_hashes, written

#: Words of a minimiser, most windows of a super-k-mer, and strings of a minimiser that one task sorts.
RUN, MOST, BUCKET = 16, 64, 8192
_LAST = (1 << 63) - 1


def super_kmers(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """Of a batch's texts their super-k-mers: text, first word (in the text), windows, minimiser, hash of all words."""
    run = min(RUN, width)
    n = len(words.begin) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    least, span, held = window_hashes(words.hashes, run), width - run + 1, 1
    while held < span:  # the least of `held` runs in a row, doubled up to `span`
        step = min(held, span - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    doc = words.doc[:n]
    whole = doc == words.doc[width - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1:] != doc[:-1])
    place = np.arange(n)
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST == 0  # a run of one word over and over
    new &= whole
    begin = np.flatnonzero(new)
    size = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) - begin + 1
    powers, inverse = _powers(len(words.hashes) + 1)
    total = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * powers[: len(words.hashes)], out=total[1:])
    content = mixed((total[begin + size + width - 1] - total[begin]) * inverse[begin] + size.astype(np.uint64))
    return doc[begin], begin - words.first[doc[begin]], size, least[begin].view(np.int64), content.view(np.int64)


def window_mins(strings: list[str], orders: list[int], width: int) -> list[list[int]]:
    """Of each string's windows the smallest document among all equal windows, by sorting the windows' words."""
    listed = [s.split(" ") for s in strings]
    rows = sorted((w[k : k + width], d, i, k) for i, (w, d) in enumerate(zip(listed, orders, strict=True)) for k in range(len(w) - width + 1))
    out = [[0] * (len(w) - width + 1) for w in listed]
    seen, least = None, 0
    for window, d, i, k in rows:
        if window != seen:
            seen, least = window, d
        out[i][k] = least
    return out


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """tx: a hash of the text, which tells rows of one id apart; a null id counts as the largest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tx", F.xxhash64("text")).withColumn("order", F.coalesce("doc_id", F.lit(_LAST)))


def repeated(docs: DataFrame, width: int = 50, bucket: int = BUCKET) -> DataFrame:
    """order, tx and starts: the first words of the windows to remove, of each document that has any.

    A window goes if its words also start a window of a document with a smaller doc_id. Rows that share an id are one document in that respect.

    Scale: texts are read three times, and shuffled only to meet the strings and the removals of their own document. A super-k-mer of about 18 windows goes as
    40 bytes; strings go only from minimisers with different super-k-mers, one of each. A minimiser's strings over `bucket` are
    not sorted in one task: their windows are dealt out by their words, and Spark aggregates them before and after the shuffle. Both ways compare the
    words themselves and give the same rows (tests hold each against plain Python). There are two because a sort costs a string once where the other costs
    each window 50 words, while only the other can share one minimiser's strings among tasks, however many there are.
    """
    base = _keyed(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, txs, orders = batch["text"].tolist(), batch["tx"].to_numpy(), batch["order"].to_numpy()
            texts = [t if isinstance(t, str) else None for t in texts]
            for a, b in rounds(texts):
                doc, start, size, mini, content = super_kmers(Words(texts[a:b]), width)
                yield pd.DataFrame({"tx": txs[a + doc], "order": orders[a + doc], "start": start.astype(np.int32), "size": size.astype(np.int32), "mini": mini, "content": content})

    pieces = written(base.select("tx", "order", "text").mapInPandas(cut, "tx long, order long, start int, size int, mini long, content long"))
    several = pieces.groupBy("mini").agg(F.min("order").alias("lo"), F.max("order").alias("hi"), (F.min("content") == F.max("content")).alias("one")).where("lo < hi")
    shared = written(pieces.join(several.select(F.col("mini").alias("m"), "lo", "one"), F.col("mini") == F.col("m")).drop("m"))
    windows = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.col("start") + k)
    plain = shared.where("one and order > lo").select("order", "tx", windows.alias("starts"))

    mixed_up = shared.where("not one")
    strings = mixed_up.groupBy("mini", "content").agg(F.min(F.struct("order", "tx", "start", "size")).alias("rep"))
    strings = written(strings.select("mini", "content", "rep.*"))
    crowds = strings.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select(F.col("mini").alias("m"), F.lit(True).alias("crowd"))
    listed = strings.join(crowds, F.col("mini") == F.col("m"), "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    listed = listed.groupBy(F.col("order").alias("o"), F.col("tx").alias("t")).agg(F.collect_list(F.struct("start", "size", "mini", "content", "crowd")).alias("parts"))
    found = base.join(listed, (F.col("order") == F.col("o")) & (F.col("tx") == F.col("t"))).select("order", "text", "parts")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for order, text, parts in zip(batch["order"], batch["text"], batch["parts"], strict=True):
                words = _bytes(text).split()  # at the white space of WORD
                rows += [(p["mini"], p["content"], order, p["crowd"], b" ".join(words[p["start"] : p["start"] + p["size"] + width - 1]).decode("utf-8", "surrogatepass")) for p in parts]
            yield pd.DataFrame(rows, columns=["mini", "content", "order", "crowd", "packed"])

    packed = found.mapInPandas(pack, "mini long, content long, order long, crowd boolean, packed string")
    crowded = not crowds.isEmpty()
    packed = written(packed) if crowded else packed
    dealt = packed.where("not crowd").select("mini", "content", "packed", "order").repartition(slices(docs), "mini").sortWithinPartitions("mini")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            # a row of the same document and text that comes twice is one string
            own = list({c: (c, p, o) for c, p, o in held}.values())
            done.extend(zip([mini] * len(own), [c for c, _, _ in own], window_mins([p for _, p, _ in own], [o for _, _, o in own], width), strict=True))
            held.clear()

        mini = None
        for batch in batches:
            for m, c, p, o in zip(batch["mini"].tolist(), batch["content"].tolist(), batch["packed"].tolist(), batch["order"].tolist(), strict=True):
                if held and m != mini:
                    close()
                mini = m
                held.append((c, p, o))
            if done:
                yield pd.DataFrame(done, columns=["j1", "j2", "mins"])
                done.clear()
        if held:
            close()
        if done:
            yield pd.DataFrame(done, columns=["j1", "j2", "mins"])

    mins = dealt.mapInPandas(sort, "j1 long, j2 long, mins array<long>")
    if crowded:
        words = F.split("packed", " ")
        slide = F.transform(F.sequence(F.lit(1), F.size("words") - (width - 1)), lambda i: F.array_join(F.slice("words", i, width), " "))
        crowd = packed.where("crowd").withColumn("words", words).select("mini", "content", "order", F.posexplode(slide).alias("at", "window"))
        least = crowd.groupBy(F.col("window").alias("w")).agg(F.min("order").alias("least"))
        crowd = crowd.join(least, F.col("window") == F.col("w")).groupBy(F.col("mini").alias("j1"), F.col("content").alias("j2")).agg(F.sort_array(F.collect_set(F.struct("at", "least"))).alias("all"))
        mins = mins.unionByName(crowd.select("j1", "j2", F.col("all.least").alias("mins")))
    hits = mixed_up.join(mins, (F.col("mini") == F.col("j1")) & (F.col("content") == F.col("j2")))
    later = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.element_at("mins", k + 1) < F.col("order"))
    sorted_out = hits.select("order", "tx", F.transform(later, lambda k: F.col("start") + k).alias("starts")).where(F.size("starts") > 0)
    return plain.unionByName(sorted_out).groupBy("order", "tx").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _kept(text: str | None, starts: np.ndarray | None, width: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the words left, joined by a space."""
    words = _bytes(text).split()
    if starts is None:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int32)
    starts = np.unique(np.asarray(starts))
    cover[starts] += 1
    cover[starts + width] -= 1
    stays = np.cumsum(cover)[:-1] == 0
    left = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
    return len(words), len(words) - len(left), b" ".join(left)


def removed(docs: DataFrame, width: int = 50, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: a row for each row of docs (doc_id, text; others ignored).

    Null and empty texts have no words. A text under `width` words loses none. An empty table gives an empty result.
    """
    base, starts = _keyed(docs), repeated(docs, width, bucket).withColumnsRenamed({"order": "o", "tx": "t"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_kept(t, s, width) for t, s in zip(batch["text"], batch["starts"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": [x[0] for x in found], "n_removed": [x[1] for x in found], "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in found]})

    joined = base.join(starts, (F.col("order") == F.col("o")) & (F.col("tx") == F.col("t")), "left").select("doc_id", "text", "starts")
    return joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 50, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with the words of repeated windows taken out of the column `text`; texts that lose none stay as they are, white space included.

    The columns of docs, whatever they are called; `size`, if docs has it, becomes the new number of characters of texts that change.
    """
    o, t, s, new = fresh(docs, "__o", "__t", "__starts", "__new")
    starts = written(repeated(docs.select("doc_id", F.col(f"`{text}`").alias("text")), width)).select(F.col("order").alias(o), F.col("tx").alias(t), F.col("starts").alias(s))
    joined = docs.join(starts, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(o)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(t)), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _kept(t, s, width)[2].decode("utf-8", "surrogatepass") for t, s in zip(texts, starts, strict=True)])

    changed = joined.withColumn(new, cut(F.col(f"`{text}`"), F.col(s)))
    columns = [F.col(new).alias(c) if c == text else F.when(F.col(s).isNotNull(), F.length(new)).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == size else F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents"))
