import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexloom.llm import packing


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, length int, start string")


def truth(text):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, out, capacity=1024):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids, pieces = truth(t), sorted(by_doc[i], key=lambda r: r.start)
        at = 0
        for p in pieces:
            own = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(own) and bytes(p.ids) == own
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and at & (at - 1) == 0  # no padding


def test_round_trip(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a<|endoftext|>b"), (-4, "x" * 30000), (-5, "é 日本語 🙂\r\n\t")]
    check(rows, packing.pack_documents(docs(spark, rows).repartition(3)).collect())


def test_both_libraries_give_the_same_ids(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a<|endoftext|>b", "é 日本語 🙂\r\n\t", "x" * 3000, "\ud800 lone", "don't  12345 'LL", "\u00a0\u3000 z", "\0"]
    assert packing.public_byte_bpe()()(texts) == packing.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))()(texts)


def test_empty_and_repeated(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0
    out = packing.pack_documents(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "z")])).collect()
    assert sum(r.length for r in out) == 2 * len(truth("a b c")) + len(truth("z"))
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_any_lengths_stay_in_their_class(spark):
    """Pieces that are not powers of two: bins never overflow, and full ones hold exactly as many as their class says."""
    lengths = [(i, i, 0, 1 + (i * 37) % 100) for i in range(500)]
    out = packing.pack(spark.createDataFrame(lengths, "doc_id long, tx long, start long, length long"), 100, 3).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append(r)
    assert len(out) == 500
    partial = 0
    for rows in bins.values():
        k = 100 // rows[0].length
        assert all(100 // r.length == k for r in rows) and sum(r.length for r in rows) <= 100 and len(rows) <= k
        partial += len(rows) < k
    assert partial <= 3 * 100
