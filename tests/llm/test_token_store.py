import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from packetmill.llm import token_store
from packetmill.llm.common import with_key

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 50_000))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys))) and h.size == len(keys)
    assert token_store.PerfectHash.build(np.array([], np.int64)).slots(np.array([5])).tolist() == [-1]


def test_store_gives_back_every_document(spark, frame, odd, tmp_path):
    texts = ["a  b", " lead", "x\n y", "don't 12 34!", "<|endoftext|> a <|endoftext|>b", "end  ", "été  du  nord"]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    docs = frame(rows)
    got = token_store.stored_documents(docs, PATH, str(tmp_path / "store"), shard_bytes=40_000).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    got.sort(key=lambda r: r["__key"])
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, text) in zip(got, want):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert r.start == at and r.n_tokens == len(ids)
        assert token_store.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    shards = token_store.read_manifest(spark, str(tmp_path / "store"))
    assert shards.count() > 1 and shards.agg({"n_docs": "sum"}).first()[0] == len(rows)


def test_unknown_keys_are_told(spark, tmp_path):
    docs = spark.range(0, 3000, 3).selectExpr("id doc_id", "concat('text ', id) text")
    token_store.write_store(with_key(docs), PATH, str(tmp_path / "s"), shard_bytes=2000)
    asked = spark.range(-5, 3100).withColumnRenamed("id", "__key")
    found = {r["__key"] for r in token_store.look_up(asked, str(tmp_path / "s")).filter("found").collect()}
    assert found == set(range(0, 3000, 3))


def test_empty_table(frame, tmp_path):
    assert token_store.stored_documents(frame([(1, "x")]).limit(0), PATH, str(tmp_path / "s")).count() == 0
