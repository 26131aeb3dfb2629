"""Token ids of documents as raw binary shards, with a minimal perfect hash index for keyed access.

A store is a folder of shards in ascending key order and a manifest with one row per shard. A shard is a payload
(header, then the ids of its documents one after another) and an index. The index hashes a key to a
slot of its own (bit arrays over several levels, with running bit counts), and the slot holds a 32-bit
fingerprint of the key, the offset and the length: an access costs a constant number of steps, and a key that
is not in the store is told by its fingerprint.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetmill.llm.common import input_bytes, texts_of, with_key

MAGIC = b"PMIDS1\0\0"
_HEADER = "<8sQ"  # magic, bytes per id
_BEGIN = struct.calcsize(_HEADER)
# How byte-level vocabularies part a text before merging (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MANIFEST = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("first_key", pa.int64()),
                       ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    h = keys.astype(np.uint64) + np.uint64((seed + 1) * int(_ODD) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``slots`` gives each key its own number below ``size``."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.before, total = [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """Level by level: keys alone in their place stay, the others go on to the next level."""
        words, left = [], np.asarray(keys, np.int64).view(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys of a perfect hash must differ")
        while len(left):
            n = -(-int(len(left) * room) // 64) * 64 or 64
            place = _mix(left, len(words)) % np.uint64(n)
            alone = np.bincount(place.astype(np.int64), minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place.astype(np.int64)]]
        return cls(words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key. A key that was not built in gets any slot or -1."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for level, w in enumerate(self.words):
            open_ = np.flatnonzero(out < 0)
            place = _mix(keys[open_], level) % np.uint64(len(w) * 64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (w[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[level][word] + below)[hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys, np.int64).view(np.uint64), 1 << 20) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """The index file: bit arrays of the hash, then fingerprint, offset and length by slot."""
    hashed = PerfectHash.build(keys)
    slots = hashed.slots(keys)
    by_slot = np.argsort(slots)
    out = io.BytesIO()
    np.savez(out, fingerprints=_fingerprint(keys)[by_slot], offsets=np.asarray(offsets, "<u8")[by_slot],
             lengths=np.asarray(lengths, "<u8")[by_slot], **{f"level{i}": w for i, w in enumerate(hashed.words)})
    return out.getvalue()


class Shard:
    """Keyed access to one shard."""

    def __init__(self, payload: str, index: str):
        system, path = fs.FileSystem.from_uri(payload)
        self._file = system.open_input_file(path)
        magic, self.width = struct.unpack(_HEADER, self._file.read_at(_BEGIN, 0))
        if magic != MAGIC:
            raise ValueError(f"{payload} is no id payload")
        system, path = fs.FileSystem.from_uri(index)
        with system.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as parts:
            levels = [parts[f"level{i}"] for i in range(sum(n.startswith("level") for n in parts.files))]
            self._hash = PerfectHash(levels)
            self._prints, self.offsets, self.lengths = (parts[n] for n in ("fingerprints", "offsets", "lengths"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(there, offset, length)`` of each key; offsets and lengths count ids."""
        slots = self._hash.slots(keys)
        there = slots >= 0
        there[there] = self._prints[slots[there]] == _fingerprint(np.asarray(keys)[there])
        safe = np.where(there, slots, 0)
        return there, self.offsets[safe].astype(np.int64), self.lengths[safe].astype(np.int64)

    def ids(self, offset: int, length: int) -> np.ndarray:
        raw = self._file.read_at(length * self.width, _BEGIN + offset * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def close(self) -> None:
        self._file.close()


def _alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 as itself, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteEncoder:
    """Ids of a byte-level tokenizer file, the same as its own library gives.

    Where merges stand in the order of their ids, as ranks, the faster of two libraries for such vocabularies encodes; each
    encoder holds the first texts it gets against the file's own library. Other files are encoded by the latter.
    """

    CHECKED = 3

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.slow, self.left = Tokenizer.from_str(model), self.CHECKED
        self.vocabulary = self.slow.get_vocab_size(True)
        self.fast = self._ranked(json.loads(model))

    def _ranked(self, file: dict):
        split = file.get("pre_tokenizer") or {}
        added = file.get("added_tokens") or []
        plain = (file["model"]["type"] == "BPE" and file.get("normalizer") is None and split.get("type") == "ByteLevel"
                 and not split.get("add_prefix_space") and split.get("use_regex", True)
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        if not plain:
            return None
        import tiktoken

        letters, special = _alphabet(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"]]
        order = [file["model"]["vocab"][t] for t in made]
        if order != sorted(order) or len(ranks) != len(made) + 256:
            return None
        self.special = list(special)
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(t in text for t in self.special):
            ids = self.fast.encode(text, allowed_special="all")
        else:
            ids = self.fast.encode_ordinary(text)
        if self.left and text:
            self.left -= 1
            if ids != self.slow.encode(text, add_special_tokens=False).ids:
                raise ValueError("the two libraries disagree on this vocabulary")
        return ids


def write_store(rows: DataFrame, tokenizer_path: str, folder: str, text_col: str = "text", key_col: str = "__key",
                end_id: int = 2, shard_bytes: int = 32 << 20, total_bytes: int | None = None) -> DataFrame:
    """Encode and write; returns the manifest, one row per shard, as stored.

    ``rows`` has unique long keys. Rows are dealt by key ranges, so shards ascend; a task streams its rows
    into its payload and keeps only keys and lengths. File names are new for every attempt, and the manifest names
    the files of the attempt that counts: a lost or repeated task does no harm. Ids take two bytes where
    the vocabulary allows. Null and empty texts have the end id alone; an empty table has an empty manifest.
    """
    spark = rows.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    total = input_bytes(rows, text_col) if total_bytes is None else total_bytes

    def run(batches):
        encode = ByteEncoder(model.value)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        keys, lengths, tail = [], [], np.array([end_id], f"<u{width}").tobytes()
        with system.open_output_stream(f"{root}/{name}.ids") as out:
            out.write(struct.pack(_HEADER, MAGIC, width))
            for batch in batches:
                keys += batch.column(0).to_pylist()
                for text in texts_of(batch.column(1)):
                    ids = encode(text)
                    lengths.append(len(ids) + 1)
                    out.write(np.array(ids, f"<u{width}").tobytes() + tail)
        if not keys:
            system.delete_file(f"{root}/{name}.ids")
            return
        sizes = np.array(lengths, np.int64)
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(index_bytes(np.array(keys), np.cumsum(sizes) - sizes, sizes))
        yield pa.RecordBatch.from_pydict({
            "shard": [shard], "name": [name], "first_key": [keys[0]], "last_key": [keys[-1]],
            "n_docs": [len(keys)], "n_ids": [int(sizes.sum())]}, schema=_MANIFEST)

    shards = max(1, -(-total // shard_bytes))
    dealt = rows.select(key_col, text_col).repartitionByRange(shards, key_col).sortWithinPartitions(key_col)
    manifest = dealt.mapInArrow(run, "shard long, name string, first_key long, last_key long, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``start``: ids in earlier shards. One row per shard goes through the window."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    stored = spark.read.parquet(f"{folder}/manifest")
    return stored.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def look_up(keys: DataFrame, folder: str, key_col: str = "__key", beside: str | None = None) -> DataFrame:
    """``(key_col, found, start, n_tokens, ids)`` for every asked key, read from the store.

    ``ids`` are packed little-endian unsigned 32-bit. ``start`` counts all ids before the document. ``beside`` names a
    long column of ``keys`` that is kept. Keys meet their shard by its key range: the ranges of all shards are sent
    to the tasks (24 bytes a shard, which holds megabytes), and the keys of one shard are looked up together.
    """
    spark = keys.sparkSession
    shards = read_manifest(spark, folder).orderBy("shard").collect()
    firsts = spark.sparkContext.broadcast(np.array([r.first_key for r in shards], np.int64))
    files = spark.sparkContext.broadcast([(r.name, r.start) for r in shards])

    def place(batches):
        for batch in batches:
            at = np.searchsorted(firsts.value, batch.column(0).to_numpy(zero_copy_only=False), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32())], names=["k", "x", "shard"])

    def access(group: tuple, table: pa.Table) -> pa.Table:
        asked = table.column("k").to_numpy()
        number = group[0].as_py()
        found, start, length, ids = np.zeros(len(asked), bool), [None] * len(asked), [None] * len(asked), [None] * len(asked)
        if number >= 0:
            name, before = files.value[number]
            shard = Shard(f"{folder}/{name}.ids", f"{folder}/{name}.idx")
            found, offsets, lengths = shard.find(asked)
            for i in np.flatnonzero(found):
                start[i], length[i] = before + int(offsets[i]), int(lengths[i])
                ids[i] = shard.ids(int(offsets[i]), int(lengths[i])).astype("<u4").tobytes()
            shard.close()
        return pa.table({"k": table.column("k"), "x": table.column("x"), "found": pa.array(found),
                         "start": pa.array(start, pa.int64()), "n_tokens": pa.array(length, pa.int64()),
                         "ids": pa.array(ids, pa.binary())})

    asked = keys.select(F.col(key_col).cast("long").alias("k"), (F.col(beside) if beside else F.lit(None)).cast("long").alias("x"))
    # A task per shard: keys are small, what is read for them is not.
    placed = asked.mapInArrow(place, "k long, x long, shard int").repartition(max(1, len(shards)), "shard")
    found = placed.groupBy("shard").applyInArrow(
        access, "k long, x long, found boolean, start long, n_tokens long, ids binary")
    found = found.withColumnRenamed("k", key_col)
    return found.withColumnRenamed("x", beside) if beside else found.drop("x")


def stored_documents(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id",
                     text_col: str = "text", end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write all documents, then read each back by its key: ``(__key, id_col, start, n_tokens, ids)``.

    Null and repeated ids are numbered in id order (nulls last), each row being a document of its own. ``id_col``
    is kept beside the key; other columns are not read.
    """
    rows = with_key(docs.select(id_col, text_col), id_col, tie=text_col)
    write_store(rows, tokenizer_path, folder, text_col, "__key", end_id, shard_bytes)
    return look_up(rows.select("__key", id_col), folder, "__key", id_col).drop("found")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
