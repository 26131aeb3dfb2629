"""Document fingerprints by winnowing.

All k-grams of code points are hashed by a rolling polynomial, and of every window of ``window`` consecutive hashes
the smallest is selected, the rightmost of equal ones. Two texts that share ``window + gram - 1``
code points share a selected hash; the kept positions say where.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetmill.llm.common import input_bytes, with_key

# Small enough that two thirds of a text of 34 code points hold a whole window.
GRAM, WINDOW = 8, 16
_BASE = 0x9E3779B97F4A7C15 | 1
# Code points hashed at a time: bounds the memory for a long text.
_AT_ONCE = 1 << 20


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """The 32-bit hash of every run of ``gram`` code points: a polynomial, doubled up from single points."""
    single = codes.astype(np.uint64) + np.uint64(1)
    out, size, part, width = None, 0, single, 1
    left = gram
    while left:
        if left & 1:
            n = len(codes) - size - width + 1
            out = part if out is None else out[:n] * _power(width) + part[size:size + n]
            size += width
        left >>= 1
        if left:
            part = part[:len(part) - width] * _power(width) + part[width:]
            width *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(32)


def _lowest(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` consecutive values."""
    width = 1
    while width * 2 <= window:
        values = np.minimum(values[:len(values) - width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` of the selected k-grams in text order.

    A text with fewer than ``window`` k-grams is one window; one shorter than a k-gram is hashed
    whole; the empty text selects nothing.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    gram = min(gram, len(codes))
    grams = len(codes) - gram + 1
    window = min(window, grams)
    found = []
    for at in range(0, grams - window + 1, _AT_ONCE):
        stop = min(at + _AT_ONCE, grams - window + 1) + window - 1
        hashes = gram_hashes(codes[at:stop + gram - 1], gram)
        place = np.uint64(0xFFFFFFFF) - np.arange(at, stop, dtype=np.uint64)  # of equal hashes the rightmost is least
        low = _lowest(hashes << np.uint64(32) | place, window)
        found.append(low[np.r_[True, low[1:] != low[:-1]]])
    low = np.concatenate(found)
    low = low[np.r_[True, low[1:] != low[:-1]]]
    return (low >> np.uint64(32)).astype(np.uint32), (~low & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def to_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits a selected k-gram: its hash and its distance from the one before (from the start)."""
    out = np.empty(len(hashes), [("hash", ">u4"), ("gap", "u1")])
    out["hash"], out["gap"] = hashes, np.diff(positions, prepend=np.uint32(0))
    return binascii.hexlify(out.tobytes()).decode("ascii")


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(binascii.unhexlify(fingerprint), [("hash", ">u4"), ("gap", "u1")])
    return raw["hash"].astype(np.uint32), np.cumsum(raw["gap"].astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of distinct selected hashes that both have; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the head of ``following``, or all it has."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                      window: int = WINDOW, part_bytes: int = 24 << 20) -> DataFrame:
    """Fingerprint every document, its edited text, and hold it against the next document in descending id order.

    The document after the last one is the first. Rows are dealt by ranges of the id and read in
    descending order; each range also gets a copy of the one document that follows its last. Texts
    are shuffled once. Null texts are empty. Repeated and null ids (nulls first in descending order) are
    documents of their own; a single document is its own next one; an empty table gives an empty result.
    """
    if not 0 < window < 256:
        raise ValueError("the text form holds distances in one byte: window must be below 256")
    spark = docs.sparkSession
    rows = with_key(docs.select(id_col, text_col), id_col, tie=text_col)
    rows = rows.select("__key", F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, -(-input_bytes(rows) // part_bytes))
    keys = rows.select("__key")
    cuts = []
    if parts > 1:
        at = keys.agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"]
        cuts = sorted(set(map(float, at or [])))

    # Casting the key to double keeps its order, and equal doubles share a range.
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="__at", outputCol="__range")

    def ranged(df):
        return ranges.transform(df.withColumn("__at", F.col("__key").cast("double"))).withColumn(
            "part", F.col("__range").cast("int")).drop("__at", "__range")

    tops = ranged(keys).groupBy("part").agg(F.max("__key").alias("top")).orderBy("part").collect()  # a row per range
    follows = [(tops[i - 1]["top"], tops[i]["part"]) for i in range(len(tops))]
    copies = rows.join(F.broadcast(spark.createDataFrame(follows, "__key long, part int")), "__key")
    both = ranged(rows).select("part", F.lit(0).alias("copy"), "__key", "id", "text").unionByName(
        copies.select("part", F.lit(1).alias("copy"), "__key", "id", "text"))
    dealt = both.repartition(max(len(tops), 1), "part").sortWithinPartitions("part", "copy", F.col("__key").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size = None, [], 0
        for batch in batches:
            for part, copy, number, text in zip(*(batch.column(n).to_pylist() for n in ("part", "copy", "id", "text"))):
                text = text or ""
                mine = winnow(text, gram, window)
                if before is not None:
                    out.append(_compared(*before, text, mine, gram, window))
                    size += len(before[1])
                before = None if copy else (number, text, mine)
            if size > 4 << 20 or len(out) > 1000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)


def _compared(number, text, mine, following, theirs, gram, window) -> tuple:
    changed = edited(text, following)
    other = winnow(changed, gram, window)
    return (number, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), to_text(*mine), to_text(*other),
            likeness(mine[0], other[0]), likeness(mine[0], theirs[0]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
