"""Importance resampling towards a target distribution over hashed word features.

Every text is a bag of its words and of its pairs of neighbouring words, each hashed to a bucket. The log ratio of a
bucket's smoothed share in the target texts and in the corpus is its gain, a text's weight the mean gain of its features, and the
texts with the highest sums of weight and Gumbel noise are a sample without replacement by weight.

Texts are taken apart by Arrow kernels, a batch at a time: ``ascii_lower`` and ``split_pattern_regex``, ``list_flatten`` to
one column of words, ``dictionary_encode`` to indices. An index and the next one of the same text are a pair; only
distinct words and pairs are hashed, gains are taken by index and summed per text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, with_key
from packetmill.llm.prefix import running_total
from packetmill.session import materialise

BUCKETS = 10_000
# Everything in ASCII but digits and lower-case letters parts words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashed_features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, feature, bucket)``: the row of each feature, its number among the distinct ones, and the bucket of those."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_BETWEEN)
    owner, words = pc.list_parent_indices(parts), pc.list_flatten(parts)
    real = pc.greater(pc.binary_length(words), 0)
    owner = pc.filter(owner, real).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.filter(words, real).dictionary_encode()
    index, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    together = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = pa.array(index[together] * len(known) + index[together + 1]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(zero_copy_only=False), max(len(known), 1))
    joined = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), " ")
    bucket = np.concatenate([_hashed(known, buckets), _hashed(joined, buckets)])
    pair_index = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(known)
    return np.concatenate([owner, owner[together]]), np.concatenate([index, pair_index]), bucket


def _hashed(texts: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each text; their bytes are sliced from the column's one buffer, which is far cheaper than a list of texts."""
    if not len(texts):
        return np.empty(0, np.int64)
    _, offsets, data = texts.cast(pa.binary()).buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].tolist()
    data = data.to_pybytes()
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(texts)) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features of all texts; each task sends a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, feature, bucket = hashed_features(batch.column(0), buckets)
            often = np.bincount(feature, minlength=len(bucket))
            total += np.bincount(bucket, weights=often, minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target over corpus, rounded down, per bucket."""
    counts = []
    for df, col in ((docs, text_col), (target, target_col)):
        found = np.zeros(buckets, np.int64)
        for row in bucket_counts(df, col, buckets).collect():  # a row per bucket at most
            found[row["bucket"]] = row["n"]
        counts.append(found)
    (s, t), (all_s, all_t) = counts, (int(c.sum()) for c in counts)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * float(all_s + buckets) / ((float(a) + 1) * float(all_t + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``n_features`` and ``weight``, the mean gain of its features rounded down (0 without features)."""
    table = pa.array(gain)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            owner, feature, bucket = hashed_features(batch.column(batch.schema.get_field_index(text_col)), len(gain))
            of_feature = pc.take(table, pa.array(bucket)).to_numpy(zero_copy_only=False)[feature]
            n = np.bincount(owner, minlength=batch.num_rows)
            # Whole numbers far below 2**53: exact as doubles.
            total = np.bincount(owner, weights=of_feature, minlength=batch.num_rows).astype(np.int64)
            return {"n_words": pa.array((n + 1) // 2), "n_features": pa.array(n.astype(np.int64)),
                    "weight": pa.array(total // np.maximum(n, 1))}
        return work

    return append_columns(docs, make, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``(id_col, n_words, n_features, weight, score, rank)`` per row.

    ``percent`` of the rows with at least ``min_words`` words are drawn by the highest scores, ties to smaller ids (null ids
    last, equal ids by weight); the rank counts them from 1 and is null for rows not drawn. Scores are the weight plus Gumbel noise
    in thousandths, from the hash of seed and id, a null id counting as an empty one. Null and empty texts have no feature and
    weight 0; a text is taken whole however long it is; repeated rows are drawn separately; without
    target texts every gain compares with an even spread; an empty table gives an empty result. Other columns are not read.
    """
    gain = gains(docs, target, text_col, target_col, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighted(docs.select(id_col, text_col), gain, text_col).drop(text_col)
    scored = with_key(materialise(scored.withColumn("score", F.col("weight") + noise), "target-scores"), id_col, tie="weight")
    able = F.col("n_words") >= min_words
    drawn = (scored.filter(able).count() * percent) // 100
    ranked = running_total(scored.filter(able).withColumn("__one", F.lit(1).cast("long")),
                           [F.col("score").desc(), F.col("__key").asc()], "__one", "place", name="target-order")
    columns = [id_col, "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(
        scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


#: The same in DuckDB. CRC-32 is written out over the bytes of distinct features; ``table`` is its table of 256 remainders.
SQL = r"""
with steps as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda acc, i:
    case when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end, b)) as remainders),
texts as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (
  select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from texts),
f as (
  select kind, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature
  from w),
n as (select kind, id, feature, count(*) as n from f group by all),
distinct_features as (select feature, hex(encode(feature)) as digits from (select distinct feature from n)),
h as (
  select feature, xor(list_reduce(list_transform(range(len(digits) // 2), lambda i: ('0x' || digits[2 * i + 1:2 * i + 2])::bigint),
    lambda acc, byte: xor(remainders[(xor(acc, byte) & 255) + 1], acc >> 8), 4294967295), 4294967295) % 10000 as bucket
  from distinct_features, steps),
c as (select bucket, sum(n) filter (kind = 'd') as s, sum(n) filter (kind = 'b') as t from n join h using (feature) group by bucket),
a as (select coalesce(sum(s), 0) as all_s, coalesce(sum(t), 0) as all_t from c),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (all_s + 10000)::double
    / ((coalesce(s, 0) + 1)::double * (all_t + 10000)::double)))::bigint as gain from c, a),
v as (select id, floor(sum(n * gain)::double / sum(n))::bigint as weight from n join h using (feature) join g using (bucket)
  where kind = 'd' group by id),
d as (
  select id as doc_id, len(words) as n_words, greatest(2 * len(words) - 1, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score
  from (select * from w where kind = 'd') left join v using (id)),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
  (25 * count(*) over (partition by n_words >= 20)) // 100 as drawn from d)
select doc_id, n_words, n_features, weight::bigint as weight, score, case when n_words >= 20 and place <= drawn then place end as rank from r
"""
