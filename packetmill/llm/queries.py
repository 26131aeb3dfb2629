"""Registered corpus queries: ``name -> (function of (spark, sf_dir), DuckDB text or None)``.

Each query applies its operator with production parameters to the whole table and derives the compared
columns from the operator's output.
"""

from __future__ import annotations

import zlib

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetmill.llm import (
    embeddings, langid, lattice, mixing, periodic, pieces, pii, quality, simhash, suffixes, target_sampling, token_store, winnowing,
)
from packetmill.llm.common import documents, pick, tuned
from packetmill.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode with offsets and decode every text; digests of ids and of the decoded text."""
    coded = pieces.encode_documents(pick(documents(spark, sf_dir), "doc_id", "text"), PIECES)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one text, and lines that too many documents of a source share."""
    return quality.judge(pick(documents(spark, sf_dir), "doc_id", "text", "source")).drop("kept_text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every text; rows whose fold is 2 of 4 teach nothing."""
    docs = pick(documents(spark, sf_dir), "doc_id", "text", "lang")
    held_out = langid.in_fold("doc_id", 4, 2)
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove all 100-byte strings that start earlier elsewhere."""
    done = suffixes.remove_repeats(pick(documents(spark, sf_dir), "doc_id", "text"), span=100)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal log probability of every text under the piece lattice; rows whose fold is 1 of 5 teach nothing."""
    return lattice.score(pick(documents(spark, sf_dir), "doc_id", "text"), langid.in_fold("doc_id", 5, 1), PIECES)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing of all sources at weights 5, 2, 1."""
    mixed = mixing.mix(pick(documents(spark, sf_dir), "doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5('mix:' || cast(doc_id as varchar)) as shuffled
  from documents),
s as (
  select *, 3 * source_size as cap, 3 * source_size / weight as full_at
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place,
               case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double
               else 1.0::double end as weight
        from d group by source)),
l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by full_at, place rows between unbounded preceding
             and 1 preceding), 0)) / sum(weight) over (order by full_at, place rows between current row and unbounded following) as level
  from s),
t as (select *, min(case when full_at > level then level end) over () as fits from l),
p as (select source, place, weight, source_size,
             case when fits is null or full_at <= fits then cap::double else fits * weight end as target from t),
q as (select d.*, place, weight, source_size, target,
             sum(size) over (partition by place order by shuffled, doc_id rows unbounded preceding) as upto
      from d join p on d.source is not distinct from p.source),
turns as (select q.*, r.turn, ((r.turn * source_size + upto)::double / weight) as finish
          from q join (select unnest([0, 1, 2]) as turn) r on r.turn = 0 or q.size > 0),
served as (select doc_id, size, sum(size) over (order by finish, place, turn, shuffled, doc_id rows unbounded preceding) as spent
           from turns),
c as (select doc_id, count(*) as copies from served where spent <= (select sum(size) from d) group by doc_id)
select q.doc_id, q.size::bigint as size, q.source_size, q.target, (coalesce(copies, 0) * q.size)::bigint as taken
from q left join c using (doc_id)
"""


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids as binary shards with their hash index, read every document back by its key."""
    docs = pick(documents(spark, sf_dir), "doc_id", "text")
    back = token_store.stored_documents(docs, BYTES, scratch_path(spark, "token-store"))

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(zlib.crc32)

    return back.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of each text, of its edited text, and their likeness to it and to the next document's."""
    return winnowing.compare_with_next(pick(documents(spark, sf_dir), "doc_id", "text"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by fixed rules and by the trained tagger."""
    docs = pick(documents(spark, sf_dir), "doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash over three-word shingles, linked at three differing bits through two 32-bit segments."""
    docs = pick(documents(spark, sf_dir), "doc_id", "text")
    groups = simhash.near_duplicates(docs, words=3, radius=3, segments=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label at a cosine of 0.98 or more: links, groups and the vector that stands for each group."""
    return embeddings.near_duplicates(tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op12_target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn by their likeness to the benchmark's texts."""
    target = tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return target_sampling.resample(pick(documents(spark, sf_dir), "doc_id", "text"), pick(target, "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in every text, a tenth of the texts with periodic tails."""
    docs = periodic.repeat_tail(pick(documents(spark, sf_dir), "doc_id", "text"))
    found = periodic.with_runs(docs).withColumn("best", periodic.strongest("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_piece_encoding": (op1_piece_encoding, None),
    "op2_quality_rules": (op2_quality_rules, quality.SQL),
    "op3_language_id": (op3_language_id, None),
    "op4_repeated_strings": (op4_repeated_strings, None),
    "op5_lattice_likelihood": (op5_lattice_likelihood, None),
    "op6_source_mix": (op6_source_mix, OP6_SQL),
    "op7_token_store": (op7_token_store, None),
    "op8_winnowing": (op8_winnowing, None),
    "op9_personal_data": (op9_personal_data, None),
    "op10_simhash_groups": (op10_simhash_groups, None),
    "op11_embedding_groups": (op11_embedding_groups, embeddings.SQL),
    "op12_target_sample": (op12_target_sample, target_sampling.SQL),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
