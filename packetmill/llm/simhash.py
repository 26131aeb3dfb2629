"""SimHash fingerprints, linked through multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // segments`` bits of one segment at least, so each one looks up the small Hamming ball around
its own segment values in a table of all segment values, and the pairs found are held to the
complete distance.

Segment values that very many different fingerprints share (groups of near copies) are not paired: the
rest of the fingerprint decides there, through common points instead of pairs (see ``_crowded``).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, texts_of
from packetmill.llm.components import components
from packetmill.session import materialise

BITS, SEED = 64, 42
# Shingles hashed at a time: bounds the bit matrix of a long text.
_AT_ONCE = 1 << 15


def sketch(text: str, words: int, seeds: list[int], once: bool = False) -> list[int]:
    """Unsigned 64-bit SimHashes, one a seed, of the lower-cased (A-Z) word shingles; 0 for a text without words.

    Repeated shingles count as often as they stand in the text, or ``once``.
    """
    w = text.encode("utf-8").lower().split()
    if not w:
        return [0] * len(seeds)
    rows = [b" ".join(t) for t in zip(*(w[i:] for i in range(words)))] if len(w) > words else [b" ".join(w)]
    rows = list(set(rows)) if once else rows
    ones, digest = np.zeros((len(seeds), BITS), np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(rows), _AT_ONCE):
        part = rows[at:at + _AT_ONCE]
        for k, seed in enumerate(seeds):
            h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(rows), axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: str, words: int = 3) -> int:
    return sketch(text, words, [SEED])[0]


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """Every row with ``fp``, the fingerprint's bits as a signed long. Null texts count as empty: fingerprint 0."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            values = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
            return {"fp": pa.array(values.view(np.int64))}
        return work

    return append_columns(docs, make, [T.StructField("fp", T.LongType())])


def _ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _masks(width: int, radius: int):
    return F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])


def _segments(fps: DataFrame, segments: int) -> DataFrame:
    """``(seg, val, rest, fp)``: each segment's value and the other bits, in place."""
    width = BITS // segments
    low = (1 << width) - 1
    parts = []
    for s in range(segments):
        mask = low << (s * width)
        mask = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        parts.append(F.struct(
            F.lit(s).alias("seg"),
            F.shiftrightunsigned(F.col("fp"), s * width).bitwiseAND(F.lit(low).cast("long")).alias("val"),
            F.col("fp").bitwiseAND(F.bitwise_not(F.lit(mask).cast("long"))).alias("rest")))
    return fps.select("fp", F.explode(F.array(*parts)).alias("x")).select("x.*", "fp")


def links(fps: DataFrame, radius: int = 3, segments: int = 2, crowd: int = 64) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs at ``radius`` or fewer differing bits.

    ``fps`` holds distinct fingerprints. Every edge is a true link. Below ``crowd`` fingerprints per
    segment value all links are returned; crowded values return links that connect the same fingerprints.
    """
    if BITS % segments or radius // segments > 1:
        raise ValueError("segments must divide 64 and leave at most one differing bit in one of them")
    near, width = radius // segments, BITS // segments
    table = materialise(_segments(fps, segments), "simhash-table")
    probe = table.select("seg", "val", "rest", "fp", F.explode(_masks(width, near)).alias("mask")).select(
        "seg", (F.col("val").bitwiseXOR(F.col("mask"))).alias("val"), "rest", "fp", (F.col("mask") != 0).alias("off"))
    crowded = materialise(table.groupBy("seg", "val").count().filter(F.col("count") > crowd).select("seg", "val"),
                          "simhash-crowded")
    calm = table.join(crowded, ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("other"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    pairs = (probe.select("seg", "val", "fp").join(calm.hint("shuffle_hash"), ["seg", "val"])
             .filter((F.col("fp") != F.col("other")) & (apart <= radius)).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    return pairs.unionByName(_crowded(table, probe, crowded, radius, segments, apart))


def _crowded(table, probe, crowded, radius, segments, apart) -> DataFrame:
    """Links at crowded segment values, linear in the fingerprints there.

    Members share the segment value v and differ in the rest only; a prober's segment is v but for one bit. All
    members within one bit of a point p (in the rest) lie within two bits of each other; the smallest stands for
    them. A member within ``radius - 1`` bits of p, or a prober within ``radius - 2``, links to that smallest. Each
    pair within ``radius`` has such a point on a shortest way between them, so nothing is lost, and
    no edge is longer than ``radius``.
    """
    width = BITS // segments
    member = table.join(crowded, ["seg", "val"], "left_semi")

    def at(df, reach, name):
        # Bits of the rest lie in place: all positions outside of the segment.
        def masks(s):
            inside = set(range(s * width, (s + 1) * width))
            free = [i for i in range(BITS) if i not in inside]
            out = [sum(1 << i for i in c) for r in range(reach + 1) for c in combinations(free, r)]
            return F.array(*[F.lit(m - (1 << BITS) if m >= 1 << (BITS - 1) else m).cast("long") for m in out])

        pieces = [df.filter(F.col("seg") == s).select("seg", "val", "rest", "fp", F.explode(masks(s)).alias("mask"))
                  for s in range(segments)]
        out = pieces[0]
        for p in pieces[1:]:
            out = out.unionByName(p)
        return out.select("seg", "val", F.col("rest").bitwiseXOR(F.col("mask")).alias("point"), F.col("fp").alias(name))

    hubs = at(member, 1, "fp").groupBy("seg", "val", "point").agg(F.min("fp").alias("other"))
    edges = at(member, radius - 1, "fp").join(hubs, ["seg", "val", "point"])
    if radius // segments and radius >= 2:
        prober = probe.filter("off").join(crowded, ["seg", "val"], "left_semi")
        edges = edges.unionByName(at(prober, radius - 2, "fp").join(hubs, ["seg", "val", "point"]))
    return edges.filter((F.col("fp") != F.col("other")) & (apart <= radius)).select(
        F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    radius: int = 3, segments: int = 2) -> DataFrame:
    """``(id_col, fp, component_id)`` per row: the smallest id that the row's fingerprint reaches.

    Links are transitive. Null and empty texts have fingerprint 0 and link like any other; rows with equal
    fingerprints are one node. Null ids are never a component's name unless it has no other (then null).
    Repeated rows each get their row; an empty table gives an empty result; other columns are not read.
    """
    marked = materialise(fingerprints(docs.select(id_col, text_col), text_col, words).select(id_col, "fp"), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    root = components(materialise(links(nodes.select("fp"), radius, segments), "simhash-links"))
    named = nodes.join(root, nodes["fp"] == root["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    named = materialise(named, "simhash-roots")
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(name, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# Hash seeds of a long sketch: its first words are indexed, the first two decide whether a lookup is a candidate, and
# all of them are compared. Texts at crowded segment values are told apart by sharper sketches of SHARP words.
SKETCH_SEEDS, INDEXED, CARRIED, SHARP = [42, 43, 44, 45], 3, 2, 32
# Texts at one segment value from which further leaders are asked for, leaders a round, and texts of one group there
# from which its own lookups pass it over. Above DENSE texts beyond four times the mean, sharper sketches are compared.
CROWD, LEADERS, MANY, DENSE = 64, 4, 16, 4


def most_bits(similarity: float, bits: int = BITS * len(SKETCH_SEEDS)) -> int:
    """Differing bits of two sets with that Jaccard similarity: the angle between them as a share of the bits, and three deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def sketches(docs: DataFrame, key_col: str, text_col: str, words: int) -> DataFrame:
    """``(key_col, s0 .. s3)``, of the sets of shingles: the angle between two sketches then follows their Jaccard similarity."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            table = np.array([sketch(t, words, SKETCH_SEEDS, True) for t in texts], np.uint64).reshape(-1, len(SKETCH_SEEDS))
            return {f"s{k}": pa.array(table[:, k].copy().view(np.int64)) for k in range(len(SKETCH_SEEDS))}
        return work

    fields = [T.StructField(f"s{k}", T.LongType()) for k in range(len(SKETCH_SEEDS))]
    return append_columns(docs.select(key_col, text_col), make, fields).drop(text_col)


def _slots(nodes: DataFrame, *keep: str) -> DataFrame:
    """``(slot, ...)`` for each 16-bit segment of the indexed words; the slot holds which segment it is, and its value."""
    parts = [F.lit((k * 4 + s) << 16).cast("long") + F.shiftrightunsigned(F.col(f"s{k}"), 16 * s).bitwiseAND(
        F.lit(0xFFFF).cast("long")) for k in range(INDEXED) for s in range(4)]
    return nodes.select(*keep, F.explode(F.array(*parts)).alias("slot"))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) word shingles; empty for a text without words."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    rows = {b" ".join(t) for t in zip(*(w[i:] for i in range(words)))} if len(w) > words else {b" ".join(w)}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in rows), np.uint64, len(rows)))


def sharp_sketch(text: str, words: int, size: int = SHARP) -> np.ndarray:
    """``size`` signed words: each shingle is hashed once and its hash mixed with a number a word (the finaliser of splitmix64)."""
    h = shingle_set(text, words)
    ones = np.zeros(size * BITS, np.int64)
    step = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, len(h), _AT_ONCE // size):
        z = h[at:at + _AT_ONCE // size, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))).astype("<u8")
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")


def sharp_sketches(docs: DataFrame, key_col: str, text_col: str, words: int) -> DataFrame:
    """``(key_col, t0 .. t31)``."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            table = np.array([sharp_sketch(t, words) for t in texts], np.int64).reshape(-1, SHARP)
            return {f"t{k}": pa.array(table[:, k].copy()) for k in range(SHARP)}
        return work

    return append_columns(docs.select(key_col, text_col), make,
                          [T.StructField(f"t{k}", T.LongType()) for k in range(SHARP)]).drop(text_col)


def only(docs: DataFrame, keys: DataFrame, key_col: str, bits: int = 23) -> DataFrame:
    """The rows whose key is among ``keys``. Others go by a bitmap of hashes of fixed size before anything is shuffled, so texts stay in place.

    An inner join on distinct keys decides: Spark moves a semi-join below the bitmap's, and all texts are shuffled to it.
    """
    place = F.pmod(F.xxhash64(key_col), F.lit(1 << bits)) + 1
    at = F.bitmap_bit_position(place)
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(at).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.pmod(byte / F.pow(F.lit(2.0), at % 8), F.lit(2.0)) >= 1
    maybe = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__bucket")).filter(held)
    return maybe.drop("__bucket", "__map").join(keys.select(key_col).distinct(), key_col)


def really_similar(edges: DataFrame, docs: DataFrame, key_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """The edges ``(a, b)`` between keys whose shingle sets have that Jaccard similarity; sets are made for these rows only."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            return {"__set": pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())}
        return work

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [[np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3)]
            fine = []
            for i, (x, y) in enumerate(zip(*sets)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - both
                if not whole or both >= similarity * whole:
                    fine.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in fine], pa.int64()) for c in (a, b)], names=["a", "b"])

    ends = edges.select(F.col("a").alias(key_col)).union(edges.select("b")).distinct()
    sets = append_columns(only(docs.select(key_col, text_col), ends, key_col), make,
                          [T.StructField("__set", T.BinaryType())]).drop(text_col)
    sets = materialise(sets, "shingle-sets")
    left, right = (sets.select(F.col(key_col).alias(c), F.col("__set").alias(f"__{c}")) for c in "ab")
    return edges.join(left, "a").join(right, "b").select("a", "b", "__a", "__b").mapInArrow(check, "a long, b long")


def similar_groups(docs: DataFrame, key_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(key_col, root)``: the smallest key among the row's near duplicates at ``similarity`` or more of their shingle sets.

    Rows are compared by sketches of 256 bits. Three of its 64-bit words are indexed by 16-bit segments; a lookup asks for
    the values with at most one more bit, so every pair of texts within 7 bits of one of these words is met for certain, and a pair
    at a similarity of 0.8 in 98 cases of 100; then the complete distances, and last the shingle sets themselves, decide.
    Every distance may be three deviations above that of a pair at ``similarity``.
    Every different text is indexed and asks; only pairs that earlier links have joined already are left out (see
    ``_met``). Before that, every text is held against the most frequent text of each of its segment values, and
    where a segment value is crowded with several groups against further ones, which takes groups of near copies
    together in linear work. Unique keys are needed. Links are transitive; texts without
    words are near duplicates of each other; null texts count as such; an empty table gives an empty result.
    """
    most, all_words = most_bits(similarity), [f"s{k}" for k in range(len(SKETCH_SEEDS))]
    marked = materialise(sketches(docs, key_col, text_col, words), "sketches")
    nodes = materialise(marked.groupBy(*all_words).agg(F.min(key_col).alias("node"), F.count("*").alias("n")), "sketch-nodes")

    def apart(a, b):
        return sum((F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(len(SKETCH_SEEDS))), F.lit(0))

    def linked(edges: DataFrame, name: str) -> DataFrame:
        edges = materialise(edges.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), f"sketch-{name}")
        return materialise(really_similar(edges, docs, key_col, text_col, words, similarity), f"similar-{name}")

    def grouped(found: DataFrame) -> DataFrame:
        return materialise(nodes.join(components(found), "node", "left").select(
            "node", F.coalesce("root", "node").alias("root"), *all_words), "sketch-groups")

    table = _slots(nodes, "node", "n", *all_words)
    leader = table.groupBy("slot").agg(F.max(F.struct("n", (-F.col("node")).alias("last"), *all_words)).alias("p")).select(
        "slot", (-F.col("p.last")).alias("other"), *[F.col(f"p.{w}").alias(f"p{w}") for w in all_words])
    found = linked(table.join(leader, "slot").filter((F.col("node") != F.col("other")) & (apart("", "p") <= most)), "led")
    group, number = grouped(found), 0
    while True:
        table = _slots(group, "node", "root", *all_words)
        crowded = materialise(table.groupBy("slot").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed"))
                              .filter((F.col("n") > CROWD) & F.col("mixed")).select("slot"), "sketch-crowded")
        members = table.join(crowded, "slot")
        before = members.select("root").distinct().count()
        if not before:
            break
        # Leaders by the hash of node and number: others in each round, and most of them from the largest groups.
        leaders = members.groupBy("slot").agg(F.array(*[
            F.max(F.struct(F.xxhash64("node", F.lit(number + i)), F.col("node").alias("other"), F.col("root").alias("proot"),
                           *[F.col(w).alias(f"p{w}") for w in all_words])) for i in range(LEADERS)]).alias("p"))
        leaders = materialise(leaders.select("slot", F.explode("p").alias("p")).select(
            "slot", "p.other", "p.proot", *[f"p.p{w}" for w in all_words]), "sketch-leaders")
        found = found.unionByName(linked(members.join(leaders, "slot").filter(
            (F.col("root") != F.col("proot")) & (apart("", "p") <= most)), "led"))
        joined, group, number = group, grouped(found), number + LEADERS
        less = joined.select("root").distinct().count() - group.select("root").distinct().count()
        if less * 20 <= before:  # the lookups are complete without a further round
            break
    near = materialise(_met(group, docs, key_col, text_col, words, similarity), "sketch-near")
    other = group.select(F.col("node").alias("other"), *[F.col(w).alias(f"o{w}") for w in all_words])
    met = linked(near.join(group, "node").join(other, "other").filter(apart("", "o") <= most), "met")
    root = materialise(components(materialise(found.unionByName(met), "similar-links")), "sketch-roots")
    named = nodes.join(root, "node", "left").select(*all_words, F.coalesce("root", "node").alias("root"))
    return marked.join(named, all_words).select(key_col, "root")


def _met(group: DataFrame, docs: DataFrame, key_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Pairs ``(node, other)`` of different roots, met at equal values or one bit apart, whose distance allows the similarity.

    Where one root has many nodes at a segment value, its own nodes ask for the other roots' nodes there only, so the pairs
    inside of a large group are never looked at; nodes of other roots ask for all. Elsewhere two words decide. At
    segment values with far more texts than the mean most texts are near copies that just miss the similarity,
    which short sketches cannot tell: there 2048 bits are compared, made for the texts at those values only.
    """
    dense = DENSE + 4 * group.count() / (1 << 16)
    carried, sharp = [f"s{k}" for k in range(CARRIED)], [f"t{k}" for k in range(SHARP)]
    index = _slots(group, "node", "root", *carried).select(
        "slot", F.col("node").alias("other"), F.col("root").alias("oroot"), *[F.col(w).alias(f"o{w}") for w in carried])
    sizes = materialise(index.groupBy("slot", "oroot").count().groupBy("slot").agg(
        F.max(F.struct("count", "oroot")).alias("p"), F.sum("count").alias("all")).filter(
        (F.col("p.count") > MANY) | (F.col("all") > 1)), "sketch-sizes")
    # Around a very crowded value its texts ask at each neighbour, too.
    around = sizes.filter(F.col("all") > 2 * dense).select(F.explode(_masks(16, 1)).alias("mask"), "slot").select(
        F.col("slot").bitwiseXOR(F.col("mask")).alias("slot")).distinct().withColumn("around", F.lit(True))
    big = sizes.join(around, "slot", "full").withColumn(
        "crowd", F.coalesce("around", F.lit(False)) | F.coalesce(F.col("all") > dense, F.lit(False)))
    big = materialise(big.filter((F.col("p.count") > MANY) | F.col("crowd")).select(
        "slot", F.when(F.col("p.count") > MANY, F.col("p.oroot")).alias("big"),
        (F.col("all") - F.col("p.count")).alias("rest"), "crowd"), "sketch-big")
    # A row a segment value, of 12 * 2**16 there are. Broadcast, so that the lookups are filtered first and shuffled once.
    big = F.broadcast(big)
    # Of two values that differ in one bit the one without it asks: each direction finds all pairs, so one is enough.
    asked = _slots(group, "node", "root", *carried).withColumn("mask", F.explode(_masks(16, 1))).filter(
        F.col("slot").bitwiseAND(F.col("mask")) == 0).select(
        F.col("slot").bitwiseXOR(F.col("mask")).alias("slot"), (F.col("mask") == 0).alias("same"), "node", "root", *carried).join(
        big, "slot", "left")
    index = index.join(big.drop("rest"), "slot", "left")
    of_big = F.coalesce(F.col("oroot") == F.col("big"), F.lit(False))
    foreign = F.coalesce(F.col("root") != F.col("big"), F.lit(True))
    crowd = F.coalesce(F.col("crowd"), F.lit(False))

    def pairs(asks: DataFrame, held: DataFrame, columns: list[str], *more: Column) -> DataFrame:
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in columns), F.lit(0))
        fits = (F.col("node") != F.col("other")) & (F.col("root") != F.col("oroot")) & (
            apart <= most_bits(similarity, BITS * len(columns)))
        for further in more:
            fits = fits & further
        return asks.drop("big", "rest", "crowd", "same").join(held.drop("big", "crowd").hint("shuffle_hash"), "slot").filter(fits).select(
            F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))

    def both(asks: DataFrame, held: DataFrame, columns: list[str], *more: Column) -> DataFrame:
        return pairs(asks.filter(foreign | (F.col("rest") > 0)), held.filter(~of_big), columns, *more).unionByName(
            pairs(asks.filter(F.col("big").isNotNull() & foreign), held.filter(of_big), columns, *more))

    # The sharp words join one row a text, with all its lookups; values around that no text has answer nothing.
    held = materialise(index.filter(crowd).drop(*[f"o{w}" for w in carried]), "crowd-held")
    asks = asked.filter(crowd & (foreign | (F.col("rest") > 0))).join(held.select("slot").distinct(), "slot", "left_semi")
    asks = materialise(asks.groupBy("node", "root").agg(F.collect_list(F.struct("slot", "big", "rest", "same")).alias("asks")), "crowd-asks")
    there = asks.select(F.col("node").alias(key_col)).union(held.select("other")).distinct()
    marks = materialise(sharp_sketches(only(docs.select(key_col, text_col), there, key_col), key_col, text_col, words),
                        "sharp-sketches").select(F.col(key_col).alias("node"), *sharp)
    asks = asks.join(marks, "node").select(
        "node", "root", *sharp, F.col("asks.slot").alias("slots"),
        F.filter("asks", lambda ask: ~ask["same"])["slot"].alias("off"), F.explode("asks").alias("ask")).select(
        "node", "root", *sharp, "slots", "off", "ask.*")
    held = held.groupBy("other", "oroot").agg(F.collect_list(F.struct("slot", "big")).alias("held")).join(
        marks.select(F.col("node").alias("other"), *[F.col(t).alias(f"o{t}") for t in sharp]), "other")
    held = held.select("other", "oroot", *[f"o{t}" for t in sharp], F.col("held.slot").alias("oslots"), F.explode("held").alias("at")).select(
        "other", "oroot", *[f"o{t}" for t in sharp], "oslots", "at.*")
    # A pair that meets at several values leaves at the first only, and where both texts have the same value the smaller node asks.
    first = F.array_min(F.array_intersect(F.when(F.col("node") < F.col("other"), F.col("slots")).otherwise(F.col("off")), "oslots"))
    crowded = _crowd_pairs(both, asks, held, sharp, F.col("slot") == first)
    return both(asked.filter(~crowd), index.filter(~crowd), carried).unionByName(crowded).distinct()


def _crowd_pairs(both, asks: DataFrame, held: DataFrame, sharp: list[str], leaves: Column) -> DataFrame:
    """The pairs at crowded values, each at most twice: once for each of its texts that asks."""
    return both(asks, held, sharp, leaves)
