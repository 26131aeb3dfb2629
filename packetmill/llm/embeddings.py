"""Near duplicates among embeddings: cosines of tiles of vectors, leading principal components first.

Unit vectors are turned into the principal axes of a sample, which changes no cosine and puts most of each vector's length
into its first components. The product of two vectors over the first k components, plus the product of the lengths of what is
left of them, is an upper bound of their cosine: a pair is given up as soon as that bound is below the threshold.
Vectors of one label are ordered by their first component and cut into blocks; unit vectors with a cosine of t differ by
at most sqrt(2 - 2t) in it, so blocks further apart than that never meet. Every other pair of blocks is one task's
work, whatever the label's size, and goes tile by tile. A task returns a row per vector that has a link: the number of its links
and the smallest vector it is connected with there. Pairs are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, batch_rows, pick, with_key
from packetmill.llm.components import components
from packetmill.llm.prefix import running_total
from packetmill.session import materialise

#: Vectors and numbers that a block holds at most, vectors a side of a tile, vectors that the axes are fitted on (they decide the
#: speed alone).
BLOCK, NUMBERS, TILE, FIT_ROWS = 4096, 1 << 22, 1024, 20_000
#: Above all rounding of sums over unit vectors: pairs this near to the threshold are decided by their exact cosine.
_SLACK = 1e-9


def valid(label: str, vector: str):
    """Whether a row can have links: a label, and a vector of finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows as doubles, each times a power of two that puts its largest number near 1: no cosine changes, no square overflows."""
    vectors = np.asarray(vectors, float)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def fit_axes(nodes: DataFrame, vector: str, key: str, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Principal axes as columns, for each length of vector, from at most about ``rows`` vectors of that length, by hash.

    Lengths with fewer than two vectors, or beyond 4,096 numbers, keep the given axes.
    """
    axes = {}
    counts = nodes.groupBy(F.size(vector).alias("size")).count().collect()  # a row per length of vector
    for size, n in sorted((r["size"], r["count"]) for r in counts):
        if n < 2 or size < 2 or size > 4096:
            continue
        largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
        share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))
        drawn = nodes.filter((F.size(vector) == size) & share).select(
            F.transform(vector, lambda x: x.cast("double") / largest).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        drawn = drawn.select(array_to_vector(F.transform("v", lambda x: x / length)).alias("v"))
        if drawn.limit(2).count() == 2:
            axes[size] = PCA(k=size, inputCol="v", outputCol="pc").fit(drawn).pc.toArray()
    return axes


def turned(vectors: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit vectors along the axes."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return unit if axes is None else unit @ axes


class Tiles:
    """Vectors of one length, ready for bounded comparison."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None):
        self.exact = scaled(vectors)
        self.turned = turned(self.exact, axes)
        size = vectors.shape[1]
        self.steps = [k for k in (8, 16, 32, 64, 128, 256, 512, 1024, 2048) if k < size] + [size]
        squares = np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1)
        self.rest = {k: np.sqrt(rest[:, k]) for k in self.steps}
        self.length = np.sqrt((self.exact * self.exact).sum(axis=1))

    def linked(self, a: slice, b: slice, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of two tiles at the threshold or above; ``upper`` keeps those whose second row comes later."""
        first = self.steps[0]
        bound = self.turned[a, :first] @ self.turned[b, :first].T
        keep = bound + np.outer(self.rest[first][a], self.rest[first][b]) >= threshold - _SLACK
        if upper:
            keep &= np.arange(b.start, b.start + keep.shape[1]) > np.arange(a.start, a.start + keep.shape[0])[:, None]
        i, j = np.nonzero(keep)
        product, i, j = bound[i, j], i + a.start, j + b.start
        found = []
        for part in range(0, len(i), 1 << 17):
            found.append(self._finish(i[part:part + (1 << 17)], j[part:part + (1 << 17)], product[part:part + (1 << 17)], threshold))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (i, j)

    def _finish(self, i, j, product, threshold):
        """Add the other components step by step for the pairs whose bound allows it; the last word has the exact cosine."""
        for low, high in zip(self.steps, self.steps[1:]):
            product = product + np.einsum("ij,ij->i", self.turned[i, low:high], self.turned[j, low:high])
            open_ = product + self.rest[high][i] * self.rest[high][j] >= threshold - _SLACK
            i, j, product = i[open_], j[open_], product[open_]
        cosine = np.einsum("ij,ij->i", self.exact[i], self.exact[j]) / (self.length[i] * self.length[j])
        fine = cosine >= threshold
        return i[fine], j[fine]


def connect(smallest: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of pairs; ``smallest`` holds the smallest row of each row's component, before and after."""
    while True:
        a, b = smallest[i], smallest[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(smallest, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = smallest[smallest]
            if (further == smallest).all():
                break
            smallest[:] = further


def compare_blocks(table: pa.Table, threshold: float, axes: dict[int, np.ndarray], tile: int = TILE) -> pa.Table:
    """``(node, links, root)`` of the vectors with a link between block ``a`` and block ``b``, or inside of one block if they are equal.

    Links count ``copies`` of the other vector.
    """
    table = table.sort_by("node")
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    home = table.column("block").to_numpy()
    size = int(table.column("size")[0].as_py())
    vectors = np.asarray(table.column("vector").combine_chunks().flatten()).reshape(len(table), size)
    order = np.argsort(home, kind="stable")
    cut = int((home == home.min()).sum()) if len(home) else 0
    tiles = Tiles(vectors[order], axes.get(size))
    count, smallest, back = np.zeros(len(node), np.int64), np.arange(len(node)), order
    one = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    sides = ((0, len(node)), (0, len(node))) if one else ((0, cut), (cut, len(node)))
    for x in range(*sides[0], tile):
        a = slice(x, min(x + tile, sides[0][1]))
        for y in range(x if one else sides[1][0], sides[1][1], tile):
            i, j = tiles.linked(a, slice(y, min(y + tile, sides[1][1])), threshold, one)
            i, j = back[i], back[j]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            connect(smallest, i, j)
    found = np.flatnonzero(count)
    return pa.table({"node": pa.array(node[found]), "links": pa.array(count[found]), "root": pa.array(node[smallest[found]])})


def blocks(nodes: DataFrame, axes: dict[int, np.ndarray], threshold: float, block: int) -> DataFrame:
    """``(label, size, block, node, copies, vector, low, high)``: the block of each vector, and the range of blocks it may have links in."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index("vector"))
            lead = [float(turned(scaled(np.array([v], float)), axes.get(len(v)))[0, 0]) for v in column.to_pylist()]
            return {"lead": pa.array(lead, pa.float64())}
        return work

    placed = materialise(append_columns(nodes, make, [T.StructField("lead", T.DoubleType())])
                         .withColumn("group", F.struct("label", "size")), "vector-leads")
    one = placed.withColumn("__one", F.lit(1).cast("long"))
    ranked = running_total(one, [F.col("lead"), F.col("node")], "__one", "place", "group", "vector-order")
    width = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(NUMBERS) / F.col("size"))))
    ranked = materialise(ranked.withColumn("block", F.floor((F.col("place") - 1) / width)).drop("place", "__one", "group"), "vector-blocks")
    ends = ranked.groupBy("label", "size", "block").agg(F.min("lead").alias("least"), F.max("lead").alias("most"))
    # Blocks follow the first component, so the partners of a block are a range of blocks: those whose least is within reach of its
    # most, and the other way round. Least and most ascend with the block, so each end is found by merging the two orders.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    marks = ends.select("label", "size", F.col("least").alias("at"), F.lit(0).alias("kind"), "block").unionByName(
        ends.select("label", "size", (F.col("most") + reach).alias("at"), F.lit(1).alias("kind"), "block"))
    order = Window.partitionBy("label", "size").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("high", F.max(F.when(F.col("kind") == 0, F.col("block"))).over(order)).filter("kind = 1")
    return ranked.drop("lead").join(last.select("label", "size", "block", "high"), ["label", "size", "block"])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row.

    Rows of equal labels and vectors of equal length link at a cosine of ``threshold`` or more; ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, the row's own included, and ``kept`` says whether it
    is the row's own. Rows without a label and vectors that are null, empty, zero or hold a null or a number that is not finite
    have no link. Equal vectors of one label are compared once and counted as often as they stand there. Rows with equal ids are
    different rows; null ids come last and name a component only if it has no other; an empty table gives an empty
    result; other columns are not read.
    """
    own = pick(rows, id_col, vector_col, label_col).toDF("id", "vector", "label")
    keyed = materialise(with_key(own, "id", tie=None), "vectors")
    able = keyed.filter(valid("label", "vector"))
    nodes = materialise(able.groupBy("label", "vector").agg(F.min("__key").alias("node"), F.count("*").alias("copies"))
                        .withColumn("size", F.size("vector")), "vector-nodes")
    axes = fit_axes(nodes, "vector", "node")
    placed = blocks(nodes, axes, threshold, block)
    # A pair of blocks belongs to the lower one, so a block's vectors go to the blocks from its own on, and to it come those before.
    spread = placed.withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence("block", "high")))
    before = placed.select("label", "size", "block", "high").distinct().select(
        "label", "size", F.col("block").alias("a"), F.explode(F.sequence("block", "high")).alias("block")).filter("a < block")
    columns = ["label", "size", "a", "b", "block", "node", "copies", "vector"]
    guests = placed.join(before, ["label", "size", "block"]).withColumn("b", F.col("block"))
    both = spread.select(*columns).unionByName(guests.select(*columns))

    def work(table: pa.Table) -> pa.Table:
        return compare_blocks(table, threshold, axes, tile)

    with batch_rows(rows.sparkSession, 4096):
        met = materialise(both.groupBy("label", "size", "a", "b").applyInArrow(work, "node long, links long, root long"), "vector-links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "node", "left").join(roots, "node", "left").select(
        "label", "vector", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    of_root = keyed.select(F.col("__key").alias("root"), F.col("id").alias("component_id"))
    named = named.join(of_root, "root").select("label", "vector", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    found = able.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = keyed.filter(~valid("label", "vector")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same in DuckDB, pair by pair, for vectors of equal length.
SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, seen) as (select vec_id, vec_id from embeddings union select r.vec_id, p.b from r join p on p.a = r.seen),
c as (select vec_id, min(seen) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n_links from p group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""
