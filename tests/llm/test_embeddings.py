import math
import random

import numpy as np
import pytest

from packetmill.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<double>, label int, links string, n_links int"


def brute(rows, threshold):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = (np.ldexp(x, -math.frexp(max(map(abs, x)))[1]) for x in (a, b))  # a power of two: nothing is rounded
        return float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))

    n = len(rows)
    near = [[j for j in range(n) if j != i and fine(*rows[i][1:]) and fine(*rows[j][1:]) and rows[i][2] == rows[j][2]
             and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def check(spark, rows, threshold, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = em.near_duplicates(df, threshold=threshold, **sizes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, threshold)


ODD = [(900, None, 1), (901, [0.0, 0.0, 0.0], 1), (902, [1.0, None, 0.0], 1), (903, [1.0, math.nan, 0.0], 1),
       (904, [math.inf, 0.0, 0.0], 1), (905, [], 1), (906, [1.0, 0.0, 0.0], None), (907, [1e300, 1e300, 0.0], 1),
       (908, [1e-300, 1e-300, 0.0], 1), (909, [3.0, 3.0], 1), (909, [3.0, 3.0], 1), (None, [2.0, 2.0], 1), (None, [0.0, 1.0], 7),
       (910, [-1.0, -1.0], 1), (911, [5.0], 1), (912, [7.0], 1), (913, [-0.0, 1.0, 0.0], 3), (914, [0.0, 1.0, 0.0], 3)]


def chains(rng, n, size):
    """Vectors around a few directions, some in chains of small turns, many copies."""
    rows = []
    for i in range(n):
        base = np.array([math.cos(i % 5), math.sin(i % 5), *[0.3 * (i % 5)] * (size - 2)])
        v = [float(x) for x in base + rng.normal(0, 0.15, size)]
        if i % 6 == 0 and rows:
            v = rows[rng.integers(len(rows))][1]
        if i % 7 == 0 and rows:
            v = [float(x) for x in np.array(rows[-1][1]) * 2 + 0.05]
        rows.append((int(n - i), v, int(i % 3)))
    return rows


@pytest.mark.parametrize("size, block, tile", [(3, 16, 8), (20, 40, 64), (40, 4096, 1024)])
def test_like_brute_force(spark, size, block, tile):
    rows = chains(np.random.default_rng(size), 160, size)
    check(spark, rows, 0.95, block=block, tile=tile)


def test_odd_rows(spark):
    check(spark, ODD, 0.98, block=2, tile=2)
    empty = spark.createDataFrame([], SCHEMA)
    assert em.near_duplicates(empty).count() == 0


def test_a_pair_at_the_threshold_links(spark):
    check(spark, [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.59, 0.81], 0)], 0.6)


def test_bound_gives_up_no_pair_and_spares_work():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 64)) * np.linspace(2, 0.1, 64)
    vectors[200:260] = vectors[:60] + rng.normal(0, 0.02, (60, 64))
    axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]
    tiles = em.Tiles(vectors, axes)
    i, j = tiles.linked(slice(0, 400), slice(0, 400), 0.98, True)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    expected = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, expected.tolist())) and len(i) >= 60
    bound = tiles.turned[:, :8] @ tiles.turned[:, :8].T + np.outer(tiles.rest[8], tiles.rest[8])
    assert (bound >= 0.98).mean() < 0.2  # most pairs end after eight of the 64 components


def test_connect_is_the_smallest_row_reachable():
    rng = random.Random(4)
    for _ in range(50):
        n = 30
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(25))]
        smallest = np.arange(n)
        for part in (pairs[:7], pairs[7:]):
            em.connect(smallest, np.array([p[0] for p in part], int), np.array([p[1] for p in part], int))
        expected = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                expected[a] = expected[b] = min(expected[a], expected[b])
        assert smallest.tolist() == expected


def test_blocks_out_of_reach_do_not_meet(spark):
    rows = [(i, [math.cos(0.01 * i), math.sin(0.01 * i)], 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = df.selectExpr("label", "embedding as vector", "vec_id as node", "1L as copies", "size(embedding) as size")
    placed = em.blocks(nodes, {2: np.eye(2)}, 0.98, 10).select("block", "high").distinct().collect()
    assert len(placed) == 15 and all(r["high"] >= r["block"] for r in placed)
    assert sum(r["high"] - r["block"] + 1 for r in placed) < 15 * 16 / 2
    check(spark, rows, 0.98, block=10, tile=8)
