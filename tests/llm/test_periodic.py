import hashlib
import random
import zlib

import numpy as np
import pytest

from packetmill.llm import periodic, queries


def brute(w, copies=4, shortest=6):
    """All runs of a list of words, period by period and place by place."""
    out = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(shortest, copies * q) and not any(
                    all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k = rng.choice([1, 2, 3, 10])
    word = lambda: rng.randrange(1, k + 1)
    w = [word() for _ in range(rng.randrange(0, 25))]
    for _ in range(rng.randrange(0, 4)):
        w += [word() for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8) + [word() for _ in range(rng.randrange(0, 4))]
    return w * 4 if rng.random() < 0.2 else w


@pytest.mark.parametrize("longest", [1, 2, 4, 1 << 15])
def test_runs_like_brute_force(monkeypatch, longest):
    monkeypatch.setattr(periodic, "LONGEST", longest)
    rng = random.Random(longest)
    for _ in range(250):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        ends = np.cumsum([len(d) for d in docs])
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), ends)
        expected = [(s + at, n, q) for d, at in zip(docs, ends - [len(d) for d in docs]) for s, n, q in brute(d)]
        assert [tuple(r) for r in got.tolist()] == expected


def test_blocks_stand_where_nothing_differs():
    rng = np.random.default_rng(1)
    for length in (1, 2, 8, 64):
        blocks, windows = rng.integers(1, 3, (50, length)), rng.integers(1, 3, (50, 2 * length))
        for i in range(0, 50, 3):
            at = rng.integers(0, length)
            windows[i, at:at + length] = blocks[i]
        got = periodic.zero_mismatch(blocks.astype(np.uint64), windows.astype(np.uint64))
        for i in range(50):
            assert got[i].tolist() == [(windows[i, t:t + length] == blocks[i]).all() for t in range(length)]


def test_transform_and_back():
    rows = np.random.default_rng(2).integers(0, periodic.PRIME, (3, 64)).astype(np.uint64)
    assert (periodic.back(periodic.transform(rows)) == rows).all()


def test_a_sum_that_vanishes_modulo_the_prime_only_is_no_run():
    p = periodic.PRIME
    w = [1, p - 1, 1, p - 1, 2, 2, 2]  # squares of 1 and p - 1 agree, differences do not
    assert periodic.find_runs(np.array(w, np.int64), np.array([len(w)])).tolist() == []


def test_long_texts_and_nested_runs():
    for w in ([1] * 50_000, ([1] * 300 + [2]) * 20, ([1, 2, 1] * 40 + [3]) * 5):
        got = periodic.find_runs(np.array(w, np.int64), np.array([len(w)]))
        if len(w) < 10_000:
            assert [tuple(r) for r in got.tolist()] == brute(w)
        else:
            assert got.tolist() == [[0, len(w), 1]]


def test_no_words():
    assert len(periodic.find_runs(np.empty(0, np.int64), np.array([0, 0]))) == 0
    assert len(periodic.find_runs(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def plain(doc_id, text):
    """One row of the query, written out."""
    w = (text or "").encode().split()
    if w and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def test_query_like_brute_force(spark, frame, odd, tmp_path):
    rng = random.Random(5)
    texts = [(100 + i, " ".join(rng.choice("abc") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    texts += [(200 + i, "a b " * i + "\x85 x\x0by\x0bx y x y\nx y " + "é日 " * i) for i in range(40)]
    rows = texts + [r for r in odd if not r[1] or len(r[1]) < 1000]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    expected = [plain(*r) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(r[1] for r in got) > 100


def test_odd_rows_clashing_columns_and_empty_table(spark, frame, odd):
    rows = frame(odd).withColumnRenamed("n_tokens", "runs")
    out = periodic.with_runs(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "runs", "collapsed"]
    by = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(odd)
    assert by[1, None]["runs"] == [] and by[1, None]["collapsed"] == "" and by[3, " \n\t"]["n_words"] == 0
    assert by[6, "word " * 30000]["collapsed"] == "word"
    assert [tuple(r) for r in by[6, "word " * 30000]["runs"]] == [(0, 30000, 1)]
    assert periodic.with_runs(frame([(1, "a")]).filter("false")).count() == 0


def test_every_planted_tail_of_the_smallest_table_is_found(spark):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    planted = 0
    for doc_id, text in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
        if h % 10 == 0 and n:
            a, copies = (h // 10) % n, 3 + (h // 10) % 8
            planted += n - a >= 40 and copies >= 5
            if n - a >= 40 and copies >= 5:
                assert got[doc_id]["n_runs"] >= 1
    assert planted
