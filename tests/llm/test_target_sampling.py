import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from packetmill.llm import target_sampling as ts


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


def brute(rows, target, percent=25, min_words=20, seed=7, buckets=ts.BUCKETS):
    s = Counter(bucket(f, buckets) for _, t in rows for f in features(t))
    t = Counter(bucket(f, buckets) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, (len(f) + 1) // 2, len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


TARGET = ["question about naïve Bayes and 日本語 text", None, "", "another Question, with 3rd parts_and-signs", "word word word"]
ROWS = [(i, " ".join(f"w{i * j % 17} Über{j % 3}" for j in range(i % 40)) + (" question about naïve bayes" if i % 7 == 0 else ""))
        for i in range(120)]


@pytest.mark.parametrize("buckets", [ts.BUCKETS, 3])
def test_like_brute_force(spark, frame, odd, buckets):
    rows = ROWS + odd + [(5, "A b\x00c\x7fd " * 30), (5, "A b\x00c\x7fd " * 30)]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = ts.resample(frame(rows), target, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, TARGET, buckets=buckets)


def test_equal_scores_go_by_id(spark, frame, monkeypatch):
    text = "same words for all of them " * 5
    monkeypatch.setattr(ts.F, "sha2", lambda column, bits: ts.F.lit("0" * 64))
    got = ts.resample(frame([(i, text) for i in range(40)]), spark.createDataFrame([("x",)], "text string"))
    assert sorted((r["doc_id"], r["rank"]) for r in got.collect() if r["rank"]) == [(i, i + 1) for i in range(10)]


def test_target_words_raise_the_weight(spark, frame):
    rows = [(i, "plain filler sentence about nothing " * 6) for i in range(30)] + [(100 + i, "question about naïve bayes " * 6) for i in range(5)]
    got = {r["doc_id"]: r["weight"] for r in ts.resample(frame(rows), spark.createDataFrame([(t,) for t in TARGET], "text string")).collect()}
    assert min(got[100 + i] for i in range(5)) > max(got[i] for i in range(30))


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "text string")
    assert ts.resample(frame([(1, "a")]).filter("false"), none).count() == 0
    assert ts.resample(frame(ROWS), none).count() == len(ROWS)


def test_kernels_take_texts_apart():
    texts = ["Ab cd ab", None, "...", "cd", "ab cd"]
    owner, feature, bucket_of = ts.hashed_features(pa.array(texts))
    got = Counter((int(o), int(bucket_of[f])) for o, f in zip(owner, feature))
    assert got == Counter((i, bucket(f, ts.BUCKETS)) for i, t in enumerate(texts) for f in features(t))
