"""The pipeline against one-document-at-a-time versions of its stages."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from packetmill.llm import langid, mixing, pii, simhash
from packetmill.llm.tagger import Tagger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, ROOT int, copies string"
STEMS = {"en": "the and of ing tion er ly that".split(), "de": "der die und ung sch keit ein ver".split()}


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(12), []
    for i in range(240):
        lang = rng.choice(list(STEMS))
        w = ["".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(60, 300))]
        if i % 4 == 0:
            w.insert(7, f"me.{i}@mail.example.com")
            w.insert(19, "10.0.3.4")
        out.append((3 * i, " ".join(w), lang, f"s{i % 4}"))
    copies = []
    for i, text, lang, source in out[:60]:
        w = text.split()
        if i % 2:
            w[len(w) // 2] = "changed"
        copies.append((3 * i + 1000, " ".join(w), lang, "s0"))
    return out + copies


@pytest.fixture(scope="module")
def docs(spark, rows):
    odd = [(9000, None, None, None), (9001, "", "en", "s1"), (9002, "12 34 !!", "en", "s1"), (None, "no id the and of ing", None, None),
           (9003, "the and of tion", "en", None), (9003, "the and of tion", "en", None), (9004, "thatly " * 20_000, "en", "s2")]
    full = [(i, t, lang, s, None if t is None else len(t), "e", 1, "c") for i, t, lang, s in rows + odd]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def key(r):
    return str((r.doc_id, r.text, r.lang, r.source, r.n_chars))


def test_language_stage(spark, docs):
    kept = cp.known_language(spark, docs, "").collect()
    model = langid.LanguageModel.load(langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True)))
    want = [r for r in docs.collect() if not model.predict(r.text or "")[2]]
    assert sorted(map(key, kept)) == sorted(map(key, want))
    assert {r.doc_id for r in kept}.isdisjoint({9000, 9001, 9002}) and len(kept) > 290


def test_near_duplicate_stage(spark, docs, rows):
    kept = cp.without_near_duplicates(spark, docs, "").collect()
    ids = [r.doc_id for r in kept]
    sets = {i: shingles(t) for i, t, _, _ in rows}
    by_id = sorted(sets)
    first = {i: next(j for j in by_id if j == i or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in by_id}
    assert sorted(i for i in ids if i is not None and i < 9000) == sorted(set(first.values()))
    assert ids.count(9003) == 1 and [i for i in ids if i in (9000, 9001)] == [9000]
    assert cp.without_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_groups_are_those_of_all_pairs(spark):
    """Families of edited copies, short and long ones: the same groups as comparing all shingle sets."""
    rng, texts = random.Random(9), []
    for family in range(25):
        w = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(8)):
            v = list(w)
            for _ in range(rng.randrange(1, max(2, len(w) // 20))):
                v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    texts += ["", "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    got = {r.k: r.root for r in simhash.similar_groups(docs, "k").collect()}
    sets, parent = [shingles(t) if t.strip() else set() for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if not whole or len(sets[i] & sets[j]) / whole >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(texts))}
    assert all(want[i] == want[r] for i, r in got.items())  # nothing is joined that should not be
    assert sum(want[i] == r for i, r in got.items()) >= 0.97 * len(texts)


def test_sketch_distance_follows_similarity():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(800)]
    for share, close in ((0.99, True), (0.3, False)):
        other = words[:int(800 * share)] + ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(800 - int(800 * share))]
        a, b = (simhash.sketch(" ".join(w), 5, simhash.SKETCH_SEEDS) for w in (words, other))
        assert (sum(bin(x ^ y).count("1") for x, y in zip(a, b)) <= simhash.most_bits(0.8)) == close


def test_personal_data_stage(spark, docs):
    out = {key(r): r for r in docs.collect()}
    got = cp.without_personal_data(spark, docs, "").collect()
    tagger = Tagger.load(pii.fit(docs.select("doc_id", "text")))
    want = []
    for r in out.values():
        spans = pii.all_spans(pii.base_spans(r.text or ""), pii.found_spans(tagger, [r.text or ""])[0])
        text = None if r.text is None else pii.masked(r.text, spans)
        want.append(str((r.doc_id, text, r.lang, r.source, None if text is None else len(text))))
    assert sorted(set(map(key, got))) == sorted(want) and len(got) == docs.count()
    assert not any("@mail" in (r.text or "") for r in got)


def test_mixing_stage(spark, docs):
    taken = {}
    for r in cp.mixed_sources(spark, docs, "").collect():
        taken[key(r)] = taken.get(key(r), 0) + 1
    assert max(taken.values()) <= 6  # three times each of two equal rows
    plan = {r.id: r for r in mixing.mix(docs.filter("doc_id < 9000").select("doc_id", "text", "source")).collect()}
    some = cp.mixed_sources(spark, docs.filter("doc_id < 9000"), "").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in some} == {i: p.copies for i, p in plan.items() if p.copies}


def test_run(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        assert r.n_tokens == len(sp.encode(r.text)) + 2 and "@mail" not in r.text
    assert len({r.doc_id for r in got}) <= 242 and len(got) > 150
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "encoding"]


def test_stages_on_nothing(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
