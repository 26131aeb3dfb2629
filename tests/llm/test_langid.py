import random

import pytest
from pyspark.sql import functions as F

from packetmill.llm import langid

STEMS = {"aa": "the and of ing tion er ly that".split(), "bb": "der die und ung sch keit ein ver".split(),
         "cc": "les des ment eau que aux ré est".split()}


def text(lang, rng, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, text(lang, rng, rng.randrange(3, 200)), lang, 9) for i in range(600) for lang in [rng.choice(list(STEMS))]]


def test_held_out_accuracy_and_rejection(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    held = langid.in_fold("doc_id", 4, 2)
    model = langid.fit(docs, ~held, per_label=120)
    got = langid.predict(docs, model).withColumn("held", held).collect()
    tested = [r for r in got if r.held]
    assert len(tested) > 100 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.98
    assert sum(r.rejected for r in tested) <= 3 and all(0 <= r.score <= 1 for r in got)
    assert model == langid.fit(docs.repartition(7), ~held, per_label=120)
    known = langid.LanguageModel.load(model)
    assert known.predict("qqxz wvkj zzkq xwvq jjkq qwwx vvkz")[2]
    assert known.predict(text("bb", random.Random(3), 4))[0] == "bb"
    long = text("cc", random.Random(3), 300_000)
    assert known.predict(long)[0] == "cc"


def test_odd_rows(spark, frame, odd, rows):
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(labelled, F.lit(True), per_label=30)
    got = langid.predict(frame(odd), model).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in odd)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in STEMS) == letters and (letters or (r.lang_pred == "und" and r.rejected))
    assert langid.predict(frame(odd).limit(0), model).count() == 0


def test_without_labels(frame, odd):
    docs = frame(odd).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()} == {"und"}


def test_fold_is_crc32_of_the_id(spark):
    import zlib
    got = spark.range(50).select("id", langid.in_fold("id", 4, 2).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
