"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents that the one before kept, and its output is written and read again before the next
stage starts, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetmill.llm import langid, mixing, pieces, pii, simhash
from packetmill.llm.common import documents, pick, tuned, with_key
from packetmill.llm.queries import PIECES
from packetmill.session import materialise, passing_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not expressible in SQL: trained models, sketches and a tokenizer.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letters, or unlike all languages of the labelled documents."""
    docs = pick(docs, *COLUMNS)
    tuned(spark)
    found = langid.predict(docs, langid.fit(docs, F.lit(True)))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    tuned(spark)
    rows = with_key(pick(docs, *COLUMNS))
    groups = simhash.similar_groups(rows, "__key", "text", words=5, similarity=0.8)
    gone = materialise(groups.filter("root <> __key").select("__key"), "near-duplicates")
    return rows.join(gone, "__key", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the text."""
    docs = pick(docs, *COLUMNS)
    tuned(spark)
    found = pii.detect(docs, pii.fit(docs), with_mask=True)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source",
                        F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.char_length("masked")).cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources at weights 5, 2, 1 holds it: zero to three times."""
    tuned(spark)
    rows = with_key(pick(docs, *COLUMNS))
    copies = mixing.mix(rows, "__key").filter("copies > 0").select("id", "copies")
    return (rows.join(copies, F.col("__key") == F.col("id"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with byte spans, and the text they decode to."""
    tuned(spark)
    return pieces.encode_documents(pick(docs, *COLUMNS), PIECES)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. A stage's own tables go when its output is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with passing_tables(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
