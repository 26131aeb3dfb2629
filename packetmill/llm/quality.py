"""Quality rules: counts of one text, and lines that too many documents of a host share.

Only column expressions, aggregates and joins: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetmill.llm.common import SPACE, WORD, with_key
from packetmill.session import materialise

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is frequent in a host above so many documents and above this share of them.
MIN_DOCUMENTS, MAX_SHARE = 20, 0.005
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.5


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words word_chars n_symbols n_dup_lines n_repeat_words``; a null text counts as empty.

    Words in repeated three-word windows: window hashes are sorted with their places, neighbours with
    equal hashes are repeats, and the places of the repeats, each three words wide, are measured as a
    union. Texts whose hashes all differ stop before the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__w", split_words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumn("__l", lines).withColumn("__h", F.when(F.size("__w") > 2, F.slice(F.transform(
        "__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))),
        F.lit(1), F.size("__w") - 2)).otherwise(F.array().cast("array<bigint>")))
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))

    def beside(e, j):
        return (F.coalesce(e["h"] == F.get("__s", j - 1)["h"], F.lit(False))
                | F.coalesce(e["h"] == F.get("__s", j + 1)["h"], F.lit(False)))

    out = out.withColumn("__p", F.array_sort(F.transform(F.filter("__s", beside), lambda e: e["i"])))
    widths = F.transform("__p", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("__p", k - 1), F.lit(-3))))
    return out.select(
        *[c for c in docs.columns],
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def normalised(line: Column) -> Column:
    """Lower case, digit runs as one 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"[{SPACE}]+", " "))


def host_lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``(__key, host, copy, pos, line, words)`` per line with a word. ``copy`` is equal for equal texts."""
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col)), F.lit("n"))
    return (docs.select("__key", host.alias("host"), F.xxhash64(text_col).alias("copy"),
                        F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
            .filter(F.col("raw").rlike(f"[^{SPACE}]"))
            .select("__key", "host", "copy", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"),
                    F.regexp_count("raw", F.lit(WORD)).cast("long").alias("words")))


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """``(host, line)`` of the lines that more distinct documents of the host have than its limit.

    Copies of a text are one document here: copies are for a deduplicator to judge. Both counts are combined
    before they are shuffled, so a line in every document of a host is no hot key.
    """
    seen = lines.groupBy("host", "line", "copy").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n"))
    whole = lines.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    return (seen.filter(F.col("n") > min_documents).join(whole, "host")
            .filter(F.col("n") > F.col("docs") * max_share).select("host", "line"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """Counts, verdict and remaining text of every row.

    Returns ``id_col``, the counts, ``base_failed``, ``n_lost_lines``, ``n_left_words``, ``kept`` and ``kept_text`` (the
    text without frequent lines). A document is rejected if its base rules fail or if less than ``left_share``
    of its words are left. Null hosts are a host of their own; null and empty texts have no lines and
    fail the base rules; repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = with_key(docs.select(id_col, text_col, host_col), id_col, tie=text_col)
    lines = materialise(host_lines(rows, text_col, host_col), "host-lines")
    lost = (lines.join(frequent_lines(lines, min_documents, max_share), ["host", "line"])
            .groupBy("__key").agg(F.sum("words").alias("lost"), F.collect_list("pos").alias("gone")))
    counted = text_counts(rows, text_col)
    n = F.col("n_words")
    kept_lines = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(
        F.coalesce("gone", F.array().cast("array<int>")), i))
    out = counted.join(lost, "__key", "left").withColumn("n_left_words", n - F.coalesce("lost", F.lit(0)))
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_lost_lines"), "n_left_words",
        (~failed & (F.col("n_left_words") >= n * left_share)).alias("kept"),
        F.array_join(kept_lines, "\n").alias("kept_text"))


SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, text as raw from documents),
w as (select doc_id, text, source, raw, regexp_extract_all(text, '{WORD}') as w from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
r as (select doc_id, count(distinct p) as n_repeat_words
      from (select doc_id, unnest([i, i + 1, i + 2]) as p
            from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1) group by doc_id),
l as (select doc_id, coalesce('h' || source, 'n') as host, md5(raw) as copy, line, 
             len(regexp_extract_all(line, '{WORD}')) as words,
             trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[{SPACE}]+', ' ', 'g'), ' ') as norm
      from (select doc_id, source, raw, unnest(string_split(raw, chr(10))) as line from w where raw is not null)
      where regexp_matches(line, '[^{SPACE}]')),
f as (select host, norm from
        (select host, norm, count(distinct copy) as n from l group by all)
        join (select host, count(distinct copy) as docs from l group by all) using (host)
      where n > {MIN_DOCUMENTS} and n > docs * {MAX_SHARE}),
lost as (select doc_id, sum(words)::bigint as lost, count(*) as n_lost_lines from l join f using (host, norm) group by doc_id),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l group by doc_id),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, '')) ::bigint as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lost_lines, 0)::bigint as n_lost_lines,
             len(w) - coalesce(lost, 0) as n_left_words
      from w left join r using (doc_id) left join lost using (doc_id) left join dup using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         and n_left_words >= n_words * {LEFT_SHARE} as kept,
       n_lost_lines, n_left_words
from b
"""
