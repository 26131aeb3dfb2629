import re

import duckdb
import pytest

from packetmill.llm import quality

SCHEMA = "doc_id long, text string, source string, host string, n_words string, line string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def rows(odd):
    out = [(i, t, "s") for i, t in odd]
    body = "\n".join(f"line {chr(97 + k)} of a text that is long enough to be kept here" for k in range(6))
    for i in range(60):
        own = f"words of {chr(97 + i % 26)}{chr(97 + i // 26)} alone " * 1 + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{k // 26 * 'x'}" for k in range(60))
        out.append((100 + i, f"All rights   RESERVED {i}\n{own}", "host1"))
        out.append((200 + i, "Menu a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll\n" + own[:80 + i], "host1"))
        out.append((300 + i, body, None if i % 2 else "host1"))
    return out


def test_counts_and_verdict_like_sql_and_brute_force(spark, rows):
    unique = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in unique], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t, _ in unique:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
    documents = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    rel = con.sql(quality.SQL)
    want = {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    assert all(getattr(got[i], c) == v for i, w in want.items() for c, v in w.items())
    lost = [r for r in got.values() if r.n_lost_lines]
    assert lost and any(not r.kept and not r.base_failed for r in lost)
    assert all("reserved" not in r.kept_text.lower() for r in lost)
    copies = [got[k] for k, (i, _, _) in enumerate(rows) if i is not None and 300 <= i < 360]
    assert all(r.n_lost_lines == 0 and r.n_left_words == r.n_words for r in copies)


def test_odd_rows(spark, frame, odd):
    got = quality.judge(frame(odd)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd)
    assert not any(r.kept for r in got if r.n_words < 50)
    assert quality.judge(frame(odd).limit(0)).count() == 0


def test_native_plan(frame, odd):
    plan = quality.judge(frame(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
