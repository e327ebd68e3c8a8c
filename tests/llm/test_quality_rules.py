from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from martloom.llm import quality

DOCS = "doc_id long, text string, lang string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e",
    "a b c d e a b c d e f",
    "x " * 40,
    "same line\nother\nsame line\n\n \nsame line",
    "# * $ % & | < > plain",
    "été \U0001f600  joined words",
    "p q r s t u v p q r s t x y p q r s t",
    "w" * 50_000 + " " + "long text " * 20_000,
]


def test_base_counts_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(TEXTS)], DOCS)
    rows = quality.judge(docs, spark.createDataFrame([], LABELS)).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        if len(text or "") < 10_000:
            assert tuple(row)[1:6] == counts(text), text
        failed = row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words
        assert row.base_failed == failed and row.kept == (not failed)
    assert rows[-1].n_words == 40_001 and rows[-1].n_repeat_words == 40_000


def exact_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 300), (2, 400), (5, 900), (30, 3_000), (7, 7)]
    df = spark.createDataFrame(cases, "k long, n long").select(
        "k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")
    )
    for row in df.collect():
        expected = 1.0 if row.k >= 0.02 * row.n else exact_tail(row.k, row.n, 0.02)
        assert row.p == pytest.approx(expected, rel=1e-9)


def labelled(spark, good, bad, overlap=0):
    """Good rows score 0, bad ones 200; `overlap` good rows in a hundred score like bad ones."""
    rows = [("en", 1, i % 2, 200 if i // 2 % 100 < overlap else 0, 0, 0) for i in range(good)]
    rows += [("en", 0, i % 2, 200, 0, 0) for i in range(bad)]
    return spark.createDataFrame(rows, "stratum string, good int, half int, symbol int, line int, repeat int")


def test_cutoffs_need_enough_proof(spark):
    rules = quality.QualityRules()
    few = quality.certified_cutoffs(labelled(spark, 60, 20), rules)
    assert few.count() == 0
    many = quality.certified_cutoffs(labelled(spark, 1_600, 100), rules).collect()
    assert [(r.stratum, r.score, r.cutoff) for r in many] == [("en", "symbol", 99)]


def test_a_harmful_cutoff_is_not_certified(spark):
    risky = labelled(spark, 1_600, 4_000, overlap=6)
    rules = quality.QualityRules(good_weight=1)
    # what stays is the step before: it rejects nothing that was seen
    assert [r.cutoff for r in quality.certified_cutoffs(risky, rules).collect()] == [200]


def test_judge_and_keep_agree_and_keep_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    junk = " ".join(f"w{i}#$%" for i in range(30))
    rows = [(i, f"{good} {i}", "en", "x") for i in range(1_600)]
    rows += [(i, f"{junk} {i}", "en", "x") for i in range(1_600, 1_900)]
    rows += [(None, good, None, "x"), (5_000, None, "en", None), (5_000, None, "en", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, int(i < 1_600), 0) for i in range(1_900)] + [(None, 1, 0), (1_601, 1, 0), (9_999, 0, 0), (3, None, 0)]
    labels = spark.createDataFrame(labels, LABELS)
    judged = quality.judge(docs, labels)
    assert judged.count() == len(rows)
    assert {r.doc_id for r in judged.where("not kept").collect()} == {*range(1_600, 1_900), 5_000}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 1_601 and kept.where("n_words = 'x'").count() == 1_601


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert quality.judge(docs, labels).count() == 0
    assert quality.keep_good(docs, labels).count() == 0
