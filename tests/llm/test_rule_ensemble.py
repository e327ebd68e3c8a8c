from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from martloom.llm import rule_ensemble
from martloom.llm.rule_ensemble import Ensemble, FitRules, Rule

DOCS = "doc_id long, text string, lang string, score double, stat_letters int, words_ string"
LABELS = "doc_id long, quality int, toxic int, text string"


def documents(n=600):
    rng = random.Random(5)

    def prose(k):
        return " ".join("".join(rng.choices("aeionrst", k=rng.randint(1, 8))) for _ in range(k))

    kinds = [
        lambda k: prose(k),
        lambda k: " ".join(f"{w}$$#" for w in prose(k).split()),
        lambda k: prose(k).upper() + "!!",
        lambda k: "same " * k,
    ]
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 0, 0, 1, 2, 3])
        rows.append((i, kinds[kind](rng.randint(15, 300)), "en", 0.5, 1, "clash"))
        labels.append((i, int(kind == 0), 0, "clash"))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = documents()
    odd = [(None, None), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "#" * 100_000), (-5, "word " * 60_000), (7, rows[7][1])]
    docs = spark.createDataFrame([*rows, *((i, t, None, 0.0, 0, "") for i, t in odd)], DOCS)
    more = [(None, 0, 0, ""), (999_999, 1, 0, ""), (3, None, 0, ""), (0, 0, 0, "")]
    known = spark.createDataFrame([*labels, *more], LABELS)
    return rows, labels, rule_ensemble.score(docs, known).collect()


def test_held_out_documents_are_told_apart(scored):
    rows, labels, found = scored
    assert len(found) == len(rows) + 7
    for row in found:
        if row.doc_id is not None:
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
    quality = {i: q for i, q, *_ in labels}
    checked = [(r.predicted, quality[r.doc_id]) for r in found if r.held_out and r.doc_id in quality]
    assert len(checked) > 150 and sum(p == q for p, q in checked) / len(checked) >= 0.97
    # rows of one text and id are scored alike
    assert len({r.score for r in found if r.doc_id == 7}) == 1
    assert len({r.score for r in found if r.doc_id in (None, -1, -2)}) == 1


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = documents(200)
    docs = spark.createDataFrame(rows, DOCS)
    twisted = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t, x) for i, q, t, x in labels]
    found = [
        {r.doc_id: r.score for r in rule_ensemble.score(docs, spark.createDataFrame(known, LABELS)).collect()}
        for known in (labels, twisted)
    ]
    assert found[0] == found[1]


def test_given_labels_are_learnt(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    joined = rule_ensemble.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.predicted for r in joined if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) >= 0.97 and bad.count(0) / len(bad) >= 0.9


@pytest.mark.parametrize("labels", [[], [(0, 1, 0, ""), (2, 1, 0, "")], [(0, None, 0, "")]])
def test_one_kind_of_label_gives_one_score(spark, labels):
    docs = spark.createDataFrame(documents(5)[0], DOCS)
    usable = [q for i, q, *_ in labels if q is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    expected = (sum(usable) + 1) / (len(usable) + 2)
    found = rule_ensemble.score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 5 and all(math.isclose(r.score, expected) for r in found)


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert rule_ensemble.score(*empty).count() == 0


DESCRIPTION = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 2.0E-4)
     Predict: 0.0
    Else (feature 1 > 2.0E-4)
     Predict: 1.0
"""


def test_paths_become_rules():
    a, b = ("a", False), ("a", True)
    assert [r.bounds for r in rule_ensemble.tree_rules(DESCRIPTION, ["a", "b"])] == [
        ((*a, 0.5),),
        ((*a, 0.25),),
        ((*a, 0.5), (*b, 0.25)),
        ((*b, 0.5),),
        (("b", False, 2.0e-4),),
        (("b", True, 2.0e-4),),
    ]


def test_compiled_score_is_the_logistic_sum(spark):
    rules = [Rule((("a", False, 0.5), ("a", True, 0.25)), 2.0), Rule((("b", True, 1.0),), -3.5)]
    values = [(0.3, 2.0), (0.25, 2.0), (0.5, 1.0), (0.9, 0.0)]
    df = spark.createDataFrame(values, "a double, b double")
    found = [r.s for r in df.select(Ensemble(0.25, rules).score().alias("s")).collect()]
    for (a, b), s in zip(values, found, strict=True):
        total = 0.25 + 2.0 * (0.25 < a <= 0.5) - 3.5 * (b > 1.0)
        assert math.isclose(s, 1 / (1 + math.exp(-total)))


def test_trees_over_a_bounded_sample_repeat(spark):
    rows, labels = documents(300)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    rules = FitRules(sample=100, trees=5)
    runs = [rule_ensemble.score(d, known, rules).orderBy("doc_id").collect() for d in (docs, docs.repartition(7, F.rand(1)))]
    assert runs[0] == runs[1]
