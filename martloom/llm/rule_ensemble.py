"""A quality classifier made of weighted rules.

Shallow trees are grown on statistics of labelled texts. Every path from a root down is a
rule, the conjunction of its comparisons. A logistic regression with an L1 penalty weighs
the rules and leaves few of them. What remains is compiled into one Spark expression over
the statistics: a text's score is the logistic function of the weights of the rules it
meets. Statistics are Spark expressions over the whole text; no id, language, source or
label is among them.

The fit sees at most `sample` labelled documents, those with the least hashed ids; all
others are only scored. Texts are read once.

Defined cases: a null text has the statistics of an empty one, all 0, and is scored like any
other; a null label and a label of an unknown document are not used; a document labelled
twice counts as good only if all its labels say so; repeated rows and null ids are scored
each, null ids count as held out of the fit; if the labels in the fit are of one kind or
none, there are no rules and every score is (good + 1) / (all + 2); an empty table gives an
empty result; extra columns stay out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import distinct_names, stage, words_of

Bound = tuple[str, bool, float]  # statistic, is above (else at most), value


@dataclass(frozen=True)
class FitRules:
    """Bound of the fit, trees and their depth, the penalty, and the seed of the trees."""

    sample: int = 20_000
    trees: int = 40
    depth: int = 3
    penalty: float = 0.001
    seed: int = 17


@dataclass(frozen=True)
class Rule:
    """All bounds hold."""

    bounds: tuple[Bound, ...]
    weight: float = 0.0

    def holds(self) -> Column:
        found = F.lit(True)
        for name, above, value in self.bounds:
            found &= (F.col(name) > value) if above else (F.col(name) <= value)
        return found


@dataclass(frozen=True)
class Ensemble:
    """An intercept and rules with weights; compiles into a score column."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total += F.when(rule.holds(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def statistics(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """docs without the text, with the statistics of it, and their names."""
    body_, words_, lines_ = distinct_names(docs, "body_", "words_", "lines_")
    body, words, lines = F.col(body_), F.col(words_), F.col(lines_)

    def without(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    def chosen(letters: str) -> Column:
        return F.length(body) - F.length(F.translate(body, letters, ""))

    n_words, chars = F.size(words), F.length(body)
    found = {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": _share(chars, n_words),
        "symbols": _share(chosen("#*$%&|<>"), chars),
        "shouts": _share(chosen("!?"), chars),
        "stops": _share(chosen(".,;:"), chars),
        "capitals": _share(without(r"\p{Lu}"), chars),
        "letters": _share(without(r"\p{L}"), chars),
        "digits": _share(chosen("0123456789"), chars),
        # the number of distinct words grows about as a power of the length
        "variety": _share(F.log1p(F.size(F.array_distinct(words)).cast("double")), F.log1p(n_words.cast("double"))),
        "repeated_neighbours": _share(
            F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w)), n_words
        ),
        "bare_words": _share(F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))), n_words),
        "line_words": _share(n_words, F.size(lines)),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    names = distinct_names(docs, *(f"stat_{name}" for name in found))
    prepared = docs.withColumn(body_, F.coalesce(F.col(text), F.lit(""))).withColumns(
        {words_: words_of(F.col(text)), lines_: F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")}
    )
    counted = prepared.withColumns(dict(zip(names, found.values(), strict=True)))
    return counted.drop(body_, words_, lines_, text), names


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The paths of all trees in a forest's description, shorter ones included, each once."""
    found: dict[tuple[Bound, ...], None] = {}
    path: list[Bound] = []
    for line in description.splitlines():
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if test is None:
            continue
        indent, feature, sign, value = test.groups()
        # the first test of a tree stands four blanks in, each level one more
        del path[len(indent) - 4 :]
        path.append((names[int(feature)], sign == ">", float(value)))
        found.setdefault(_tightest(path))
    return [Rule(bounds) for bounds in found]


def _tightest(path: list[Bound]) -> tuple[Bound, ...]:
    """One bound for each statistic and side."""
    held: dict[tuple[str, bool], float] = {}
    for name, above, value in path:
        side = (name, above)
        held[side] = value if side not in held else max(held[side], value) if above else min(held[side], value)
    return tuple(sorted((name, above, value) for (name, above), value in held.items()))


def fit(labelled: DataFrame, names: list[str], rules: FitRules = FitRules()) -> Ensemble:
    """Rules and weights from rows with the named statistics and `good` (0 or 1).

    `labelled` is at most `rules.sample` rows in one partition, so that a fit repeats exactly.
    """
    good = {row.good: row["count"] for row in labelled.groupBy("good").count().collect()}
    if len(good) < 2:
        share = (good.get(1, 0) + 1) / (sum(good.values()) + 2)
        return Ensemble(math.log(share / (1 - share)))
    rows = labelled.select(F.col("good").cast("double").alias("label"), array_to_vector(F.array(*names)).alias("features"), *names)
    forest = RandomForestClassifier(
        numTrees=rules.trees, maxDepth=rules.depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=rules.seed
    ).fit(rows)
    paths = tree_rules(forest.toDebugString, names)
    if not paths:
        share = good[1] / (good[0] + good[1])
        return Ensemble(math.log(share / (1 - share)))
    met = F.array(*(rule.holds().cast("double") for rule in paths))
    weighed = LogisticRegression(elasticNetParam=1.0, regParam=rules.penalty, standardization=False).fit(
        rows.select("label", array_to_vector(met).alias("features"))
    )
    kept = [Rule(r.bounds, w) for r, w in zip(paths, weighed.coefficients.toArray().tolist(), strict=True) if w]
    return Ensemble(float(weighed.intercept), kept)


def held_out(doc_id: Column) -> Column:
    """Is the document's label kept from the fit? True for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def _labelled(features: DataFrame, labels: DataFrame, names: list[str], sample: int) -> DataFrame:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = usable.groupBy(F.col("doc_id").alias("label_id_")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    known = features.join(good, F.col("doc_id") == F.col("label_id_")).select("doc_id", "good", *names)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(sample)


def score(docs: DataFrame, labels: DataFrame, rules: FitRules = FitRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    counted, names = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    features = stage(counted, "statistics")
    labelled = stage(_labelled(features, labels, names, rules.sample), "labelled")
    ensemble = fit(labelled, names, rules)
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
