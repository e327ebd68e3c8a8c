"""Quality rules whose cutoffs are certified on labelled holdouts.

Every document gets five base counts. Three ratios of them (symbols to word characters,
repeated lines to lines, repeated words to words, in thousandths) are scores: a document
whose score lies above its stratum's cutoff is rejected. A cutoff is proposed on one half
of the labelled documents and tested on the other: it takes effect only if an exact
binomial bound shows, at the family-wise error `delta` shared by all strata and scores,
that it rejects at most `risk / scores` of the good documents of the stratum.

Defined cases: a null text has no words and fails the base rule; a null label or a label
of an unknown document is not used; a document labelled twice counts as good only if both
labels say so; a null stratum is a stratum of its own; repeated rows are judged each; with
no usable labels no cutoff is certified and only the base rule rejects. Extra columns pass
through; columns that clash with the added ones are replaced in the result of `judge` and
left alone by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import SPACE, distinct_names, stage, words_of

SCORES = ("symbol", "line", "repeat")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    """Base limits, the tolerated false rejection per stratum, and the error of the proof."""

    min_words: int = 10
    max_repeat_percent: int = 20
    risk: float = 0.05
    delta: float = 0.05
    good_weight: int = 20


def _repeat_words(windows: Column) -> Column:
    """Words covered by five-word windows that occur twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.transform(
            F.array(starts),
            lambda s: F.aggregate(
                F.transform(s, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - p, F.lit(5)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )[0]

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = F.transform(F.array(ordered), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(counted)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five base counts; everything stays in one pass over the rows."""
    words, windows, lines = distinct_names(docs, "words_", "windows_", "lines_")
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            words: words_of(F.col(text)),
            lines: F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )

    def window(i: Column) -> Column:
        return F.xxhash64(F.slice(words, i, 5))

    starts = F.sequence(F.lit(1), F.size(words) - 4)
    out = out.withColumn(
        windows,
        F.when(F.size(words) >= 5, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>")),
    )
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(body, SPACE + "+", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(windows)),
            "n_lines_": F.size(lines).cast("long"),
        }
    ).drop(words, windows, lines)


def _base_failed(rules: QualityRules) -> Column:
    repeats = 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    return (F.col("n_words") < rules.min_words) | repeats


def _permille(part: str, whole: str) -> Column:
    share = F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return F.least(share, F.lit(1000)).cast("int")


def _scores() -> dict[str, Column]:
    return {
        "symbol": _permille("n_symbols", "word_chars"),
        "line": _permille("n_dup_lines", "n_lines_"),
        "repeat": _permille("n_repeat_words", "n_words"),
    }


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by ten so that its error is below 1e-12."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3))
    series = series + 1 / (1260 * F.pow(x, 5))
    shift = x - 1
    for back in range(2, 11):
        shift = shift * (x - back)
    return series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p); 1 when k is at or above the mean.

    Starts at the term of k and adds the smaller ones below it, at least twelve standard
    deviations of them, which leaves out less than a double can hold.
    """
    head = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    below = F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, add)["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), head * F.coalesce(below, F.lit(1.0))))


def certified_cutoffs(labelled: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Cutoffs (stratum, score, cutoff) from rows (stratum, good, half, symbol, line, repeat).

    Counts per stratum, score and value are at most 1,001 rows a group. On half 0 the
    cutoff with the best gain (bad documents rejected less `good_weight` times the good ones
    rejected) is proposed. On half 1 the cutoffs are tested in the fixed order from 1000
    down to the proposal; the last one before the first failure is certified, so testing
    many of them needs no further correction. The cutoff is put halfway to the next value
    seen, which rejects the same labelled documents.
    """
    values = labelled.select(
        "stratum",
        "good",
        "half",
        F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in SCORES))).alias("s"),
    ).select("stratum", "good", "half", "s.score", "s.value")

    def count(half: int, good: int) -> Column:
        return F.count(F.when((F.col("half") == half) & (F.col("good") == good), 1))

    counts = values.groupBy("stratum", "score", "value").agg(
        count(0, 1).alias("g0"), count(0, 0).alias("b0"), count(1, 1).alias("g1")
    )
    # rejected at cutoff c: values above c; cutoffs run over the observed values
    series = Window.partitionBy("stratum", "score").orderBy(F.desc("value"))
    above = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "score")
    n_strata = counts.select(F.count_distinct(F.to_json(F.struct("stratum")))).scalar()
    gain = F.col("bad_out") - rules.good_weight * F.col("good_out")
    ladder = (
        counts.withColumns(
            {
                "good_out": F.coalesce(F.sum("g0").over(above), F.lit(0)),
                "bad_out": F.coalesce(F.sum("b0").over(above), F.lit(0)),
                "k": F.coalesce(F.sum("g1").over(above), F.lit(0)),
                "n": F.sum("g1").over(whole),
            }
        )
        .withColumn("gain", gain)
        .withColumn("best", F.max(F.struct("gain", "value")).over(whole))
        .withColumn("next_value", F.lag("value").over(series))
        .where((F.col("best.gain") > 0) & (F.col("value") >= F.col("best.value")))
    )
    p = binomial_tail(F.col("k"), F.col("n"), rules.risk / len(SCORES))
    tested = ladder.withColumn("fails", (p > rules.delta / (n_strata * len(SCORES))).cast("int"))
    passed = tested.withColumn("failed", F.sum("fails").over(series)).where("failed = 0")
    last = F.min_by(F.struct("value", "next_value"), "value")
    return passed.groupBy("stratum", "score").agg(last.alias("last")).select(
        "stratum",
        "score",
        F.floor((F.col("last.value") + F.coalesce(F.col("last.next_value") - 1, F.col("last.value"))) / 2).alias("cutoff"),
    )


def _half(doc_id: Column) -> Column:
    """0 or 1 by the document's id, alike in every engine that knows MD5."""
    digits = F.substring(F.md5(F.concat(F.lit("holdout-"), doc_id.cast("string")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % 2).cast("int")


def _good(labels: DataFrame, doc_id: str) -> DataFrame:
    usable = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull())
    return usable.groupBy(F.col(doc_id).alias("label_id_")).agg(F.min(F.col("quality").cast("int")).alias("good"))


def _wide(cutoffs: DataFrame) -> DataFrame:
    limits = [F.max(F.when(F.col("score") == s, F.col("cutoff"))).alias(f"{s}_cutoff") for s in SCORES]
    return cutoffs.groupBy(F.col("stratum").alias("stratum_")).agg(*limits)


def _verdict(features: DataFrame, stratum: str, cutoffs: DataFrame, rules: QualityRules) -> DataFrame:
    joined = features.join(_wide(cutoffs), features[stratum].eqNullSafe(F.col("stratum_")), "left")
    over = F.lit(False)
    for name, score in _scores().items():
        over = over | F.coalesce(score > F.col(f"{name}_cutoff"), F.lit(False))
    failed = _base_failed(rules)
    # one comparison that needs both sides of the join: a filter on it cannot move below
    # the counts, where every use of a word list would split the text again
    kept = F.greatest(failed.cast("int"), over.cast("int")) == 0
    return joined.withColumns({"base_failed": failed, "kept": kept})


def _labelled(features: DataFrame, labels: DataFrame, doc_id: str, stratum: str, rules: QualityRules) -> DataFrame:
    known = features.join(_good(labels, doc_id), features[doc_id] == F.col("label_id_"))
    return known.where(~_base_failed(rules)).select(
        F.col(stratum).alias("stratum"),
        "good",
        _half(F.col(doc_id)).alias("half"),
        *(score.alias(name) for name, score in _scores().items()),
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    rules: QualityRules = QualityRules(),
    doc_id: str = "doc_id",
    stratum: str = "lang",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept.

    The counts are staged once, without the texts; cutoffs and verdicts read them.
    """
    bare = docs.select(doc_id, stratum, text)
    features = stage(base_counts(bare, text).drop(text), "quality")
    cutoffs = certified_cutoffs(_labelled(features, labels, doc_id, stratum, rules), rules)
    return _verdict(features, stratum, cutoffs, rules).select(doc_id, *BASE, "base_failed", "kept")


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    rules: QualityRules = QualityRules(),
    doc_id: str = "doc_id",
    stratum: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    bare = docs.select(doc_id, stratum, text)
    known = bare.join(_good(labels, doc_id).select("label_id_"), F.col(doc_id) == F.col("label_id_"), "left_semi")
    features = stage(base_counts(known, text).drop(text), "quality")
    cutoffs = stage(certified_cutoffs(_labelled(features, labels, doc_id, stratum, rules), rules), "cutoffs")
    whole = docs.select(
        F.col(doc_id).alias("doc_id_"), F.col(stratum).alias("lang_"), F.col(text).alias("text_"), F.struct("*").alias("row_")
    )
    judged = _verdict(base_counts(whole, "text_").drop("text_"), "lang_", cutoffs, rules)
    return judged.where("kept").select("row_.*")
