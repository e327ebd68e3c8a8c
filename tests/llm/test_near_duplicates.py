from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from martloom.llm import jaccard_join, suffix_dedup
from martloom.llm.components import components

DOCS = "doc_id long, text string, tag string, node int"


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_links(texts):
    sets = [shingles(t) for t in texts]
    n = len(sets)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), links[i]) for i in range(n)]


def near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 9999)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("rules", [jaccard_join.JoinRules(), jaccard_join.JoinRules(bucket=4, depth=3, block=5)])
def test_links_equal_all_pairs(spark, rules):
    texts = near_copies(4) + ["a b c", "a b c", "a b c d", "", None, " \n", "same five words are here"] * 2
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link(docs, rules).collect()}
    assert [found[i] for i in range(len(texts))] == brute_links(texts)
    kept = jaccard_join.one_of_each(docs, rules)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in brute_links(texts)}


def test_groups_of_near_copies_are_not_split(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 9999)}"
        texts.append(" ".join(words))
    # a second group shares half of the words, and a chain leads away from the first
    texts += [" ".join([*base[:150], *(f"c{j}" for j in range(150 + i % 5))]) for i in range(40)]
    texts += [" ".join([*base[12 * i :], *(f"d{j}" for j in range(12 * i))]) for i in range(1, 8)]
    docs = spark.createDataFrame([(i, t, "", i) for i, t in enumerate(texts)], DOCS)
    rules = jaccard_join.JoinRules(bucket=8, depth=4, block=16)
    seen = []
    original = jaccard_join._group_edges
    try:
        jaccard_join._group_edges = lambda members, r: seen.append(members.count()) or original(members, r)
        found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.link(docs, rules).collect()}
    finally:
        jaccard_join._group_edges = original
    assert [found[i] for i in range(len(texts))] == brute_links(texts)
    # the groups are recognised on the first level, in most of the runs
    assert seen[0] >= 0.7 * 150 * rules.runs()


def test_few_pairs_are_compared_instead_of_split(spark, monkeypatch):
    texts = near_copies(8, groups=12, size=10)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], DOCS)
    expected = brute_links(texts)
    levels = []
    paths = jaccard_join._paths
    monkeypatch.setattr(jaccard_join, "_paths", lambda level, runs: levels.append(level) or paths(level, runs))
    for few, deeper in ((0, True), (1_000_000, False)):
        levels.clear()
        rules = jaccard_join.JoinRules(bucket=2, depth=3, block=5, few=few)
        rows = sorted(jaccard_join.link(docs, rules).collect())
        assert [(r.class_id, r.n_links) for r in rows] == expected
        assert (max(levels) > 1) == deeper


def test_edges_of_components_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (3, 1)]
    edges = spark.createDataFrame(pairs, "u long, v long").mapInArrow(counted, "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7}
    assert seen.value == len(pairs)


def test_recall_at_full_depth(spark):
    """Pairs between 0.79 and 0.83, each alone in buckets that are always split again."""
    rng = random.Random(21)
    texts, exact = [], []
    for _ in range(1_500):
        # 104 shingles; a changed end of k words leaves 104 - k of them in common
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(108)]
        k = rng.choice([10, 11, 12])
        texts += [" ".join(words), " ".join([*words[:-k], *(f"v{rng.randint(0, 10**9)}" for _ in range(k))])]
        exact.append((104 - k) / (104 + k))
    docs = spark.createDataFrame([(i, t, "", i) for i, t in enumerate(texts)], DOCS)
    rules = jaccard_join.JoinRules(bucket=1, depth=6)
    _, members, nodes = jaccard_join._nodes(docs, "doc_id", "text")
    number = {r.node: r.doc_id for r in members.collect()}
    met = {frozenset((number[r.u] // 2, number[r.v] // 2)) for r in jaccard_join.candidate_edges(nodes, rules).collect()}
    at = [frozenset((i,)) in met for i, s in enumerate(exact) if s >= 0.8]
    assert 0.78 < min(exact) and max(exact) < 0.83 and len(at) > 700
    assert sum(at) / len(at) >= 0.99


def test_null_and_repeated_ids(spark):
    text = "these are exactly six words here"
    rows = [(None, text, "", 0), (7, text, "", 0), (7, text, "", 0), (None, "alone in its own class now", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.link(docs).collect())
    assert found == {(None, 7, 2): 1, (7, 7, 2): 2, (None, None, 0): 1}
    assert jaccard_join.one_of_each(docs).count() == 2


def test_empty_join(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_join.link(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0


def test_runs_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        rules = jaccard_join.JoinRules(recall=recall)
        rng = random.Random(1)

        def meets(level, rules=rules, rng=rng):
            if level == rules.depth:
                return True
            tries = 2 if rng.random() < 0.25 else 1
            return any(rng.random() < 0.8 and meets(level + 1) for _ in range(tries))

        missed = sum(not any(meets(0) for _ in range(rules.runs())) for _ in range(3_000))
        assert missed / 3_000 <= (1 - recall) * 1.3 + 0.001


def test_runs_reach_the_recall_over_one_set_of_tokens():
    rules = jaccard_join.JoinRules()
    rng = random.Random(2)

    def meets(share, level=0):
        if level == rules.depth:
            return True
        tries = 2 if rng.random() < 0.25 else 1
        return any(rng.random() < share and meets(share, level + 1) for _ in range(tries))

    missed = 0
    for _ in range(10_000):
        share = sum(rng.random() < 0.8 for _ in range(jaccard_join.TOKENS)) / jaccard_join.TOKENS
        missed += not any(meets(share) for _ in range(rules.runs()))
    assert missed / 10_000 <= 0.002


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (300, 41)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 300: 41, 41: 41}


def brute_cut(texts, span):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                covered[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~covered])))
    return out


def passages(seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    shared, texts = some(110), []
    for i in range(60):
        text = some(rng.randint(0, 150))
        if i % 3 == 0:
            text = text + shared + some(40)
        if i % 5 == 1:
            text = rng.choice(texts)
        texts.append(text)
    return texts + ["x" * 300, "xy" * 100 + "x" * 80, None, "", "exactly" * 10]


@pytest.mark.parametrize(("span", "shard_segments"), [(80, 256), (80, 3), (70, 2)])
def test_repeats_equal_a_plain_search(spark, span, shard_segments):
    texts = passages(span)
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], DOCS)
    rows = suffix_dedup.remove_repeats(docs, span, shard_segments).orderBy("doc_id").collect()
    found = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows]
    assert found == brute_cut(texts, span)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in rows)


def test_long_texts_repeated_rows_and_columns(spark):
    long = "".join(random.Random(2).choices("abcdefgh ", k=700_000))
    rows = [(1, long, "t", 1), (2, long[300_000:301_000], "t", 2), (3, "short", "t", 3), (3, "y" * 450, "t", 3), (3, "y" * 450, "t", 3)]
    rows += [(None, "z" * 399, "t", 0), (4, None, "t", 4)]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert found == [(0, 399, 0), (1, 700_000, 1_000), (2, 1_000, 1_000), (3, 5, 0), (3, 450, 450), (3, 450, 450), (4, 0, 0)]


def brute_words(texts, span):
    """Texts without every word that a repeated window of words covers."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words = [[t[a:b] for a, b in places] for t, places in zip(texts, spans, strict=True)]
    seen = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for t, places, w in zip(texts, spans, words, strict=True):
        gone = sorted({j for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for j in range(i, i + span)})
        parts, at = [], 0
        for i, j in enumerate(gone):
            if i == 0 or gone[i - 1] != j - 1:
                parts.append(t[at : places[j][0]])
            at = places[j][1]
        out.append(None if t is None else "".join(parts) + t[at:])
    return out


@pytest.mark.parametrize(("span", "shard_segments"), [(51, 256), (51, 2), (12, 3)])
def test_word_repeats_equal_a_plain_search(spark, span, shard_segments):
    rng = random.Random(span)

    def some(n):
        return "".join(rng.choice("aéb") + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))

    def prose(n):
        return " ".join(f"wé{rng.randint(0, 999)}" for _ in range(n))

    planted = [prose(n) for n in range(51, 61)]
    texts = [f"{prose(rng.randint(0, 90))} {planted[i % 10]}\n{prose(rng.randint(0, 90))}" for i in range(25)]
    texts += [prose(50), prose(70), None, "", "one " * 200, some(150), some(140), f"{planted[0]} {planted[0]}", prose(20_000)]
    texts += [texts[-1][500:9_000], texts[0], planted[3].upper()]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], DOCS)
    found = suffix_dedup.without_repeats(docs, span, shard_segments).orderBy("doc_id")
    assert found.columns == docs.columns
    assert [r.text for r in found.collect()] == brute_words(texts, span)
    assert suffix_dedup.without_repeats(docs.where("doc_id = 26"), span).first().text == texts[26]


def test_one_letter(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b" * 400)], "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == {1: (300_000, 1), 2: (0, 0)}


def test_empty_cut(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_arrays_sort_suffixes():
    for seed in range(5):
        data = np.random.default_rng(seed).integers(97, 97 + 1 + seed, 300).astype(np.uint8)
        order, rank = suffix_dedup.suffix_array(data, 400)
        text = data.tobytes()
        assert order.tolist() == sorted(range(300), key=lambda i: text[i:])
        assert (rank[order] == np.arange(300)).all()
