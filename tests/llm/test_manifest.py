from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from martloom.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, way string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def plain_tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def plain_way(levels, at):
    way = []
    for level in levels[:-1]:
        other = at ^ 1
        way.append((other < at, level[other]) if other < len(level) else (False, ""))
        at //= 2
    return way


def plain_audit(rows):
    strata = {}
    for row in rows:
        strata.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(*row), row))
    order = sorted(strata, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([m[2] for m in sorted(strata[k], key=lambda m: m[:3])]) for k in order}
    crown = plain_tree([trees[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(strata[k], key=lambda m: m[:3])):
            way = plain_way(trees[k], at) + plain_way(crown, place)
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = plain_leaf(*row[:4], row[4] + 1)
            for before, other in way:
                node = digest(other + node if before else node + other)
            proof = digest("".join(h for _, h in way))
            root = crown[-1][0]
            out.append((row[0], leaf, trees[k][-1][0], root, proof, node, node == root))
    return out


def rows_of(seed, langs, n):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["", "ä b", None, "x" * rng.randint(1, 50)]), rng.choice(langs), rng.choice(["s", None, "-"]), rng.choice([None, 0, 7]))
        for i in range(n)
    ]
    rows += rows[:3] + [(None, None, None, None, None), (None, "z", "hot", "s", 1), (-7, "long " * 40_000, "hot", "", 200_000)]
    rows += [(1_000 + i, f"t{i}", "hot", "s", i) for i in range(70)]
    return rows


@pytest.mark.parametrize(("seed", "langs", "bits"), [(1, ["en", "de", None, ""], 2), (2, ["é", "z", "Z", "ab"], 3), (3, ["only"], 12)])
def test_audit_equals_plain_trees(spark, seed, langs, bits):
    rows = rows_of(seed, langs, 45)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in manifest.audit(docs, bits).collect()]
    expected = plain_audit(rows)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_single_and_no_rows(spark):
    one = [(5, "a", "en", "s", 1)]
    found = manifest.audit(spark.createDataFrame([(*r, "", 1, "") for r in one], SCHEMA)).collect()
    assert [tuple(r) for r in found] == plain_audit(one)
    assert found[0].leaf == found[0].subroot == found[0].root and found[0].proof_sha256 == digest("")
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_places_follow_completion():
    for leaves in range(1, 40):
        height = (leaves - 1).bit_length()
        for extra in (0, 2):
            log = manifest.build([f"n{i}" for i in range(leaves)], height + extra)
            assert len(log) == manifest.size(leaves, height + extra)
            level = [f"n{i}" for i in range(leaves)]
            for up in range(height + extra + 1):
                assert [log[manifest.place(up, j, leaves)] for j in range(len(level))] == level
                level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]


def test_ways_fold_to_the_root():
    log = manifest.build([digest(str(i)) for i in range(11)], 4)
    ways = manifest.paths(log, 11, 4, "")
    for i, way in enumerate(ways):
        assert manifest.fold(digest(str(i)), way) == log[-1]
        assert manifest.fold(digest("other"), way) != log[-1]
    assert manifest.siblings("") == ""
