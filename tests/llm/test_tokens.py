from __future__ import annotations

import random
import weakref
import zlib
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martloom.llm import automaton, grammar, packing, presplit
from martloom.llm.common import tokenizer_file
from martloom.llm.presplit import PackedWords, library_ids, task_ids

DOCS = "doc_id long, text string, ids string, start int"
TEXTS = [
    None,
    "",
    " ",
    "Hello world, it's a test of 123 numbers!",
    "éàü İstanbul ΑΣ ß ﬁne ½ ²",
    "special <|endoftext|> inside <|startoftext|>text",
    "日本語 テスト 👍🏽 \x85\xa0 \u0000 a\u0301",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ---------- !!!!!!!!!",
    "I'LL we'Re 'S'T don't",
    "x" * 20_000 + " end",
    "many words " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def expected(library):
    return [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def documents(spark):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(TEXTS)], DOCS)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_short_cut_equals_the_library(expected):
    encoder = library_ids(tokenizer_file())
    assert [encoder.packed(t) for t in TEXTS] == [packed(e) for e in expected]


def test_marks_beside_words_equal_the_library(library):
    encoder = library_ids(tokenizer_file())
    rng = random.Random(5)
    pieces = [".", ",", " ", "\n", "\t", "a", "Word", "it's", "7", '"', "...", ")", "'", "-", "é", "½", "αb", "\xa0", "'RE"]
    for _ in range(4_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 25)))
        assert encoder.packed(text) == packed(library.encode(text, add_special_tokens=False).ids), text


def test_texts_together_equal_the_library(library, expected, monkeypatch):
    rng = random.Random(6)
    pieces = [".", ",", " ", "\n", "\t", "  ", "a", "Word", "ÀÉ", "it's", "7", '"', ")", "'", "é", "½", "αb", "\xa0", "<|endoftext|>", "\x0b"]
    texts = ["".join(rng.choices(pieces[: rng.choice([12, 20])], k=rng.randint(0, 25))) for _ in range(3_000)]
    wanted = expected + [library.encode(t, add_special_tokens=False).ids for t in texts]
    whole = pa.array(["left out", *TEXTS, *texts]).slice(1)
    encoder = library_ids(tokenizer_file())
    for at_once, longest in ((1 << 24, 1 << 25), (500, 1 << 25), (500, 40)):
        monkeypatch.setattr(presplit, "_AT_ONCE", at_once)
        monkeypatch.setattr(presplit, "_LONGEST", longest)
        encoder.rest(10)
        found = list(encoder.many(whole))
        counts = np.concatenate([c for _, _, c in found])
        assert [first for first, _, _ in found] == [0, *np.cumsum([len(c) for _, _, c in found])[:-1]]
        assert counts.tolist() == [len(w) for w in wanted]
        assert np.concatenate([ids for _, ids, _ in found]).tolist() == [x for w in wanted for x in w]
    assert list(encoder.many(whole[:0])) == []


def test_words_of_many_texts_are_encoded_once():
    asked = []
    words = PackedWords(str.encode, most=4)

    def encode_all(new):
        asked.extend(new)
        return [w.encode() for w in new]

    for i in range(40):
        wanted = ["the", *(f"rare{j}" for j in range(i, i + 2))]
        assert words.all_of(wanted, encode_all) == [w.encode() for w in wanted]
        assert len(words) <= 4 and len(words._before) <= 4
    assert len(asked) == len(set(asked)) == 42


def test_frequent_words_are_encoded_once():
    asked = []
    words = PackedWords(lambda w: asked.append(w) or w.encode(), most=4)
    for i in range(40):
        assert (words["the"], words[f"rare{i}"]) == (b"the", f"rare{i}".encode())
        assert len(words) + len(words._before) <= 8
    assert asked.count("the") == 1 and len(asked) == 41


def test_words_stay_from_task_to_task():
    first = library_ids(tokenizer_file())
    first.packed("a word that stays")
    assert "stays" in library_ids(tokenizer_file())._cache


def test_a_resting_worker_keeps_few_words(library):
    text = " ".join(["often", *(f"{i:x}" for i in range(60_000)), "often"])
    with task_ids(tokenizer_file()) as encoder:
        first = encoder.packed(text)
        assert len(encoder._cache) > 50_000
    assert len(encoder._cache) == 50_000 and "often" in encoder._cache and not encoder._cache._before
    assert encoder.packed(text) == first == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def test_a_worker_can_drop_its_tokenizer():
    with task_ids(tokenizer_file(), keep=False) as encoder:
        model = weakref.ref(encoder._splitter)
    assert model() is None and library_ids(tokenizer_file()) is not encoder


def test_automaton_equals_the_library_on_random_words(library):
    codec = automaton.Codec(tokenizer_file())
    rng = random.Random(3)
    pieces = [t.replace("</w>", "") for t in library.get_vocab() if t.isascii() and "<|" not in t]
    words = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(3_000)]
    words += ["".join(rng.choices("abehinorst'.!-", k=rng.randint(1, 30))) for _ in range(3_000)]
    for word in words:
        assert codec.packed(word) == packed(library.encode(word, add_special_tokens=False).ids), word


def test_every_second_place_of_a_run():
    rng = random.Random(8)
    for _ in range(500):
        group = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
        beside = [rng.random() < 0.8 for _ in group[1:]]
        odd, run = [], 0
        for i in range(1, len(group)):
            run = run + 1 if beside[i - 1] and group[i] == group[i - 1] else 0
            odd += [i] * (run % 2)
        assert grammar._odd_of_runs(np.array(group), np.array(beside, bool)).tolist() == odd


def plain_bpe(word, merges):
    """Merges in order, each from the left wherever it applies."""
    word = list(word)
    for u, v in merges:
        i = 0
        while i < len(word) - 1:
            if word[i] == u and word[i + 1] == v:
                word[i : i + 2] = [u + v]
            i += 1
    return word


def test_automaton_equals_merging_in_order_on_random_rules():
    rng = random.Random(9)
    for _ in range(40):
        tokens, merges = list("abc"), []
        while len(merges) < 12:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        vocab = {t: i for i, t in enumerate(tokens)}
        machine = automaton.TokenAutomaton(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert machine.encode_symbols(list(word)) == [vocab[t] for t in plain_bpe(word, merges)]


def test_codes_and_round_trip(spark, library, expected):
    rows = automaton.code_digests(documents(spark), tokenizer_file()).orderBy("doc_id").collect()
    for row, ids in zip(rows, expected, strict=True):
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(packed(ids)).hexdigest()
        assert row.decoded_sha256 == sha256(decoded.encode()).hexdigest()
    coded = automaton.encode_table(documents(spark).limit(5), tokenizer_file(), ids="codes").orderBy("doc_id")
    assert [bytes(r.codes) for r in coded.collect()] == [packed(e) for e in expected[:5]]


def test_binary_lengths():
    for n in [*range(1, 300), 4_095, 4_096, 4_097, 123_456]:
        lengths = packing.binary_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths)
        assert sorted(lengths, reverse=True) == lengths and max(lengths) <= 4_096
        rest = [x for x in lengths if x < 4_096]
        assert len(rest) == len(set(rest))


def test_packing_covers_every_id_once(spark, expected):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(docs, tokenizer_file()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    found = {}
    for row in sorted(rows, key=lambda r: r.start):
        assert row.offset == 0 and row.length == 1 << row.bucket <= 4_096
        assert row.sequence_id >> 58 == row.bucket
        part = found.setdefault(row.doc_id, [])
        assert row.start == len(part)
        part.extend(array("I", bytes(row.ids)))
        assert len(bytes(row.ids)) == 4 * row.length
    assert found == {**{i: [*e, 2] for i, e in enumerate(expected)}, None: [*expected[3], 2]}
    digests = packing.piece_digests(packing.pack(docs, tokenizer_file()))
    first = digests.where("doc_id = 3 and start = 0").first()
    assert first.ids_crc32 == zlib.crc32(packed([*expected[3], 2][: first.length]))


def test_bad_length(spark):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(documents(spark), tokenizer_file(), longest=1_000)


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_token_files_round_trip(spark, expected, tmp_path, shard_ids):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(documents(spark).where("doc_id = 4"))
    path = str(tmp_path / "files")
    grammar.write_token_files(docs, tokenizer_file(), path, shard_ids=shard_ids, partitions=3)
    rows = sorted(grammar.read_documents(spark, path).collect(), key=lambda r: r.start)
    ordered = [(None, expected[4]), *((i, e) for i, e in enumerate(expected) for _ in range(1 + (i == 4)))]
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    at = 0
    for row, (_, ids) in zip(rows, ordered, strict=True):
        assert (row.start, row.n_tokens, bytes(row.ids)) == (at, len(ids) + 1, packed([*ids, 1]))
        at += row.n_tokens


def test_grammar_shards_on_random_ids():
    rng = np.random.default_rng(0)
    for size in (1, 2, 50, 5_000):
        for kinds in (2, 5, 300):
            ids = rng.integers(3, 3 + kinds, size).astype(np.uint32)
            ends = np.unique(np.append(rng.integers(1, size + 1, 1 + size // 20), size))
            payload = grammar.shard_bytes(ids, ends, 70_000 if kinds == 300 else 400)
            shard = grammar.Shard(payload)
            parts = np.split(ids, ends[:-1])
            assert all((a == b).all() for a, b in zip(shard.documents(), parts, strict=True))
            assert all((shard.document(i) == p).all() for i, p in enumerate(parts))
            for start, stop in rng.integers(0, size + 1, (20, 2)):
                assert (shard.ids(start, stop) == ids[start:stop]).all()
    many = np.tile(np.arange(3, 11, dtype=np.uint32), 2_000)
    assert len(grammar.shard_bytes(many, np.array([len(many)]), 400)) < 2 * len(many)


def repeating_pairs(symbols, starts):
    """Pairs that occur twice in documents without overlap."""
    counts = {}
    for part in np.split(symbols, starts[1:]):
        taken = {}
        for i, pair in enumerate(zip(part.tolist(), part[1:].tolist(), strict=False)):
            if taken.get(pair, -2) < i - 1:
                taken[pair] = i
                counts[pair] = counts.get(pair, 0) + 1
    return {p for p, c in counts.items() if c > 1}


def test_grammars_end_when_no_pair_repeats():
    rng = np.random.default_rng(1)
    passage = rng.integers(3, 40_000, 3_000)
    cases = [np.tile(passage, 4), np.tile(np.arange(3, 30_003), 2), np.full(100_000, 7), rng.integers(3, 60, 20_000)]
    cases.append(np.repeat(rng.integers(3, 9, 3_000), rng.integers(1, 6, 3_000)))
    for ids in cases:
        ids = ids.astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 3), len(ids)))
        rules, symbols, starts = grammar.compress(ids, ends, 40_400)
        assert not repeating_pairs(symbols, starts)
        shard = grammar.Shard(grammar.shard_bytes(ids, ends, 40_400))
        assert all((a == b).all() for a, b in zip(shard.documents(), np.split(ids, ends[:-1]), strict=True))
        for start, stop in rng.integers(0, len(ids) + 1, (20, 2)):
            assert (shard.ids(start, stop) == ids[start:stop]).all()
    copies = np.tile(passage, 4).astype(np.uint32)
    rules, symbols, _ = grammar.compress(copies, np.arange(3_000, 12_001, 3_000), 40_400)
    assert len(symbols) == 4 and grammar.expansion_lengths(rules, 40_400).max() == 3_000
    # more symbols than 16 bits hold
    ids = np.tile(np.arange(3, 40_003), 2).astype(np.uint32)
    assert len(grammar.compress(ids, np.array([40_000, 80_000]), 40_400)[0]) > (1 << 16) - 40_400


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty, tokenizer_file()).count() == 0
    assert automaton.code_digests(empty, tokenizer_file()).count() == 0
    grammar.write_token_files(empty, tokenizer_file(), str(tmp_path / "none"))
    assert grammar.read_documents(spark, str(tmp_path / "none")).count() == 0
