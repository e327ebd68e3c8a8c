from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from martloom.llm import alignment
from martloom.llm.common import tokenizer_file
from martloom.llm.presplit import byte_letters

A_FILE, B_FILE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, pairs string"


def plain_tokens(text):
    """Both token sequences as (id, bytes), or none."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_FILE)
    letters = {c: i for i, c in enumerate(byte_letters())}
    whole = f" {text or ''}".encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(whole.decode(), add_special_tokens=False).ids]
    right = []
    for i in b.encode(text or ""):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return [], []
    return left, right


def plain_scores(rows):
    seen = []
    for doc_id, text in rows:
        left, right = plain_tokens(text)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        links = [(left[i][0], right[j][0]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e == f]
        groups, start = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            stop = tuple(sum(e <= cut for e in side) for side in ends)
            sides = (left[start[0] : stop[0]], right[start[1] : stop[1]])
            groups.append("|".join(",".join(str(i) for i, _ in side) for side in sides))
            start = stop
        line = ";".join(groups)
        seen.append((doc_id, len(left), len(right), len(groups), links, sha256(line.encode()).hexdigest() if line else ""))
    counts = Counter(link for row in seen for link in row[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (i, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for i, n_a, n_b, n_groups, links, digest in seen
    ]


def texts():
    rng = random.Random(3)
    words = ["the", "anti", "zäh", "x1", "日本語", "  ", "\n\n", "é́", "Über", "<s>", "<|endoftext|>", " ", "🙂", "don't", "1234", "ﬁ", "\x00"]
    found = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(25)]
    odd = [None, "", " ", "a", "▁", "a ▁b", "  lead", "trail  ", "<0x41>", "</s>", "日" * 40]
    return found + odd + found[:3]


@pytest.mark.parametrize("block_bytes", [1, 90, alignment.BLOCK_BYTES])
def test_scores_equal_plain_ones(spark, block_bytes):
    rows = list(enumerate(texts())) + [(None, "the the"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in alignment.link_scores(docs, A_FILE, B_FILE, block_bytes).collect()), key=str)
    assert found == sorted(plain_scores(rows), key=str)


def test_ids_equal_those_of_the_libraries():
    words = alignment.Vocabularies(A_FILE, B_FILE)
    assert words._ranks is not None
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_FILE)
    rng = random.Random(8)
    every = [chr(c) for c in range(0x250)]
    odd = [*every, *" \n\t'" * 40, *"日本é́🙂ǆǅ", "’", " ", " ", "'ll", "'Re", "\u2028", "\ua7ff"]
    for _ in range(3_000):
        letters = rng.choice([every, odd, "ab 1'.", [" ", "\n", "a", "'s", "   "]])
        text = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        (left, right), = words.encode([text])
        pieces = b.encode(text)
        if b"".join(words.bytes_b[i] for i in pieces) == f" {text}".encode():
            assert left.tolist() == a.encode(f" {text}", add_special_tokens=False).ids
            assert right.tolist() == pieces
        else:
            assert len(left) == len(right) == 0


def test_no_rows(spark):
    assert alignment.link_scores(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE).count() == 0


def test_long_text_spans_several_slices(spark, monkeypatch):
    text = " ".join(f"wörd{i % 977}" for i in range(90_000))
    found = alignment.link_scores(spark.createDataFrame([(1, text, 1, "")], SCHEMA), A_FILE, B_FILE).collect()
    words = alignment.Vocabularies(A_FILE, B_FILE)
    (a, b), = words.encode([text])
    ends = np.intersect1d(np.cumsum(words.length_a[a]), np.cumsum(words.length_b[b]))
    assert len(text.encode()) > alignment._SLICE
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links) for r in found] == [(len(a), len(b), len(ends), len(ends))]


def test_row_products_equal_dense_ones(monkeypatch):
    monkeypatch.setattr(alignment, "_SLICE", 7)
    rng = np.random.default_rng(1)

    def sparse(dense):
        rows, columns = np.nonzero(dense)
        starts = np.concatenate([[0], np.cumsum((dense != 0).sum(1))])
        return alignment.Rows(starts, columns, dense[rows, columns], dense.shape[1])

    for _ in range(30):
        left = rng.integers(0, 3, (rng.integers(1, 9), 6)) * rng.integers(0, 2, (1, 6))
        right = rng.integers(0, 2, (6, rng.integers(1, 8)))
        out = np.zeros((left.shape[0], right.shape[1]), int)
        for r, c, v in alignment.row_products(sparse(left), sparse(right)):
            out[r, c] += v
        assert (out == left @ right).all()
        flipped = sparse(right).transposed()
        dense = np.zeros((right.shape[1], 6), int)
        dense[flipped.row_of(), flipped.columns] = flipped.values
        assert (dense == right.T).all()


def test_links_between_tokens_and_groups():
    a, b = np.array([2, 3, 1]), np.array([1, 4, 1])
    assert [x.tolist() for x in alignment.overlap_links(a, b)] == [[0, 0, 1, 2], [0, 1, 1, 2], [1, 1, 3, 1]]
    assert [x.tolist() for x in alignment.ending_together(a, b)] == [[1, 2], [1, 2]]
    found = alignment.shared_group_links(np.array([0, 0, 1]), np.array([0, 0, 1]))
    assert [x.tolist() for x in found] == [[0, 0, 1, 1, 2], [0, 1, 0, 1, 2]]
