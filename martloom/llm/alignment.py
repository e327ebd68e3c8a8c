"""Alignment of two tokenizers over the same texts, by sparse incidence matrices.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B). Tokens and the bytes they cover form two incidence matrices in compressed
rows; the row products of A and the transpose of B (Gustavson) give the overlap links, each
with the bytes shared. Links whose tokens end together mark the offsets that cut both
sequences into groups; products of the group incidences give the shared-group links.

How often an id pair is linked is counted over the whole corpus. Texts are aligned in blocks
of about `block_bytes`, and a block names each of its id pairs once: only these pairs are
shuffled, to be summed and to bring their counts back to the block.

Defined cases: a text that is null, empty or not spelled out byte for byte by the tokens of
either vocabulary has no tokens, zeros and an empty digest; the strings of special tokens in
a text are ordinary text; repeated rows and null ids are aligned row by row; an empty table
gives an empty result; a very long text is a block of its own, its product being taken in
slices of rows; extra columns stay out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import stage
from martloom.llm.presplit import byte_letters

BLOCK_BYTES = 1 << 18
_SLICE = 1 << 17
_B_BITS = 32


@dataclass
class Rows:
    """A sparse matrix in compressed rows; all stored values are whole numbers."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.height, dtype=np.int32), np.diff(self.starts))

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, self.row_of()[order], self.values[order], self.height)


def byte_incidence(lengths: np.ndarray) -> Rows:
    """Tokens laid end to end, and the bytes that each covers."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    total = int(starts[-1])
    return Rows(starts, np.arange(total, dtype=np.int32), np.ones(total, np.int32), total)


def group_incidence(groups: np.ndarray, width: int) -> Rows:
    """Tokens, and the one group that each is in."""
    return Rows(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int32), width)


def row_products(left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of left times right by rows, some rows at a time.

    A row of the product is the sum of the rows of `right` that a row of `left` points to.
    """
    first = 0
    while first < left.height:
        # as many rows as bring the slice to its size, one at least
        last = int(np.searchsorted(left.starts, left.starts[first] + _SLICE, "right")) - 1
        last = min(max(last, first + 1), left.height)
        inner = left.columns[left.starts[first] : left.starts[last]]
        begin = right.starts[inner]
        many = right.starts[inner + 1] - begin
        row = np.repeat(np.arange(first, last), np.diff(left.starts[first : last + 1]))
        at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        key = np.repeat(row, many) * right.width + right.columns[at]
        value = np.repeat(left.values[left.starts[first] : left.starts[last]], many) * right.values[at]
        if len(key):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key = key[new]
            yield key // right.width, key % right.width, np.add.reduceat(value, new)
        first = last


def _whole(parts: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = list(parts)
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def overlap_links(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of tokens (of A, of B) that share bytes, and how many; both cover the same bytes."""
    return _whole(row_products(byte_incidence(lengths_a), byte_incidence(lengths_b).transposed()))


def ending_together(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the overlap links those whose tokens end at one byte."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    kept = []
    for a, b, _ in row_products(byte_incidence(lengths_a), byte_incidence(lengths_b).transposed()):
        same = ends_a[a] == ends_b[b]
        kept.append((a[same], b[same]))
    return _whole((a, b, a) for a, b in kept)[:2]


def shared_group_links(groups_a: np.ndarray, groups_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens in one group; as many as the product of a group's two sides."""
    width = 1 + int(max(groups_a.max(initial=-1), groups_b.max(initial=-1)))
    return _whole(row_products(group_incidence(groups_a, width), group_incidence(groups_b, width).transposed()))[:2]


# fixed value: the split rule of byte-level vocabularies
_BYTE_RULE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters that every version of Unicode classes alike
_SETTLED = re.compile("[\\x00-\u024f]*")


class Vocabularies:
    """Both tokenizers, and the bytes of each id.

    Where the byte vocabulary has one id for each byte and ids in the order of its merges,
    texts of settled characters are encoded from these ranks; its own tokenizer encodes the
    rest.
    """

    def __init__(self, bytes_file: str, pieces_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self._bytes_file = bytes_file
        with open(bytes_file, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocab = {e: i for e, i in spec["model"]["vocab"].items() if all(letter in byte_of for letter in e)}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_a = [added.get(i, b"") for i in range(1 + max([*vocab.values(), *added]))]
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[letter] for letter in entry)
        self._ranks = self._by_rank(spec, vocab, added)
        self._tokenizer = None
        self.b = SentencePieceProcessor(model_file=pieces_file)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # ids as text, each followed by what may stand after it
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def _by_rank(self, spec: dict, vocab: dict[str, int], added: dict[int, bytes]):
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        single = all(vocab.get(letter, 256) < 256 for letter in byte_letters())
        ordered = all(vocab.get(m) == 256 + i for i, m in enumerate(merges))
        if spec.get("normalizer") or not (plain and single and ordered):
            return None
        import tiktoken

        ranks = {self.bytes_a[i]: i for i in vocab.values() if i not in added}
        return tiktoken.Encoding("ranks", pat_str=_BYTE_RULE, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def byte_ids(self, text: str) -> np.ndarray | None:
        """Ids by A of a text with its space."""
        if self._ranks is not None and _SETTLED.fullmatch(text):
            # every byte has an id: nothing can be lost
            return self._ranks.encode_to_numpy(text, disallowed_special=())
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self._bytes_file)
            self._tokenizer.encode_special_tokens = True
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        spelled = b"".join(map(self.bytes_a.__getitem__, ids)) == text.encode()
        return np.array(ids, np.uint32) if spelled else None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of each text, none where they do not spell it out."""
        none = np.empty(0, np.uint32)
        out = []
        for text, pieces in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = f" {text}"
            spelled = text and b"".join(map(self.bytes_b.__getitem__, pieces)) == whole.encode()
            a = self.byte_ids(whole) if spelled else None
            out.append((none, none) if a is None else (a, np.array(pieces, np.uint32)))
        return out


@lru_cache(maxsize=2)
def _vocabularies(bytes_file: str, pieces_file: str) -> Vocabularies:
    return Vocabularies(bytes_file, pieces_file)


_BLOCK = ["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "times", "links"]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _index_type(pairs: int) -> str:
    """The narrowest type that holds a place among so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def _aligned(block: int, doc_ids: pa.Array, texts: list[str], words: Vocabularies) -> pa.RecordBatch:
    encoded = words.encode(texts)
    n_a, n_b = (np.array([len(x[side]) for x in encoded], np.int64) for side in (0, 1))
    ids_a, ids_b = (np.concatenate([x[side] for x in encoded]).astype(np.int64) for side in (0, 1))
    length_a, length_b = words.length_a[ids_a], words.length_b[ids_b]
    # every text ends with both its sequences, so that links stay inside a text
    left, right = ending_together(length_a, length_b)
    owner = np.repeat(np.arange(len(texts)), n_a)
    n_links = np.bincount(owner[left], minlength=len(texts))
    ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
    # in order, as the rows of the product are
    cuts = ends_a[left]
    cuts = cuts[np.concatenate([np.ones(min(1, len(cuts)), bool), cuts[1:] != cuts[:-1]])]
    last_bytes = np.cumsum(np.bincount(owner, weights=length_a, minlength=len(texts)).astype(np.int64))
    n_groups = np.diff(np.searchsorted(cuts, np.concatenate([[0], last_bytes]), "right"))

    # tokens by group, those of A first; the mark after a token tells what comes next
    groups = np.concatenate([np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left")])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, groups))
    groups, side = groups[order], side[order]
    mark = np.zeros(len(order), np.int64)
    mark[:-1] = np.where(groups[1:] != groups[:-1], 2, side[1:] - side[:-1])
    codes = (3 * np.concatenate([ids_a, ids_b])[order] + mark).tolist()
    stops = np.cumsum(n_a + n_b).tolist()
    digests, start = [], 0
    for stop in stops:
        line = "".join(map(words.written.__getitem__, codes[start:stop]))
        digests.append(sha256(line[:-1].encode()).hexdigest() if line else "")
        start = stop

    linked = (ids_a[left] << _B_BITS) | ids_b[right]
    by = np.argsort(linked)
    new = np.concatenate([np.ones(min(1, len(by)), bool), linked[by[1:]] != linked[by[:-1]]])
    index = np.empty(len(by), np.int32)
    index[by] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    pairs, times = linked[by[first]], np.diff(np.append(first, len(by)))
    arrays = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)]
    arrays += [_lists(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
    arrays += [pa.array([digests], pa.list_(pa.string())), _lists(pairs, pa.int64()), _lists(times, pa.int64())]
    packed = index.astype(_index_type(len(pairs))).tobytes()
    return pa.RecordBatch.from_arrays([*arrays, pa.array([packed], pa.binary())], _BLOCK)


def _block_rows(bytes_file: str, pieces_file: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabularies(bytes_file, pieces_file)
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            first, texts, held = 0, [], 0
            for row in range(batch.num_rows):
                text = column[row].as_py() or ""
                if held and held + len(text) > block_bytes:
                    yield _aligned(block, ids.slice(first, row - first), texts, words)
                    first, texts, held, block = row, [], 0, block + 1
                texts.append(text)
                held += len(text)
            if texts:
                yield _aligned(block, ids.slice(first), texts, words)
                block += 1

    return run


def align(
    docs: DataFrame,
    bytes_file: str,
    pieces_file: str,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Aligned texts in blocks: the documents' counts and digests, and the links as id pairs.

    Columns: block; doc_ids, n_a, n_b, n_groups, n_links, digests (one entry per document);
    pairs (id of A in the upper half, id of B in the lower) and times; links (places in
    pairs, document after document, as packed numbers of two bytes, or four where there are
    more pairs than these can name).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = (
        f"block long, doc_ids array<{kind}>, {longs}, digests array<string>, "
        "pairs array<bigint>, times array<bigint>, links binary"
    )
    return rows.mapInArrow(_block_rows(bytes_file, pieces_file, block_bytes), schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Each id pair of the corpus: pair, id_a, id_b, links, and whether its B id has none more often."""
    named = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = named.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links"))
    counts = stage(
        counts.select(
            "pair",
            F.shiftright("pair", _B_BITS).cast("int").alias("id_a"),
            F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).cast("int").alias("id_b"),
            "links",
        ),
        "pairs",
    )
    most = counts.groupBy(F.col("id_b").alias("id_b_")).agg(F.max("links").alias("most"))
    joined = counts.join(most, F.col("id_b") == F.col("id_b_"))
    return joined.select("pair", "id_a", "id_b", "links", (F.col("links") == F.col("most")).alias("best"))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            lists = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")
            own = {c: batch.column(c).slice(row, 1).flatten() for c in lists}
            known = batch.column("known").slice(row, 1).flatten()
            counts = np.zeros(len(known), np.int64)
            best = np.zeros(len(known), np.int64)
            if len(known):
                place = known.field("place").to_numpy()
                counts[place] = known.field("links").to_numpy()
                best[place] = known.field("best").to_numpy(zero_copy_only=False)
            packed = batch.column("links")[row].as_buffer()
            links = np.frombuffer(packed, _index_type(len(known)))
            stops = np.concatenate([[0], np.cumsum(own["n_links"].to_numpy())])
            sums = []
            for values in (best, counts):
                running = np.concatenate([[0], np.cumsum(values[links])])
                sums.append(pa.array(running[stops[1:]] - running[stops[:-1]], pa.int64()))
            arrays = [own[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*arrays, *sums, own["digests"]], _RESULT)


def score_links(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per document, with its links judged by the counts of the whole corpus.

    `blocks` and `pairs` are read several times: stage them before.
    """
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    asked = blocks.select(F.col("block").alias("block_"), F.posexplode("pairs").alias("place", "pair_"))
    told = asked.join(pairs, F.col("pair_") == F.col("pair")).groupBy("block_")
    told = told.agg(F.collect_list(F.struct("place", "links", "best")).alias("known"))
    joined = blocks.drop("pairs", "times").join(told, F.col("block") == F.col("block_"), "left").drop("block_")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _RESULT[1:-1]) + ", groups_sha256 string"
    return joined.mapInArrow(_scored_rows, schema)


def link_scores(docs: DataFrame, bytes_file: str, pieces_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: token, group and link counts, and the digest of its groups."""
    blocks = stage(align(docs, bytes_file, pieces_file, block_bytes), "aligned")
    return score_links(blocks, stage(pair_counts(blocks), "pairs"))
