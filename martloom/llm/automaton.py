"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton reads tokens. It starts as one state with an arc back to itself for every
base symbol and takes the merges in order. The gadget of merge (u, v) -> w adds, beside
each arc labelled u that v can follow, an arc labelled w to the state after v, and
redirects the arcs labelled u to a copy of their target that lacks the arc v. What remains
after the last merge accepts one token sequence per word, its encoding.

All arcs with one label end in one state, so a state is named by the token last read. A
copy differs from its original by one missing arc, so a state is kept as the arcs that
gadgets took from it and when; it also lacks what the state it was taken from lacked
before. `follows` is that transition table, filled as arcs are asked for.

A word is encoded by running over its symbols: the state after each prefix is the one
token that ends there and that the state before it has an arc for. Decoding emits the
labels of the arcs.

Defined cases: a null or empty text has no ids, and decodes to an empty text; added tokens
in a text become their own ids; ids unknown to the vocabulary are an error. Repeated rows
are encoded each, extra columns stay out of the digest, long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.presplit import TextIds, WordSplitter

_NEVER = 1 << 40
_KNOWN_ARCS = 2_000_000


class TokenAutomaton:
    """The automaton of a merge list, with `encode_word` and `labels`."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.ids = vocab
        self.labels = {i: token for token, i in vocab.items()}
        self.born: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.taken: dict[str, dict[str, int]] = {}
        self.dead: set[str] = set()
        for step, (u, v) in enumerate(merges):
            self._gadget(step, u, v)
        # no token has more base symbols than characters
        self.longest = max((len(t) for t in vocab), default=1)
        self._arcs: dict[tuple[str, str], bool] = {}

    def _gadget(self, step: int, u: str, v: str) -> None:
        word = u + v
        if word in self.halves or word in self.dead:
            raise ValueError(f"two merges make {word!r}")
        if u in self.dead or v in self.dead or self._lacks(u, v):
            # v cannot follow u any more: the merge never applies
            self.dead.add(word)
            return
        self.halves[word] = (u, v)
        self.born[word] = step
        self.taken.setdefault(u, {})[v] = step

    def _lacks(self, before: str, token: str) -> bool:
        """Whether the state after `before` has no arc `token`.

        The state after w = uv began as the state after v: it lacks what that one lacked
        by then. An arc w = uv is added only where u could still be read, so it is missing
        wherever u was missing by then; the gadget of (u, u) takes u first.
        """
        state, until = before, _NEVER
        while True:
            taken = self.taken.get(state)
            if taken:
                label, limit = token, _NEVER
                while True:
                    when = taken.get(label, _NEVER)
                    if when < until and when <= limit and when < _NEVER:
                        return True
                    if label not in self.halves:
                        break
                    limit, label = self.born[label], self.halves[label][0]
            if state not in self.halves:
                return False
            until, state = min(until, self.born[state]), self.halves[state][1]

    def follows(self, before: str, token: str) -> bool:
        arc = (before, token)
        known = self._arcs.get(arc)
        if known is None:
            if len(self._arcs) >= _KNOWN_ARCS:
                self._arcs.clear()
            known = self._arcs[arc] = not self._lacks(before, token)
        return known

    def encode_symbols(self, symbols: list[str]) -> list[int]:
        """Ids of one word given as base symbols."""
        ids = self.ids
        text = "".join(symbols)
        ends = [0]
        for s in symbols:
            ends.append(ends[-1] + len(s))
        states: list[str | None] = [None] * len(ends)
        came: list[int] = [0] * len(ends)
        for end in range(1, len(ends)):
            stop = ends[end]
            for start in range(max(0, end - self.longest), end):
                token = text[ends[start] : stop]
                if token in ids and token not in self.dead and (start == 0 or self.follows(states[start], token)):
                    states[end], came[end] = token, start
                    break
            else:
                raise ValueError(f"no token ends {text[:stop]!r}")
        found, at = [], len(ends) - 1
        while at:
            found.append(ids[states[at]])
            at = came[at]
        return found[::-1]


class Codec:
    """Encodes and decodes texts by a tokenizer file through its automaton."""

    def __init__(self, path: str) -> None:
        splitter = WordSplitter(path)
        model = splitter.spec["model"]
        self.automaton = TokenAutomaton(model["vocab"], [tuple(m) for m in model["merges"]])
        self.added = {i: token for token, i in splitter.added.items()}

        def encode(word: str) -> bytes:
            return array("I", self.automaton.encode_symbols(splitter.symbols(word))).tobytes()

        self.packed = TextIds(splitter, encode).packed
        self._labels = {**self.automaton.labels, **self.added}
        self._join = " " if splitter.spec.get("decoder") is None else ""

    def decode(self, ids: array) -> str:
        """The labels of the arcs in order; a file without a decoder joins them by spaces."""
        return self._join.join(map(self._labels.__getitem__, ids))


def encode_table(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of packed ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for texts in batches:
            yield pd.Series([codec.packed(t) for t in texts])

    return docs.withColumn(ids, F.pandas_udf(run, "binary")(text))


def code_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, the digest of its ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column("text"):
                packed = codec.packed(text.as_py())
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(array("I", packed)).encode("utf-8")).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return columns.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
