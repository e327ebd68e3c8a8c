"""Splitting texts into the words that byte-pair merges stay within.

A tokenizer file of the tokenizers library fixes the rules: normalizer, pre-tokenizer and
added tokens. Its own Rust rules are applied to any text with unusual characters. Texts of
plain Latin-1 take a short cut that gives the same words: lower case per character, white
space, and one regular expression inside what stands between, which is kept.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# characters for which lower case, composition and the classes below are plain
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
# fixed values: contractions and the letter and number classes of the split rule
_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t\n\r a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
# a full stop or comma that other marks precede belongs to their word
_MARKS = re.compile("[^\t\n\r a-zªµºß-öø-ÿ0-9²³¹¼½¾][.,][\t\n\r ]")
_STOPS = (". ", ", ", ".\n", ",\n")
# about how many bytes of text are cut into words at once, and beyond how many a text is encoded alone
_AT_ONCE = 1 << 23
_LONGEST = 1 << 25
_SHORT_CUT_RULES = (
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    ["NFC", "Replace", "Lowercase"],
)


class WordSplitter:
    """Words and added tokens of a text, in order, by the rules of a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self._mark = re.compile(f"({marks})") if marks else None
        self._short_cut = self._is_known_rule()
        self._letters = byte_letters()

    def _is_known_rule(self) -> bool:
        normalizers = [n["type"] for n in (self.spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex")
        return (pattern, normalizers) == _SHORT_CUT_RULES and len(splits) == 2 and not splits[1]["add_prefix_space"]

    def parts(self, text: str) -> Iterator[tuple[list[str] | None, int]]:
        """(words or runs of words, -1) for ordinary stretches, (None, id) for added tokens."""
        for i, part in enumerate(self._mark.split(text) if self._mark else [text]):
            if i % 2:
                yield None, self.added[part]
            elif part:
                yield self._words(part), -1

    def _words(self, text: str) -> list[str]:
        if self._short_cut and _PLAIN.fullmatch(text):
            # white space parts words, and so do full stops and commas that stand alone behind one
            low = text.lower()
            if not _MARKS.search(low):
                for mark in _STOPS:
                    low = low.replace(mark, " " + mark)
            return low.split()
        rules = self.tokenizer
        normal = rules.normalizer.normalize_str(text) if rules.normalizer else text
        pieces = rules.pre_tokenizer.pre_tokenize_str(normal)
        bytes_of = {c: b for b, c in enumerate(self._letters)}
        return [bytes(bytes_of[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def runs_of(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Which texts take the short cut without a look at each, and the runs of these.

        The runs are those that `parts` gives; empty ones come with white space at a text's ends.
        """
        if not self._short_cut or not len(texts):
            return np.zeros(len(texts), bool), pa.array([], pa.list_(texts.type))
        odd = pc.match_substring_regex(texts, _one_not_in(_PLAIN))
        odd = pc.or_(odd, pc.greater(pc.binary_length(texts), _LONGEST))
        for mark in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        low = pc.utf8_lower(texts)
        odd = pc.or_(odd, pc.match_substring_regex(low, _MARKS.pattern))
        low = low.filter(pc.invert(odd))
        for mark in _STOPS:
            low = pc.replace_substring(low, mark, " " + mark)
        return ~odd.to_numpy(zero_copy_only=False), pc.ascii_split_whitespace(low)

    def words_of(self, run: str) -> list[str]:
        """The words of a run without white space, as `parts` gives it."""
        return _WORD.findall(run) if self._short_cut and _PLAIN.fullmatch(run) else [run]

    def symbols(self, word: str) -> list[str]:
        """A word's bytes as the letters that vocabularies use, the last with the end mark."""
        letters = [self._letters[b] for b in word.encode("utf-8", "surrogateescape")]
        letters[-1] += self.spec["model"].get("end_of_word_suffix") or ""
        return letters


def _one_not_in(stretch: re.Pattern) -> str:
    """The class of characters that a `[...]*` leaves out."""
    return "[^" + stretch.pattern[1:-1]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PackedWords(dict):
    """Word or run of words -> its ids as little-endian 32-bit bytes, computed when first met.

    Full after `most` words, it starts anew, but takes over words of the generation before
    when they come again: bounded memory on any input, and frequent words stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 300_000) -> None:
        super().__init__()
        self._encode, self._most = encode, most
        self._before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self._before.get(word) or self._encode(word)
        if len(self) >= self._most:
            self._before = dict(self)
            self.clear()
        self[word] = found
        return found

    def all_of(self, words: list[str], encode_all: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct words; those not met before are encoded together."""
        found = list(map(self.get, words))
        missed = [i for i, ids in enumerate(found) if ids is None]
        for i in missed if self._before else ():
            found[i] = self._before.get(words[i])
        asked = [i for i in missed if found[i] is None]
        for i, ids in zip(asked, encode_all([words[i] for i in asked]), strict=True):
            found[i] = ids
        if len(self) + len(missed) > self._most:
            self._before = dict(self)
            self.clear()
        self.update((words[i], found[i]) for i in missed[: self._most])
        return found

    def trim(self, most: int = 50_000) -> None:
        """Keep the words met first, which are mostly the frequent ones."""
        kept = dict(islice((self._before or self).items(), most))
        self._before = {}
        self.clear()
        self.update(kept)


class TextIds:
    """Token ids of whole texts as packed bytes, one cached word at a time."""

    def __init__(
        self,
        splitter: WordSplitter,
        encode: Callable[[str], bytes],
        encode_all: Callable[[list[str]], list[bytes]] | None = None,
    ) -> None:
        def packed(run: str) -> bytes:
            words = splitter.words_of(run)
            return encode(run) if len(words) == 1 else b"".join(map(self._cache.__getitem__, words))

        def packed_all(runs: list[str]) -> list[bytes]:
            # letters alone are one word
            words = [r for r in runs if r.isalpha()]
            known = dict(zip(words, encode_all(words) if encode_all else map(encode, words), strict=True))
            return [known.get(r) or packed(r) for r in runs]

        self._splitter, self._cache, self._packed_all = splitter, PackedWords(packed), packed_all
        self.size = splitter.tokenizer.get_vocab_size()

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        out, cache = [], self._cache
        for words, added in self._splitter.parts(text):
            if words is None:
                out.append(added.to_bytes(4, "little"))
            else:
                out.extend(map(cache.__getitem__, words))
        return b"".join(out)

    def many(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Stretches of whole texts: the first one's place, ids laid end to end, and how many each text has.

        A word is looked up once for a stretch.
        """
        texts = pc.fill_null(texts, "")
        at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // _AT_ONCE
        edges = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(texts)]
        for first, stop in pairwise(edges):
            yield first, *self._stretch(texts.slice(first, stop - first))

    def _stretch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain, runs = self._splitter.runs_of(texts)
        ids, counts = self._of_runs(runs)
        if plain.all():
            return ids, counts
        pieces = iter(np.split(ids, np.cumsum(counts)[:-1]))
        own = [next(pieces) if p else np.frombuffer(self.packed(t.as_py()), "<u4") for p, t in zip(plain.tolist(), texts, strict=True)]
        return np.concatenate(own), np.array([len(x) for x in own])

    def _of_runs(self, runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        coded = runs.flatten().dictionary_encode()
        packed = self._cache.all_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._packed_all)
        table = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        which = coded.indices.to_numpy()
        width = sizes[which]
        ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[which] - ends[:-1]
        ids = table[np.repeat(shift, width) + np.arange(ends[-1], dtype=np.int32)]
        # a slice's offsets begin where it does
        offsets = runs.offsets.to_numpy()
        return ids, np.diff(ends[offsets - offsets[0]])

    def rest(self, most: int = 50_000) -> None:
        """Give back most of the memory, but for so many words."""
        self._cache.trim(most)
        pa.default_memory_pool().release_unused()

    def close(self) -> None:
        """Give back all of it; no text can be encoded any more."""
        self._cache = self._splitter = self._packed_all = None
        pa.default_memory_pool().release_unused()


@contextmanager
def task_ids(path: str, keep: bool = True, words: int = 50_000) -> Iterator[TextIds]:
    """`library_ids` for one task: Spark keeps idle workers beside later stages, so they must stay small.

    The next task of the worker finds so many words known; without keep it reads the tokenizer anew.
    """
    encoder = library_ids(path)
    try:
        yield encoder
    finally:
        if keep:
            encoder.rest(words)
        else:
            library_ids.cache_clear()
            encoder.close()


@lru_cache(maxsize=2)
def library_ids(path: str) -> TextIds:
    """Ids by the tokenizers library, which is asked once per word.

    A worker process keeps it from task to task, with what `TextIds.rest` leaves of the words met.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    splitter = WordSplitter(path)
    model = splitter.tokenizer.model
    letters_of = "".join(splitter._letters)
    apart = letters_of[:32] + " " + letters_of[33:]

    @lru_cache(maxsize=1)
    def together() -> tuple[Tokenizer, np.ndarray]:
        """A tokenizer of words between spaces, and which ids end a word by their mark (none, if not all do)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        words = Tokenizer(model)
        words.pre_tokenizer = CharDelimiterSplit(" ")
        mark, vocabulary = splitter.spec["model"].get("end_of_word_suffix"), splitter.tokenizer.get_vocab()
        final = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark and all(letter + mark in vocabulary for letter in letters_of):
            final[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        return words, final

    def encode(word: str) -> bytes:
        letters = word.encode("utf-8", "surrogateescape").decode("latin-1").translate(letters_of)
        return array("I", [t.id for t in model.tokenize(letters)]).tobytes()

    def encode_some(words: list[str]) -> list[bytes]:
        letters = " ".join(words).encode("utf-8", "surrogateescape").decode("latin-1").translate(apart)
        tokenizer, final = together()
        ids = np.array(tokenizer.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(final[ids]) + 1)
        if len(ends) != len(words):  # ends that do not show
            return list(map(encode, words))
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def encode_all(words: list[str]) -> list[bytes]:
        return [ids for i in range(0, len(words), 2_000) for ids in encode_some(words[i : i + 2_000])]

    return TextIds(splitter, encode, encode_all)
