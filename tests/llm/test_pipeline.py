from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from test_near_duplicates import brute_links, brute_words
from test_quality_rules import counts
from tokenizers import Tokenizer

import corpus_pipeline
from martloom.llm.common import tokenizer_file

DOCS = "doc_id long, text string, lang string, n_chars long, tag string, kept string, node int, row string"
LABELS = "doc_id long, quality int, toxic int"


def plain_quality(rows):
    """Base rule; of the labelled texts here only bad ones hold symbols, so the certified cutoff rejects any."""
    kept = []
    for doc_id, text in rows:
        words, _, symbols, _, repeated = counts(text)
        if words >= 10 and 100 * repeated <= 20 * words and not symbols:
            kept.append((doc_id, text))
    return kept


def plain_one_of_each(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    return [rows[i] for i in sorted({c for c, _ in brute_links([t for _, t in rows])})]


def plain_repeats(rows):
    return list(zip([i for i, _ in rows], brute_words([t for _, t in rows], 51), strict=True))


def plain_packing(rows):
    library = Tokenizer.from_file(tokenizer_file())
    library.no_truncation()
    library.no_padding()
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        start = 0
        while start < len(ids):
            length = min(4_096, 1 << (len(ids) - start).bit_length() - 1)
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            out.append((doc_id, start, length, crc, len(ids), 0, length.bit_length() - 1))
            start += length
    return out


def documents():
    rng = random.Random(11)

    def some(n):
        return " ".join(f"wé{rng.randint(0, 99_999)}" for _ in range(n))

    rows = [(i, some(20)) for i in range(1_600)]
    rows += [(i, " ".join(f"{w}#$%" for w in some(20).split())) for i in range(1_600, 1_900)]
    passage, base = some(55), some(60)
    rows += [(2_000, f"{some(90)} {passage} {some(70)}"), (2_001, f"{some(100)} {passage}"), (None, f"{passage} {some(95)}")]
    rows += [(2_011, base), (2_010, f"{base} more"), (2_012, f"{base} other"), (2_020, some(3_000))]
    copy = some(30)
    rows += [(2_030, copy), (2_030, copy), (2_031, copy)]
    rows += [(2_040, None), (2_041, ""), (2_042, some(9)), (None, None), (2_043, "again and again " * 30)]
    return rows


def test_stages_equal_plain_versions(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), "clash", "clash", 1, "clash") for i, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 1_600), 0) for i in range(1_900)] + [(None, 1, 0), (9_999, 0, 0), (3, None, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "packing"]
    single = plain_one_of_each(plain_quality(rows))
    cut = plain_repeats(single)
    assert len(single) == 1_600 + 3 + 1 + 1 + 1 and sum(a != b for a, b in zip(single, cut, strict=True)) == 3
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset, r.bucket) for r in found)
    assert pieces == Counter(plain_packing(cut))


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
