"""Packing documents into sequences by powers of two.

The tokens of a document, with its end id, are cut into as many pieces of the longest
length as fit and then into the powers of two of the rest, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; sequences of
one length form a bucket that a trainer batches together. Bucket, task and place in the
task make up the sequence id, so numbering needs no shuffle.

Defined cases: a null or empty text is the end id alone, one piece of length 1; repeated
rows and null document ids are packed row by row; an empty table gives no pieces; long
texts are encoded whole; extra columns are left out.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.presplit import TextIds, task_ids

MAX_LENGTH = 4096
END_ID = 2
_TASK_BITS, _PLACE_BITS = 24, 34


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens; longest is a power of two."""
    whole, rest = divmod(n, longest)
    bits = (1 << k for k in range(longest.bit_length() - 1, -1, -1))
    return [longest] * whole + [b for b in bits if rest & b]


def pack(
    docs: DataFrame,
    tokenizer: str,
    longest: int = MAX_LENGTH,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_ids(tokenizer, keep=False) as encoder:
            yield from pieces_of(encoder, batches)

    def pieces_of(encoder: TextIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << _PLACE_BITS
        places: Counter[int] = Counter()
        for batch in batches:
            owners, starts, lengths, totals, sequences, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column("text")):
                packed = encoder.packed(value.as_py()) + end
                total, start = len(packed) // 4, 0
                for length in binary_lengths(total, longest):
                    owners.append(row)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(total)
                    bucket = length.bit_length() - 1
                    sequences.append(bucket << (_TASK_BITS + _PLACE_BITS) | task | places[length])
                    ids.append(packed[4 * start : 4 * (start + length)])
                    places[length] += 1
                    start += length
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, sequences)]
            owner = batch.column("doc_id").take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [owner, *numbers, pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, ids binary"
    )
    # every sequence is one piece, which starts it
    return pieces.withColumns(
        {"offset": F.lit(0).cast("long"), "bucket": F.shiftright("sequence_id", _TASK_BITS + _PLACE_BITS).cast("int")}
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
