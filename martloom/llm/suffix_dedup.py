"""Removal of long repeats by suffix arrays.

A window is `span` symbols of a document: bytes in `remove_repeats`, words in
`without_repeats`. Every window that also starts anywhere else, in the same document or
another, is removed with all that it covers; removal is judged on the input. Words lie
between ASCII white space, case kept, and are compared by 32-bit hashes.

Windows are dealt to shards by content, so that equal windows meet: the anchor of a window
is its smallest hashed string of 64 bytes or 10 words (the leftmost of equal ones), neighbouring windows
with one anchor form a segment, and segments are dealt by the anchor's hash.

1. Segments are counted without their texts. Where all segments of an anchor are equal,
   the count alone decides. An anchor seen once cannot hold a repeat.
2. One segment of each kind of the remaining anchors is fetched and sharded. A shard sorts
   all its suffixes by Larsson-Sadakane refinement to the depth of a window, and finds
   common prefixes by Kasai's walk over the text, taken in step for all segments.
3. An anchor with more than `shard_segments` kinds of segments is split over several
   shards. These send the hashes of their windows, one per kind, in sorted slices; a slice
   merges them by binary search, and a window found in two shards is a repeat.

Defined cases: a null text is empty; texts shorter than a window stay as they are;
repeated rows are copies of each other; rows are told apart by doc_id and a hash of the
text, so equal or null ids do not mix texts up; an empty table gives an empty result; long
texts are handled in overlapping blocks. Extra columns are left out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import stage

SPAN = 400
WORD_SPAN = 51


@dataclass(frozen=True)
class Symbols:
    """What windows are counted in: the type of a symbol, and how many an anchor has."""

    kind: str
    anchor: int

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    def array(self, buffer: pa.Buffer) -> np.ndarray:
        return np.frombuffer(buffer, self.kind)


BYTES = Symbols("u1", 64)
WORDS = Symbols("<u4", 10)
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


def _constants(n: int, salt: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit numbers."""
    return np.array([xxhash.xxh3_64_intdigest(f"{salt}-{i}") | 1 for i in range(n)], np.uint64)


_BYTE = _constants(256, 1)
_STEP = _constants(40, 2)


def _spread(data: np.ndarray) -> np.ndarray:
    """A 64-bit number for each symbol."""
    if data.dtype.itemsize == 1:
        return _BYTE[data]
    wide = data.astype(np.uint64) * _BYTE[0] + _BYTE[1]
    return (wide ^ (wide >> np.uint64(31))) * _BYTE[2]


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` symbols that start at each place, by doubling."""
    whole, total, at, step = None, 0, _spread(data), 0
    width = 1
    while True:
        if size & width:
            whole = at if whole is None else whole[: len(data) - total - width + 1] * _STEP[20 + step] + at[total:]
            total += width
        if total == size:
            break
        at = at[:-width] * _STEP[step] + at[width:]
        width, step = 2 * width, step + 1
    whole = (whole ^ (whole >> np.uint64(29))) * _STEP[39]
    return whole ^ (whole >> np.uint64(32))


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(
    data: np.ndarray, starts: np.ndarray, counts: np.ndarray, span: int, anchor: int = BYTES.anchor
) -> tuple[np.ndarray, ...]:
    """Segments (first window, windows, anchor hash) of pieces laid end to end.

    Piece i begins at starts[i] and has counts[i] windows, all of its symbols being in data.
    """
    gram = min(anchor, span)
    hashes = _rolling(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    anchors = _sliding_min((hashes & ~_PLACE) | places, span - gram + 1) & _PLACE
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(starts, counts) + inner
    own = anchors[windows]
    fresh = np.concatenate([[True], own[1:] != own[:-1]]) | (inner == 0)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(own)))
    return windows[first], sizes, hashes[own[first].astype(np.int64)]


def _segment_rows(span: int, symbols: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("bytes")
            held: list[tuple[int, int, int, np.ndarray]] = []
            size = 0
            for row in range(batch.num_rows):
                data = symbols.array(values[row].as_buffer())
                windows = len(data) - span + 1
                for start in range(0, windows, _BLOCK):
                    count = min(_BLOCK, windows - start)
                    held.append((row, start, count, data[start : start + count + span - 1]))
                    size += count + span
                    if size >= _BLOCK:
                        yield _flush(batch, held, span, symbols)
                        held, size = [], 0
            if held:
                yield _flush(batch, held, span, symbols)

    return run


def _flush(
    batch: pa.RecordBatch, held: list[tuple[int, int, int, np.ndarray]], span: int, symbols: Symbols
) -> pa.RecordBatch:
    data = np.concatenate([h[3] for h in held])
    starts = np.cumsum([0] + [len(h[3]) for h in held[:-1]])
    counts = np.array([h[2] for h in held])
    first, sizes, keys = segments_of(data, starts, counts, span, symbols.anchor)
    view = memoryview(data.view(np.uint8))
    edges = zip((symbols.size * first).tolist(), (symbols.size * (first + sizes + span - 1)).tolist(), strict=True)
    kinds = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in edges]
    piece = np.searchsorted(starts, first, "right") - 1
    rows = pa.array(np.array([h[0] for h in held])[piece])
    inside = first - starts[piece] + np.array([h[1] for h in held])[piece]
    arrays = [
        batch.column("doc_id").take(rows),
        batch.column("tag").take(rows),
        pa.array(keys.view(np.int64)),
        pa.array(np.array(kinds, np.uint64).view(np.int64)),
        pa.array(inside, pa.int64()),
        pa.array(sizes, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "key", "kind", "start", "n"])


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols or more, and the rank of each.

    Larsson-Sadakane: the first 8 bytes give the first order; a round doubles the depth
    and sorts anew only inside groups that are still tied.
    """
    n = len(data)
    keys = np.zeros(n, np.uint64)
    at_once = 8 // data.dtype.itemsize
    for i in range(at_once):
        keys <<= np.uint64(64 // at_once)
        keys[: n - i] |= data[i:].astype(np.uint64)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = at_once
    while h < depth:
        ends = np.concatenate([fresh[1:], [True]])
        tied = np.flatnonzero(~(fresh & ends))
        if not len(tied):
            break
        at = order[tied]
        beyond = at + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = group[tied] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[tied] = at[by]
        both = both[by]
        # a tied place begins a group where its pair of ranks differs from the one before
        fresh[tied] = np.concatenate([[True], both[1:] != both[:-1]])
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        h *= 2
    return order, rank


def repeated_windows(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all segments, in order: is it repeated, and which are equal.

    The second result numbers kinds of windows in suffix order.
    """
    order, rank = suffix_array(data, span)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(starts, counts) + inner
    # suffixes that do not begin a window lie between: keep the order of windows alone
    by = np.argsort(rank[windows], kind="stable") if len(windows) else np.empty(0, np.int64)
    common = _kasai(data, windows, by, counts, span)
    joined = common[by] >= span
    kind = np.empty(len(windows), np.int64)
    kind[by] = np.cumsum(~joined)
    size = np.bincount(kind, minlength=1)
    return size[kind] > 1, kind


def _kasai(data: np.ndarray, windows: np.ndarray, by: np.ndarray, counts: np.ndarray, span: int) -> np.ndarray:
    """Symbols that each window shares with the one before it in suffix order, `span` at most.

    Kasai's walk takes the windows of a segment in text order: one symbol further, all but
    one of the shared ones remain shared, if the window before has a successor that still
    stands before. All segments walk in step.
    """
    at_once = 8 // data.dtype.itemsize
    bits = 64 // at_once
    eight = np.zeros(len(data) + 8, np.uint64)
    for i in range(at_once):
        eight[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(bits * i)
    first = np.cumsum(counts) - counts
    place = np.empty(len(windows), np.int64)
    place[by] = np.arange(len(by))
    before = np.full(len(windows), -1)
    before[by[1:]] = by[:-1]
    final = np.zeros(len(windows), bool)
    final[first + counts - 1] = True
    common = np.zeros(len(windows), np.int64)
    longest = np.argsort(-counts, kind="stable")
    sizes = -counts[longest]
    for step in range(int(counts.max(initial=0))):
        at = first[longest[: np.searchsorted(sizes, -step, "left")]] + step
        near = before[at]
        shared = np.zeros(len(at), np.int64)
        if step:
            old = before[at - 1]
            carries = np.flatnonzero((old >= 0) & ~final[old])
            carries = carries[place[old[carries] + 1] < place[at[carries]]]
            shared[carries] = np.maximum(common[at[carries] - 1] - 1, 0)
        a, b = windows[at], windows[near]
        going = np.flatnonzero((near >= 0) & (shared < span))
        while len(going):
            differs = eight[a[going] + shared[going]] ^ eight[b[going] + shared[going]]
            low = differs & (~differs + np.uint64(1))
            same = np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // bits
            more = np.where(differs == 0, at_once, same)
            shared[going] += more
            going = going[(more == at_once) & (shared[going] < span)]
        common[at] = np.minimum(shared, span)
    return common


_SHARD_BYTES = 1 << 21


def _shard_rows(span: int, symbols: Symbols):
    """Repeated windows of shards, and sorted slices of hashes of those that are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            sizes = [len(v.as_buffer()) for v in batch.column("bytes")]
            begin = 0
            for row, key in enumerate(keys):
                if key != last and size >= _SHARD_BYTES:
                    held.append(batch.slice(begin, row - begin))
                    yield from _shard(pa.Table.from_batches(held), span, symbols)
                    held, size, begin = [], 0, row
                last = key
                size += sizes[row]
            held.append(batch.slice(begin))
        if size:
            yield from _shard(pa.Table.from_batches(held), span, symbols)

    return run


_FOUND = ["doc_id", "tag", "start", "n", "key", "slice", "hashes", "ids", "tags", "starts"]


def _shard(table: pa.Table, span: int, symbols: Symbols) -> Iterator[pa.RecordBatch]:
    # a kind may come several times, if rows are repeated: one of each is enough
    names = np.stack([table.column(c).to_numpy() for c in ("key", "kind")])
    first = np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)])
    table = table.filter(pa.array(first)).combine_chunks()
    column = {c: (table.column(c).chunk(0) if table.num_rows else table.column(c)) for c in table.column_names}
    parts = [symbols.array(v.as_buffer()) for v in column["bytes"]]
    data = np.concatenate(parts)
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    counts = lengths - span + 1
    repeated, kind = repeated_windows(data, starts, counts, span)
    segment = np.repeat(np.arange(len(parts)), counts)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    place += column["start"].to_numpy()[segment]
    once = (column["copies"].to_numpy() == 1)[segment]

    # runs of repeated windows of segments that occur once; the others are known to repeat
    hit = np.flatnonzero(repeated & once)
    if len(hit):
        fresh = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(segment[hit]) > 0)])
        first = hit[fresh]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(hit)))
        rows = pa.array(segment[first])
        empty = pa.nulls(len(first))
        arrays = [column["doc_id"].take(rows), column["tag"].take(rows), pa.array(place[first]), pa.array(sizes, pa.int32())]
        yield _found(arrays + [empty] * 6, column)

    # split anchors: one hash per kind of window, with its place unless it is known to repeat
    shards = column["shards"].to_numpy()[segment]
    wide = np.flatnonzero(shards > 1)
    if len(wide):
        _, one = np.unique(kind[wide], return_index=True)
        wide = wide[one]
        hashes = _rolling(data, span)[np.repeat(starts, counts)[wide] + (place - column["start"].to_numpy()[segment])[wide]]
        keys = column["key"].to_numpy()[segment[wide]]
        slices = (hashes % shards[wide].astype(np.uint64)).astype(np.int64)
        by = np.lexsort((hashes, slices, keys))
        wide, hashes, keys, slices = wide[by], hashes[by], keys[by], slices[by]
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])]))
        offsets = pa.array(np.append(cuts, len(wide)), pa.int32())
        rows = pa.array(segment[wide])
        known = repeated[wide] | ~once[wide]
        empty = pa.nulls(len(cuts))

        def lists(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, values)

        arrays = [
            empty, empty, empty, empty,
            pa.array(keys[cuts]), pa.array(slices[cuts]),
            lists(pa.array(hashes.view(np.int64))),
            lists(column["doc_id"].take(rows)), lists(column["tag"].take(rows)),
            lists(pa.array(np.where(known, -1, place[wide]))),
        ]
        yield _found(arrays, column)


def _found(arrays: list[pa.Array], column: dict[str, pa.Array]) -> pa.RecordBatch:
    own = column["doc_id"].type
    longs = pa.list_(pa.int64())
    kinds = [own, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), longs, pa.list_(own), longs, longs]
    return pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(arrays, kinds, strict=True)], _FOUND)


def _merge_slice(table: pa.Table) -> pa.Table:
    """Windows whose hash two shards hold, by binary search in all the sorted hashes."""

    def flat(name: str) -> pa.Array:
        return pa.concat_arrays([chunk.flatten() for chunk in table.column(name).chunks])

    hashes = flat("hashes").to_numpy(zero_copy_only=False)
    ordered = np.sort(hashes)
    many = np.searchsorted(ordered, hashes, "right") - np.searchsorted(ordered, hashes, "left") > 1
    starts = flat("starts").to_numpy(zero_copy_only=False)
    rows = pa.array(np.flatnonzero(many & (starts >= 0)))
    own = [flat("ids").take(rows), flat("tags").take(rows), pa.array(starts).take(rows), pa.array(np.ones(len(rows)), pa.int32())]
    return pa.Table.from_arrays(own, ["doc_id", "tag", "start", "n"])


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column bytes with each word replaced by its code."""
    known = _WordCodes()
    for batch in batches:
        column = batch.schema.get_field_index("bytes")
        codes = [b"".join(map(known.__getitem__, value.as_py().split())) for value in batch.column(column)]
        yield batch.set_column(column, "bytes", pa.array(codes, pa.binary()))


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")[:4]
        return found


_SEGMENT = ["key", "kind", "copies", "start", "n", "shards", "salt"]


def _segment_texts(span: int, symbols: Symbols):
    """The wanted segments (segs) of texts with their symbols, once for rows that a task sees again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordCodes()
        seen: set[tuple] = set()
        for batch in batches:
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            owners, texts, kept = [], [], []
            for row, name in enumerate(zip(ids, tags, strict=True)):
                if name in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(name)
                kept.append(row)
                data = batch.column("bytes")[row].as_py()
                if symbols == WORDS:
                    data = b"".join(map(known.__getitem__, data.split()))
                segs = batch.column("segs").slice(row, 1).flatten()
                starts = symbols.size * segs.field("start").to_numpy()
                stops = starts + symbols.size * (segs.field("n").to_numpy() + (span - 1))
                texts.extend(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
                owners.extend([row] * len(segs))
            if not kept:
                continue
            segs = batch.column("segs").take(pa.array(kept)).flatten()
            rows = pa.array(owners)
            arrays = [batch.column("doc_id").take(rows), batch.column("tag").take(rows)]
            arrays += [segs.field(c) for c in _SEGMENT]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary())], ["doc_id", "tag", *_SEGMENT, "bytes"])

    return run


def repeated_ranges(rows: DataFrame, span: int = SPAN, shard_segments: int = 256, symbols: Symbols = BYTES) -> DataFrame:
    """Runs of repeated windows (doc_id, tag, start, n) of rows (doc_id, tag, bytes), in symbols."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = f"doc_id {id_type}, tag long, key long, kind long, start long, n int"
    # words and the spaces between them take two bytes each
    least = span if symbols == BYTES else 2 * span - 1
    long_enough = rows.where(F.octet_length("bytes") >= least)

    def coded(df: DataFrame) -> DataFrame:
        return df if symbols == BYTES else df.mapInArrow(_word_codes, df.schema)

    segments = stage(coded(long_enough).mapInArrow(_segment_rows(span, symbols), found), "segments")

    kinds = segments.groupBy("key", "kind").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag", "start", "n")).alias("one")
    )
    kinds = stage(kinds.select("key", "kind", "copies", "one.*"), "kinds")
    copied = kinds.where("copies > 1").select(F.col("key").alias("key_"), F.col("kind").alias("kind_"))
    same = (F.col("key") == F.col("key_")) & (F.col("kind") == F.col("kind_"))
    whole = segments.join(copied, same, "left_semi").select("doc_id", "tag", "start", "n")

    # anchors with different segments: fetch one of each kind and compare windows
    anchors = kinds.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("kinds_")).where("kinds_ > 1")
    split = kinds.join(anchors, F.col("key") == F.col("key_")).select(
        F.struct(
            "key",
            "kind",
            "copies",
            "start",
            "n",
            F.ceil(F.col("kinds_") / shard_segments).cast("int").alias("shards"),
            F.pmod("kind", F.ceil(F.col("kinds_") / shard_segments)).cast("int").alias("salt"),
        ).alias("seg"),
        F.col("doc_id").alias("doc_id_"),
        F.col("tag").alias("tag_"),
    )
    wanted = split.groupBy("doc_id_", "tag_").agg(F.collect_list("seg").alias("segs"))

    texts = long_enough.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("tag") == F.col("tag_")))
    fetched = texts.select("doc_id", "tag", "bytes", "segs").mapInArrow(
        _segment_texts(span, symbols),
        f"doc_id {id_type}, tag long, key long, kind long, copies long, start long, n int, shards int, salt int, bytes binary",
    )
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = fetched.repartition(many, "key", "salt").sortWithinPartitions("key", "salt", "kind")
    found = (
        f"doc_id {id_type}, tag long, start long, n int, key long, slice long, hashes array<bigint>, "
        f"ids array<{id_type}>, tags array<bigint>, starts array<bigint>"
    )
    shards = stage(sharded.mapInArrow(_shard_rows(span, symbols), found), "shards")
    inside = shards.where("key is null").select("doc_id", "tag", "start", "n")
    slices = shards.where("key is not null").select("key", "slice", "hashes", "ids", "tags", "starts")
    across = slices.groupBy("key", "slice").applyInArrow(_merge_slice, f"doc_id {id_type}, tag long, start long, n int")
    return whole.unionByName(inside).unionByName(across)


def _merged(ranges: list[dict], span: int) -> list[tuple[int, int]]:
    """The stretches that runs of windows cover, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in ranges):
        stop = start + n + span - 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _in_bytes(data: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as stretches of bytes, from a first word's start to a last one's end."""
    if not stretches:
        return []
    words = [m.span() for m in _WORD.finditer(data)]
    return [(words[a][0], words[b - 1][1]) for a, b in stretches]


def _cut(
    rows: DataFrame, ranges: DataFrame, span: int, carried: str, data: Column, symbols: Symbols = BYTES
) -> DataFrame:
    """Column `carried` of rows, with n_bytes, n_removed, n_spans, spans (in bytes) and kept.

    `data` is the bytes of a row. Where words are cut, kept is text.
    """
    as_text = symbols == WORDS
    owned = ranges.groupBy(F.col("doc_id").alias("doc_id_"), F.col("tag").alias("tag_")).agg(
        F.collect_set(F.struct("start", "n")).alias("ranges")
    )
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("tag") == F.col("tag_"))
    joined = rows.join(owned, same, "left").select(carried, data.alias("bytes"), "ranges")
    kind = rows.schema[carried].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, spans = [], [], []
            for value, found in zip(batch.column("bytes"), batch.column("ranges"), strict=True):
                data = value.as_py()
                cut = _merged(found.as_py() or [], span)
                if as_text:
                    cut = _in_bytes(data, cut)
                edges = [0, *(x for pair in cut for x in pair), len(data)]
                parts = [data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
                counts.append((len(data), len(data) - sum(map(len, parts)), len(cut)))
                kept.append("".join(p.decode() for p in parts) if as_text else b"".join(parts))
                spans.append([{"start": a, "stop": b} for a, b in cut])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            arrays = [batch.column(carried), *numbers, pa.array(spans, span_type)]
            arrays.append(pa.array(kept, pa.string() if as_text else pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [carried, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(
        run,
        f"{carried} {kind}, n_bytes long, n_removed long, n_spans long, "
        f"spans array<struct<start:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}",
    )


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tag and bytes, by which rows are told apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("tag"), body.cast("binary").alias("bytes"))


def remove_repeats(
    docs: DataFrame, span: int = SPAN, shard_segments: int = 256, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans, kept (remaining bytes)."""
    rows = _tagged(docs, doc_id, text)
    return _cut(rows, repeated_ranges(rows, span, shard_segments), span, "doc_id", F.col("bytes"))


def without_repeats(docs: DataFrame, words: int = WORD_SPAN, shard_segments: int = 256) -> DataFrame:
    """docs with all repeats of so many words cut out of their texts and n_chars counted anew.

    A cut runs from the start of its first word to the end of its last; the white space
    around it and a null text stay.
    """
    ranges = repeated_ranges(_tagged(docs, "doc_id", "text"), words, shard_segments, WORDS)
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", tag.alias("tag"), F.struct("*").alias("row"))
    data = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    cut = _cut(rows, ranges, words, "row", data, WORDS)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    values = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
