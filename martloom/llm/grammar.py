"""Token-id files compressed by Re-Pair grammars.

Documents are ordered by id over the whole table and cut into shards of about
`shard_ids` token ids. In each shard the most frequent neighbouring ids are replaced by
nonterminals, again and again, until no pair occurs twice without overlap; neither rounds
nor rules are limited. A round takes many pairs at once, the more frequent one where two
overlap. Pairs never reach over the end of a document, so every document starts at a symbol
of its own. A shard stores the rules, the length each one expands to, where its documents
start, and the remaining symbols, with 16 bits a number and as many more as the largest
needs; a range of ids is found by adding up expansion lengths, without decoding what stands
before it.

The files are a Parquet table with one row per shard, whose `payload` is the binary shard.

Defined cases: a null or empty text is the end id alone; null document ids come first;
equal ids are ordered by a hash of their text and repeated rows are stored each; an empty
table gives files without shards; a document longer than a shard fills one of its own.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.llm.presplit import TextIds, library_ids, task_ids

END_ID = 1
SHARD_IDS = 1 << 20
_KNOWN_WORDS = 250_000  # that a worker keeps from task to task
_HEAD = struct.Struct("<4sIIIIQ")
_MAGIC = b"RPG2"


def _grouped(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): places sorted by their pair, and where each pair begins in that order."""
    wide = max(int(left.max()), int(right.max())).bit_length()
    low = len(left).bit_length()
    if 2 * wide + low <= 64:  # a plain sort that carries the places is several times faster than argsort
        pairs = left.astype(np.uint64)
        pairs <<= np.uint64(wide)
        pairs |= right
        pairs <<= np.uint64(low)
        pairs |= np.arange(len(left), dtype=np.uint64)
        pairs.sort()
        order = (pairs & np.uint64((1 << low) - 1)).view(np.int64)
        pairs >>= np.uint64(low)
    else:
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
    return order, np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple:
    """(rules, symbols, starts): rules as an array of pairs, rule r being symbol base + r.

    ends holds the exclusive end of each document in ids; starts, where each begins among
    the symbols. Ends when no pair occurs twice without overlap. The most frequent pair of
    a round is always taken wherever it occurs, so every round makes a rule. A pair that
    occurs once never gets more frequent, as later rules only make pairs with new symbols;
    so a round looks only at places whose pair still repeats or has just changed.
    """
    n = len(ids)
    seq = ids.astype(np.uint32)
    # symbols of a document are chained by position; n stands for none
    after = np.arange(1, n + 1)
    after[ends - 1] = n
    before = np.arange(-1, n)
    before[np.concatenate([[0], ends[:-1]])] = n
    kept = np.ones(n, bool)
    active = np.append(after < n, False)
    rules: list[np.ndarray] = []
    made = 0
    while len(places := np.flatnonzero(active)):
        second = after[places]
        left, right = seq[places], seq[second]
        order, first = _grouped(left, right)
        counts = np.diff(np.append(first, len(places)))
        group = np.empty(len(places), np.int32)
        group[order] = np.repeat(np.arange(len(first), dtype=np.int32), counts)
        odd = _odd_of_runs(group, second[:-1] == places[1:])
        counts -= np.bincount(group[odd], minlength=len(first))
        active[places] = live = (counts >= 2)[group]
        live[odd] = False
        places, second, group = places[live], second[live], group[live]
        take = _apart(_precedence(counts)[group], second[:-1] == places[1:])
        places, group = places[take], group[take]
        used = np.bincount(group, minlength=len(first)) >= 2
        places, group = places[used[group]], group[used[group]]
        fresh = order[first[used]]
        rules.append(np.stack([left[fresh], right[fresh]], 1))
        seq[places] = (base + made - 1 + np.cumsum(used))[group]
        made += len(fresh)
        second = after[places]
        kept[second] = active[second] = False
        after[places] = third = after[second]
        before[third] = places
        active[before[places]] = True
        active[places] = third < n
        active[n] = False
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    first = np.concatenate([[0], ends[:-1]])  # a first symbol is never the second of a pair
    return pairs, seq[kept], (np.cumsum(kept)[first] - 1).astype(np.uint32)


def _precedence(counts: np.ndarray) -> np.ndarray:
    """Distinct numbers, less for more frequent pairs; equally frequent ones are mixed.

    Mixed, as a long passage of pairs in ascending order would else give one rule a round.
    """
    bits = len(counts).bit_length()
    mixed = (np.arange(len(counts)) * (int(0.6180339887 * (1 << bits)) | 1)) & ((1 << bits) - 1)
    return ((counts.max(initial=0) - counts) << bits) | mixed


def _odd_of_runs(group: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Where every second place of a run of one pair (a run of one symbol) stands."""
    same = np.flatnonzero(beside & (group[1:] == group[:-1])) + 1
    at = np.arange(len(same))
    inner = np.concatenate([[False], same[1:] == same[:-1] + 1])[: len(same)]
    return same[(at - np.maximum.accumulate(np.where(inner, 0, at))) % 2 == 0]


def _apart(rank: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Places whose pair goes before both overlapping ones."""
    take = np.ones(len(rank), bool)
    take[1:] &= ~beside | (rank[1:] < rank[:-1])
    take[:-1] &= ~beside | (rank[:-1] < rank[1:])
    return take


def _levels(rules: np.ndarray, base: int) -> Iterator[slice]:
    """Stretches of rules that name earlier stretches only, in order."""
    named = np.maximum.accumulate(rules.max(1).astype(np.int64)) - base if len(rules) else np.empty(0, np.int64)
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(named, start))
        yield slice(start, stop)
        start = stop


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names earlier rules."""
    lengths = np.ones(base + len(rules), np.int64)
    for level in _levels(rules, base):
        lengths[base + level.start : base + level.stop] = lengths[rules[level]].sum(1)
    return lengths[base:]


def _packed(values: np.ndarray, bits: int) -> bytes:
    """Numbers of up to `bits` bits: their low 16 bits, then a plane for each higher one."""
    planes = [np.packbits((values >> b).astype(np.uint8) & 1).tobytes() for b in range(16, bits)]
    return values.astype("<u2").tobytes() + b"".join(planes)


def _unpacked(payload: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    """The packed numbers at a place, and the place behind them."""
    values = np.frombuffer(payload, "<u2", count, at).astype(np.uint32)
    at += 2 * count
    size = -(-count // 8)
    for b in range(16, bits):
        values |= np.unpackbits(np.frombuffer(payload, np.uint8, size, at), count=count).astype(np.uint32) << np.uint32(b)
        at += size
    return values, at


def _expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    out = symbols.astype(np.uint32)
    while len(out) and (big := out >= base).any():
        width = np.where(big, 2, 1)
        at = np.cumsum(width) - width
        wider = np.empty(int(width.sum()), np.uint32)
        wider[at] = out
        pair = rules[out[big] - base]
        wider[at[big]], wider[at[big] + 1] = pair[:, 0], pair[:, 1]
        out = wider
    return out


class Shard:
    """A shard read back: documents or any range of ids, without decoding the rest."""

    def __init__(self, payload: bytes) -> None:
        magic, self.base, n_rules, n_docs, bits, n_symbols = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a grammar shard")
        wide = (self.base + n_rules).bit_length()
        rules, at = _unpacked(payload, _HEAD.size, 2 * n_rules, wide)
        self.rules = rules.reshape(-1, 2)
        self.lengths, at = _unpacked(payload, at, n_rules, bits)
        self.starts = np.frombuffer(payload, "<u4", n_docs, at)
        self.symbols, at = _unpacked(payload, at + self.starts.nbytes, n_symbols, wide)
        each = np.ones(n_symbols, np.int64)
        big = self.symbols >= self.base
        each[big] = self.lengths[self.symbols[big].astype(np.int64) - self.base]
        self._ends = np.cumsum(each)

    def document(self, i: int) -> np.ndarray:
        stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.symbols)
        return _expand(self.symbols[self.starts[i] : stop], self.rules, self.base)

    def documents(self) -> list[np.ndarray]:
        """All documents; the whole shard is expanded at once, from a table of all expansions."""
        width = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        end = np.cumsum(width)
        begin = end - width
        table = np.empty(int(end[-1]), np.uint32)
        table[: self.base] = np.arange(self.base)
        for level in _levels(self.rules, self.base):
            parts = self.rules[level].ravel()
            first, stop = begin[self.base + level.start], end[self.base + level.stop - 1]
            put = np.cumsum(width[parts]) - width[parts]
            table[first:stop] = table[np.repeat(begin[parts] - put, width[parts]) + np.arange(stop - first)]
        before = np.concatenate([[0], self._ends[:-1]])
        shift = np.repeat(begin[self.symbols] - before, width[self.symbols])
        every = table[shift + np.arange(len(shift))]
        first = np.concatenate([[0], self._ends])[self.starts]
        return np.split(every, first[1:])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start or not len(self._ends):
            return np.empty(0, np.uint32)
        a = int(np.searchsorted(self._ends, start, "right"))
        b = int(np.searchsorted(self._ends, stop, "left")) + 1
        skipped = int(self._ends[a - 1]) if a else 0
        return _expand(self.symbols[a:b], self.rules, self.base)[start - skipped : stop - skipped]


def shard_bytes(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    rules, symbols, starts = compress(ids, ends, base)
    lengths = expansion_lengths(rules, base)
    bits, wide = int(lengths.max(initial=0)).bit_length(), (base + len(rules)).bit_length()
    head = _HEAD.pack(_MAGIC, base, len(rules), len(starts), bits, len(symbols))
    return b"".join([head, _packed(rules.ravel(), wide), _packed(lengths, bits), starts.astype("<u4").tobytes(), _packed(symbols, wide)])


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    partitions: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the table of shards (task, shard, n_ids, doc_ids, doc_starts, payload) to path."""
    kind = docs.schema[doc_id].dataType.simpleString()
    many = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    edges = _edges(rows.select("doc_id"), many)
    coded = rows.mapInArrow(_encode(tokenizer, end_id, edges), f"doc_id {kind}, tie long, task int, width int, ids binary")
    ordered = coded.repartitionById(len(edges) + 1, "task").sortWithinPartitions("task", "doc_id", "tie")
    schema = f"task int, shard int, n_ids long, doc_ids array<{kind}>, doc_starts array<bigint>, payload binary"
    base = library_ids(tokenizer).size
    ordered.mapInArrow(_shards(schema, base, shard_ids), schema).write.parquet(path)


def _edges(ids: DataFrame, many: int) -> list:
    """The least id of each of `many` ranges but the first; reads the ids alone."""
    ranges = ids.where("doc_id is not null").repartitionByRange(many, "doc_id")
    least = ranges.groupBy(F.spark_partition_id().alias("task")).agg(F.min("doc_id").alias("least"))
    return sorted(r["least"] for r in least.collect())[1:]


def _encode(tokenizer: str, end_id: int, edges: list):
    """Rows with their range as task and their ids, two bytes each where all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_ids(tokenizer, words=_KNOWN_WORDS) as encoder:
            yield from coded_rows(encoder, batches)

    def coded_rows(encoder: TextIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, counts in encoder.many(batch.column("text")):
                own = batch.slice(at, len(counts))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                width = 2 if ids.max() < 1 << 16 else 4
                edge = np.concatenate([[0], width * (ends + np.arange(1, len(ends) + 1))]).astype(np.int32)
                buffers = [None, pa.py_buffer(edge), pa.py_buffer(ids.astype(f"<u{width}"))]
                tasks = [0 if x is None else bisect_right(edges, x) for x in own.column("doc_id").to_pylist()]
                arrays = [own.column("doc_id"), own.column("tie"), pa.array(tasks, pa.int32())]
                arrays += [pa.array([width] * len(ends), pa.int32()), pa.Array.from_buffers(pa.binary(), len(ends), buffers)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tie", "task", "width", "ids"])

    return run


def _shards(schema: str, base: int, shard_ids: int):
    """Shards of a range's documents, in their order; a range lies in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = shard = held = 0
        owners: list = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            payload = shard_bytes(np.concatenate(parts), ends, base)
            values = [[task], [shard], [int(ends[-1])], [owners], [[0, *ends[:-1].tolist()]], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "task", "width", "ids"))
            for owner, own_task, width, packed in zip(*columns, strict=True):
                ids = np.frombuffer(packed, f"<u{width}").astype(np.uint32)
                if parts and (held + len(ids) > shard_ids or own_task != task):
                    yield flush()
                    shard = shard + 1 if own_task == task else 0
                    owners, parts, held = [], [], 0
                task = own_task
                owners.append(owner)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids before it), n_tokens, ids (packed)."""
    shards = spark.read.parquet(path)
    # ids before a shard: those of earlier tasks (a row a task), then of its task's earlier shards
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("all_ids"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("task").alias("task_"), F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select(
        F.col("task").alias("task_"), F.col("shard").alias("shard_"), F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own")
    )
    places = places.join(tasks, "task_")
    same = (F.col("task") == F.col("task_")) & (F.col("shard") == F.col("shard_"))
    placed = shards.join(places, same).select((F.col("base") + F.col("own")).alias("first"), "doc_ids", "doc_starts", "n_ids", "payload")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("payload")[row].as_py())
                first = batch.column("first")[row].as_py()
                starts = [first + s.as_py() for s in batch.column("doc_starts")[row].values]
                ids = [x.astype("<u4").tobytes() for x in shard.documents()]
                counts = [len(x) // 4 for x in ids]
                arrays = [batch.column("doc_ids")[row].values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
                arrays.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")
