"""Exact top-k inner product search by vector-approximation files.

Components become whole numbers first. The file has one row per distinct vector: one byte
per component, the cell of an equal-width grid of 256 cells, and the exact vector in a
column of its own. A search scans the bytes alone and bounds every score by the cell's
edges. Vectors whose upper bound reaches the kth best lower bound stay; of them the exact
vectors are read in the order of their upper bounds, `READ_FIRST * k` at first, and then
those that the kth exact score so far does not rule out.

Queries are taken in blocks of about `block` rows, each scanned against the whole file, so
what is sent to every task has a fixed size.

Defined cases: a null vector, one with a null or non-finite component, and one without an id
take no part; queries meet vectors of their own length only; equal vectors are one row of
the file with their k + 1 least ids, k rows of each at most, the only ones that can be among
k results besides a query's own rows; vectors that only a query's own id has take no place
in its bounds; an id with several vectors asks with the shortest, of these the least; equal
scores go to the smaller id; repeated rows count each; numbers beyond 64 bits are cut to their range;
an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import stage

CELLS = 256
READ_FIRST = 2
_EXACT = 1 << 53


def whole_vectors(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dims, exact): floor(scale * component) of the vectors that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    usable = vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.size(embedding).alias("dims"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("exact"),
    )


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value per length and place, of one task."""
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for dims, rows in _by_length(batch):
            values = _matrix(batch.column("exact").take(pa.array(rows)), dims)
            low, high = values.min(0), values.max(0)
            if dims in found:
                low, high = np.minimum(low, found[dims][0]), np.maximum(high, found[dims][1])
            found[dims] = [low, high]
    for dims, (low, high) in found.items():
        columns = [np.full(dims, dims), np.arange(dims), low, high]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dims", "place", "low", "high"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    lengths = batch.column("dims").to_numpy()
    for dims in np.unique(lengths).tolist():
        if dims:
            yield dims, np.flatnonzero(lengths == dims)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Grid:
    """Cell edges per length: cells of 2 ** shift whole numbers from low on."""

    def __init__(self, rows: list) -> None:
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["dims"], r["place"])):
            by.setdefault(r["dims"], []).append(r)
        self.low = {d: np.array([r["low"] for r in rs], np.int64) for d, rs in by.items()}
        self.shift = {
            d: np.array([max(0, int(r["high"] - r["low"]).bit_length() - 8) for r in rs], np.int64) for d, rs in by.items()
        }

    def cells(self, values: np.ndarray) -> np.ndarray:
        dims = values.shape[1]
        # the difference may pass 63 bits, never 64
        away = values.astype(np.uint64) - self.low[dims].astype(np.uint64)
        return (away >> self.shift[dims].astype(np.uint64)).astype(np.uint8)

    def centres(self, cells: np.ndarray) -> np.ndarray:
        dims = cells.shape[1]
        width = np.exp2(self.shift[dims])
        return self.low[dims] + cells * width + (width - 1) / 2

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """How far a score can lie from that of its cell's centre, rounding included."""
        dims = queries.shape[1]
        width = np.exp2(self.shift[dims])
        size = np.abs(queries.astype(np.float64))
        reach = np.abs(self.low[dims].astype(np.float64)) + CELLS * width
        return size @ ((width - 1) / 2) + (size @ reach) * (dims + 4) * 2.0**-50


def build_file(whole: DataFrame, k: int) -> tuple[DataFrame, Grid]:
    """The staged approximation file (key, dims, cells, exact, ids, only), and its grid.

    only is the id of a vector that no other id has.
    """
    order = Window.partitionBy("key").orderBy("vec_id")
    copies = Window.partitionBy("key", "vec_id").orderBy("dims")
    keyed = whole.withColumn("key", F.md5(F.array_join("exact", ",").cast("binary")))
    few = keyed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    nearest = few.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k + 1)
    alone = F.when(F.min("vec_id") == F.max("vec_id"), F.min("vec_id"))
    distinct = stage(
        nearest.groupBy("key").agg(
            F.any_value("dims").alias("dims"),
            F.any_value("exact").alias("exact"),
            F.sort_array(F.collect_list("vec_id")).alias("ids"),
            alone.alias("only"),
        ),
        "vectors",
    )
    extremes = distinct.select("dims", "exact").mapInArrow(_extremes, "dims long, place long, low long, high long")
    # as many rows as the lengths of vectors have places
    grid = Grid(extremes.groupBy("dims", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, rows in _by_length(batch):
                part = batch.take(pa.array(rows))
                cells = grid.cells(_matrix(part.column("exact"), dims))
                packed = pa.array([c.tobytes() for c in cells], pa.binary())
                arrays = [part.column("key"), part.column("dims"), packed, part.column("exact"), part.column("ids"), part.column("only")]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "dims", "cells", "exact", "ids", "only"])

    schema = "key string, dims int, cells binary, exact array<bigint>, ids array<bigint>, only long"
    return stage(distinct.select("key", "dims", "exact", "ids", "only").mapInArrow(quantise, schema), "approximations"), grid


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], grid: Grid, k: int):
    """Vectors that a task cannot rule out: (query_id, key, lower, upper).

    Rows are kept as long as their upper bound reaches the kth best lower bound so far.
    Vectors of the query's own id alone are left out.
    """
    place = {d: {int(i): n for n, i in enumerate(ids)} for d, (ids, _) in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = {d: np.full(len(ids), -np.inf) for d, (ids, _) in queries.items()}
        best = {d: np.full((len(ids), k), -np.inf) for d, (ids, _) in queries.items()}
        for batch in batches:
            for dims, rows in _by_length(batch):
                if dims not in queries:
                    continue
                ids, vectors = queries[dims]
                slack = grid.slack(vectors)
                for at in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[at : at + 2048]))
                    cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, dims)
                    middle = vectors.astype(np.float64) @ grid.centres(cells).T
                    owners = enumerate(part.column("only").to_pylist())
                    own = [(place[dims][i], n) for n, i in owners if i in place[dims]]
                    if own:
                        middle[tuple(np.array(own).T)] = -np.inf
                    joined = np.concatenate([best[dims], middle - slack[:, None]], 1)
                    best[dims] = -np.partition(-joined, k - 1, 1)[:, :k]
                    limit[dims] = best[dims].min(1)
                    q, v = np.nonzero(middle + slack[:, None] >= limit[dims][:, None])
                    centre = middle[q, v]
                    others = np.isfinite(centre)
                    q, v, centre = q[others], v[others], centre[others]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[q]),
                            part.column("key").take(pa.array(v)),
                            pa.array(centre - slack[q]),
                            pa.array(centre + slack[q]),
                        ],
                        ["query_id", "key", "lower", "upper"],
                    )

    return run


def _scores(queries: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Exact scores of (query_id, dims, exact) rows."""
    place = {(d, int(i)): n for d, (ids, _) in queries.items() for n, i in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, rows in _by_length(batch):
                part = batch.take(pa.array(rows))
                values = _matrix(part.column("exact"), dims)
                asked = [place[dims, i] for i in part.column("query_id").to_pylist()]
                wanted = queries[dims][1][asked]
                size = (np.abs(wanted.astype(np.float64)) * np.abs(values.astype(np.float64))).sum(1)
                score = (wanted * values).sum(1)
                for i in np.flatnonzero(size >= _EXACT).tolist():
                    exact = sum(int(a) * int(b) for a, b in zip(wanted[i], values[i], strict=True))
                    score[i] = max(-(1 << 63), min((1 << 63) - 1, exact))
                arrays = [part.column("query_id"), part.column("ids"), pa.array(score), part.column("upper")]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "ids", "score", "upper"])

    return run


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(query, name): the kth best value of each query, or nothing certain if it has fewer."""
    best = Window.partitionBy("query_id").orderBy(F.desc(value))
    top = rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    certain = F.when(F.count("*") == k, F.min(value)).otherwise(F.lit(float("-inf")))
    return top.groupBy(F.col("query_id").alias("query")).agg(certain.alias(name))


def _search_block(file: DataFrame, grid: Grid, block: list, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the vectors that can be among the k best of a block."""
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {r["dims"] for r in block}:
        own = [r for r in block if r["dims"] == dims]
        queries[dims] = (np.array([r["vec_id"] for r in own]), np.array([r["exact"] for r in own], np.int64))
    scanned = file.select("key", "dims", "cells", "only").mapInArrow(
        _scan(queries, grid, k), "query_id long, key string, lower double, upper double"
    )
    scanned = stage(scanned, "bounds")
    limits = _kth(scanned, "lower", k, "limit")
    open_ = scanned.join(limits, F.col("query_id") == F.col("query")).where("upper >= limit")
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key")
    ranked = stage(open_.select("query_id", "key", "upper", F.row_number().over(order).alias("nth")), "ranked")
    exact = file.select(F.col("key").alias("key_"), "dims", "exact", "ids")

    def read(rows: DataFrame) -> DataFrame:
        joined = rows.join(exact, F.col("key") == F.col("key_")).select("query_id", "dims", "exact", "ids", "upper")
        return joined.mapInArrow(_scores(queries), "query_id long, ids array<bigint>, score long, upper double")

    first = stage(read(ranked.where(F.col("nth") <= READ_FIRST * k)), "scores")
    certain = _kth(first, "score", k, "sure")
    rest = ranked.where(F.col("nth") > READ_FIRST * k).join(certain, F.col("query_id") == F.col("query"), "left")
    second = read(rest.where("sure is null or upper >= sure"))
    hits = first.unionByName(second).select("query_id", F.explode("ids").alias("vec_id"), "score")
    return hits.where("vec_id <> query_id")


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: int = 1024,
    block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query, not itself.

    is_query is a condition on vec_id. Queries go through in blocks of about `block`.
    """
    whole = whole_vectors(vectors, scale, vec_id, embedding)
    file, grid = build_file(whole, k)
    least = whole.where(is_query).where("dims > 0").groupBy("vec_id").agg(F.min(F.struct("dims", "exact")).alias("least"))
    asked = stage(least.select("vec_id", "least.dims", "least.exact"), "queries")
    blocks = -(-asked.count() // block)
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        if rows:
            hits = _search_block(file, grid, rows, k)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = file.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        found = found.where("false")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
