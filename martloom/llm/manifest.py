"""A Merkle manifest of a dataset, kept as a postorder append log.

Each row is a leaf: the hash of its columns, each `-` if null and else its length in UTF-8
bytes, `:` and its value. The leaves of a stratum ascend by id; every two consecutive nodes
become their parent, a last one alone too, until the subroot remains. The subroots, in the
order of their strata, become the root in the same way.

Leaves are ranked by Spark's range sort and dealt to aligned builders of 2 ** `bits` leaves.
A builder appends each node when it is complete, so a subtree fills one stretch of the log
and the place of any node follows from the sizes of the subtrees before it: `place`. What
the builders leave are the leaves of the next tier. A proof walks the tiers from the root
down: each builder reads the siblings of its leaves at their places and adds the way from
its own root. A task holds one builder's rows, never a stratum.

Defined cases: null and empty values differ; a null stratum is a stratum of its own, before
all others; null ids come first; rows with one id are ordered by their leaves, so repeated
rows are neighbours with equal leaves; a lone leaf is its subroot and has no siblings; an
empty table has no leaves and no root; long texts are hashed whole; columns other than those
named stay out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12
_ROW_BITS = 33


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def size(leaves: int, height: int) -> int:
    """Nodes of a tree of this height over so many leaves."""
    return sum((leaves + (1 << level) - 1) >> level for level in range(height + 1))


def place(level: int, index: int, leaves: int) -> int:
    """Where a builder's log has the node that is `index` on its level.

    Complete trees over m leaves to its left have 2 m less the ones of m in binary nodes;
    then come the node's own subtree and, last in it, the node.
    """
    before = index << level
    own = min(1 << level, leaves - before)
    return 2 * before - before.bit_count() + size(own, level) - 1


def build(leaves: list[str], height: int) -> list[str]:
    """The nodes over the leaves in the order in which they are completed."""
    log: list[str] = []
    waiting: list[str | None] = [None] * (height + 1)
    for node in leaves:
        log.append(node)
        level = 0
        while level < height and waiting[level] is not None:
            node = _digest(waiting[level] + node)
            waiting[level] = None
            log.append(node)
            level += 1
        waiting[level] = node
    # the right edge: nodes that wait for a neighbour in vain
    last = None
    for level in range(height):
        if waiting[level] is None and last is None:
            continue
        last = _digest((waiting[level] or "") + (last or ""))
        log.append(last)
    return log


def paths(log: list[str], leaves: int, height: int, above: str) -> list[str]:
    """For each leaf its way to the root: `L` or `R` and a sibling, or `-` for none, by level."""
    ways = [above]
    for level in range(height - 1, -1, -1):
        row = []
        for index in range((leaves + (1 << level) - 1) >> level):
            other = index ^ 1
            if other << level < leaves:
                step = ("L" if other < index else "R") + log[place(level, other, leaves)]
            else:
                step = "-"
            row.append(step + ways[index >> 1])
        ways = row
    return ways


def siblings(way: str) -> str:
    """The siblings on a way, one after the other."""
    return way.replace("L", "").replace("R", "").replace("-", "")


def fold(leaf: str, way: str) -> str:
    """The root to which a leaf and its siblings lead."""
    node, at = leaf, 0
    while at < len(way):
        side = way[at]
        if side == "-":
            node, at = _digest(node), at + 1
            continue
        other = way[at + 1 : at + 65]
        node, at = _digest(other + node if side == "L" else node + other), at + 65
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    known = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(known, F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    """The leaf of a row with these values."""
    return F.sha2(F.concat(*map(_field, values.values())), 256)


@dataclass
class Manifest:
    """The log by tiers, leaves first, and the root as a one-row table (none if empty).

    Tables of the log: key, block, n (leaves of the block), total (of the key in this
    tier), height, nodes (hex digests in the order of completion), rows (what the leaves
    carry; first tier only). `strata` tiers come first, `top` tiers stand on the subroots.
    """

    strata: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: DataFrame


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank (from 0) and total within their key; rows are sorted by key and order."""
    placed = stage(
        rows.orderBy("key", *order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", _ROW_BITS)),
        "placed",
    )
    parts = placed.groupBy("part", "key").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    keys = Window.partitionBy("key")
    before = keys.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("part").alias("part_"),
        F.col("key").alias("key_"),
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(keys).alias("total"),
    )
    joined = placed.join(parts, (F.col("part") == F.col("part_")) & (F.col("key") == F.col("key_")))
    return joined.withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "part_", "key_", "shift")


def _build_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                leaves = batch.column("leaves")[row].as_py()
                total = batch.column("total")[row].as_py()
                height = min(bits, (total - 1).bit_length())
                nodes = build(leaves, height)
                own = batch.slice(row, 1)
                arrays = [own.column(c) for c in ("key", "block", "total")]
                arrays += [pa.array([len(leaves)], pa.int32()), pa.array([height], pa.int32())]
                arrays += [pa.array([nodes], pa.list_(pa.string())), pa.array([nodes[-1]]), own.column("rows")]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["key", "block", "total", "n", "height", "nodes", "last", "rows"]
                )

    return run


def _tiers(leaves: DataFrame, carried: str, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Logs of all tiers over leaves (key, rank, total, leaf, carry), and roots (key, root)."""
    tiers: list[DataFrame] = []
    roots = None
    level = leaves
    while True:
        row = F.struct("rank", "leaf", "carry")
        blocks = (
            level.groupBy("key", F.shiftright("rank", bits).alias("block"))
            .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(row)).alias("members"))
            .select("key", "block", "total", F.col("members.leaf").alias("leaves"), F.col("members.carry").alias("rows"))
        )
        schema = (
            "key string, block long, total long, n int, height int, nodes array<string>, last string, "
            f"rows array<{carried}>"
        )
        built = stage(blocks.mapInArrow(_build_rows(bits), schema), "tier")
        tiers.append(built)
        done = built.where(F.col("total") <= 1 << bits).select("key", F.col("last").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        more = built.where(F.col("total") > 1 << bits)
        if more.isEmpty():
            return tiers, roots
        level = more.select(
            "key",
            F.col("block").alias("rank"),
            F.ceil(F.col("total") / (1 << bits)).cast("long").alias("total"),
            F.col("last").alias("leaf"),
            F.lit(None).cast(carried).alias("carry"),
        )


def write_manifest(rows: DataFrame, carry: Column, order: Column, stratum: str | Column, leaf: Column, bits: int = BITS) -> Manifest:
    """The log over rows: `leaf` by `order` within `stratum`; `carry` stays with its leaf."""
    key = F.col(stratum) if isinstance(stratum, str) else stratum
    # null before every text, and the order of bytes kept
    key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    bare = stage(rows.select(key.alias("key"), order.alias("place_"), leaf.alias("leaf"), carry.alias("carry")), "leaves")
    carried = bare.schema["carry"].dataType.simpleString()
    strata, subroots = _tiers(_ranked(bare, "place_", "leaf").drop("place_"), carried, bits)
    subroots = stage(subroots, "subroots")
    tops = subroots.select(F.lit("").alias("key"), F.col("key").alias("carry"), F.col("root").alias("leaf"))
    top, root = _tiers(_ranked(tops, "carry"), "string", bits)
    return Manifest(strata, top, subroots, stage(root.select("root"), "root"))


def _way_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each leaf of a block: key, place in the tier, carry, leaf and way."""
    for batch in batches:
        for row in range(batch.num_rows):
            n, height = (batch.column(c)[row].as_py() for c in ("n", "height"))
            log = batch.column("nodes")[row].as_py()
            ways = paths(log, n, height, batch.column("above")[row].as_py() or "")
            first = batch.column("first")[row].as_py()
            carried = batch.column("rows").slice(row, 1).flatten()
            leaves = [log[place(0, i, n)] for i in range(n)]
            arrays = [pa.array([batch.column("key")[row].as_py()] * n, pa.string()), pa.array(range(first, first + n), pa.int64())]
            arrays += [carried, pa.array(leaves), pa.array(ways)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "rank", "carry", "leaf", "way"])


def _ways_of(tier: DataFrame, above: DataFrame | None, bits: int) -> DataFrame:
    """Ways of a tier's leaves, given the ways (key, rank, way) of its blocks' roots."""
    carried = tier.schema["rows"].dataType.elementType.simpleString()
    bare = tier.drop("last").withColumn("first", F.shiftleft("block", bits))
    if above is None:
        bare = bare.withColumn("above", F.lit(""))
    else:
        ways = above.select(F.col("key").alias("key_"), F.col("rank").alias("rank_"), F.col("way").alias("above"))
        bare = bare.join(ways, (F.col("key") == F.col("key_")) & (F.col("block") == F.col("rank_")), "left")
    columns = ["key", "first", "n", "height", "nodes", "rows", "above"]
    return bare.select(*columns).mapInArrow(_way_rows, f"key string, rank long, carry {carried}, leaf string, way string")


def proofs(manifest: Manifest, bits: int = BITS) -> DataFrame:
    """Each leaf with its way to the root: carry, leaf, subroot, root, way."""
    above = None
    for tier in reversed(manifest.top):
        above = _ways_of(tier, above, bits)
    # the subroots' ways, each at the place of its stratum's single root
    above = stage(above.select(F.col("carry").alias("key"), F.lit(0).cast("long").alias("rank"), "way"), "ways")
    for tier in reversed(manifest.strata[1:]):
        # a stratum's own top tier hangs on its subroot, lower ones on blocks above them
        above = stage(_ways_of(tier, above, bits).select("key", "rank", "way").unionByName(_finished(above, tier)), "ways")
    ways = _ways_of(manifest.strata[0], above, bits)
    subroots = manifest.subroots.select(F.col("key").alias("key_"), F.col("root").alias("subroot"))
    joined = ways.join(subroots, F.col("key") == F.col("key_"))
    return joined.select("carry", "leaf", "subroot", manifest.root.select("root").scalar().alias("root"), "way")


def _finished(above: DataFrame, tier: DataFrame) -> DataFrame:
    """Ways of strata that this tier does not reach: their root lies below."""
    return above.join(tier.select("key").distinct(), "key", "left_anti").select("key", "rank", "way")


def _check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = batch.column("way").to_pylist()
        offered = batch.column("offered").to_pylist()
        roots = batch.column("root").to_pylist()
        proof = [_digest(siblings(way)) for way in ways]
        folded = [fold(leaf, way) for leaf, way in zip(offered, ways, strict=True)]
        arrays = [batch.column(c) for c in ("id", "leaf", "subroot", "root")]
        arrays += [pa.array(proof), pa.array(folded), pa.array([f == r for f, r in zip(folded, roots, strict=True)])]
        yield pa.RecordBatch.from_arrays(
            arrays, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        )


def check_proofs(proved: DataFrame, doc_id: Column, offered: Column) -> DataFrame:
    """Fold each offered leaf along its proof: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = proved.select(doc_id.alias("id"), offered.alias("offered"), "leaf", "subroot", "root", "way")
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return rows.mapInArrow(_check_rows, schema)


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Prove every document's leaf, with n_chars raised by 1 where 7 divides the crc32 of its id."""
    values = {c: F.col(c) for c in COLUMNS}
    changed = leaf_of(values | {"n_chars": F.col("n_chars") + 1})
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    carry = F.struct("doc_id", F.when(hit, changed).alias("changed"))
    manifest = write_manifest(docs, carry, F.col("doc_id"), "lang", leaf_of(values), bits)
    offered = F.coalesce("carry.changed", "leaf")
    return check_proofs(proofs(manifest, bits), F.col("carry.doc_id"), offered).withColumnRenamed("id", "doc_id")
