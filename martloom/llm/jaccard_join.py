"""Near-duplicate documents by a chosen-path similarity join on word shingles.

A document is the set of its five-word shingles. Equal sets become one node first. Each set
has `TOKENS` min-hash tokens; two sets share a token with the probability of their Jaccard
similarity. A run starts with all nodes in one bucket; a bucket with more than `bucket`
nodes is split on sampled tokens, 1 / similarity of them on average, so a pair at the
threshold is expected to stay together once per level. Splitting does not part a group of
near copies: where most of a few members of a large bucket agree with one of them, the
pivot, the bucket is not split. Its members are compared with the pivot, and only those that
do not agree with it are compared with all others. Where all large buckets of a level together
hold few pairs, they are compared instead of split. Small buckets at once, large ones in
blocks, are compared by sketches; runs are repeated until a pair at the threshold is missed
with probability 1 - recall at most. What the sketches link forms candidate components,
inside which all pairs are decided exactly, in blocks, on whole shingle sets.

Results: one row per document with its class (documents linked directly or in chains, named
by the least doc_id) and its number of links, copies included.

Defined cases: a text with one to four words is one shingle; a text without words, or null,
is never linked and is a class of its own; repeated rows are copies of each other; null
document ids take part and are named by null only where a class has no other id; an empty
table gives an empty result; long texts count whole; extra columns stay out of `link` and
pass through `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import stage
from martloom.llm.components import components

TOKENS = 64
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _odd(label: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(label) | 1)


_MIX = [_odd(f"mix-{i}") for i in range(8)]
_TOKEN_A = np.array([_odd(f"token-{i}") for i in range(TOKENS)], np.uint64)


@dataclass(frozen=True)
class JoinRules:
    """Similarity as a fraction, target recall, bucket size, depth, sketch agreement, block.

    Large buckets that need no more than few * bucket ** 3 comparisons are not split.
    """

    shared: int = 4
    of: int = 5
    recall: float = 0.999
    bucket: int = 256
    depth: int = 6
    agree: int = 38
    block: int = 1024
    few: int = 4

    @property
    def similarity(self) -> float:
        return self.shared / self.of

    def runs(self) -> int:
        """Runs after which a pair at the threshold has met with the target recall.

        All runs sample the same min-hash tokens, of which a pair shares a binomial number. A
        split keeps the pair with the share of these for each sampled token; meet is the
        probability that some path of full depth keeps it.
        """
        if self.recall >= 1:
            raise ValueError("no number of runs has a recall of 1")
        s, extra = self.similarity, 1 / self.similarity % 1
        shared = np.arange(TOKENS + 1)
        chance = np.array([math.comb(TOKENS, k) * s**k * (1 - s) ** (TOKENS - k) for k in shared.tolist()])
        meet = np.ones(TOKENS + 1)
        for _ in range(self.depth):
            lost = 1 - shared / TOKENS * meet
            meet = 1 - lost ** int(1 / s) * (1 - extra + extra * lost)
        runs = 1
        while chance @ (1 - meet) ** runs > 1 - self.recall:
            runs += 1
        return runs


def _mixed(x: np.ndarray, i: int) -> np.ndarray:
    x = x * _MIX[i]
    x = (x ^ (x >> np.uint64(31))) * _MIX[i + 1]
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(text: bytes, known: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.translate(_WHITE).split(b" ")
    codes = np.array([known[w] for w in words if w], np.uint64)
    if not len(codes):
        return codes
    width = min(size, len(codes))
    total = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        total = total * _MIX[6] + codes[i : len(codes) - width + 1 + i]
    return np.unique(_mixed(total, 4))


def _tokens(shingles: np.ndarray) -> np.ndarray:
    """The min-hash tokens of one set."""
    low = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, ((part[None, :] * _TOKEN_A[:, None]) >> np.uint64(32)).astype(np.uint32).min(1))
    return low


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        nodes, tokens, sketches = [], [], []
        for value in batch.column("bytes"):
            found = shingle_hashes(value.as_py(), known)
            if not len(found):
                nodes.append(None)
                tokens.append(None)
                sketches.append(None)
                continue
            low = _tokens(found)
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
            tokens.append(low.tobytes())
            # one byte of each token is enough to compare
            sketches.append(low.astype(np.uint8).tobytes())
        arrays = [batch.column("doc_id"), batch.column("tag")]
        arrays += [pa.array(x, pa.binary()) for x in (nodes, tokens, sketches)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "node", "tokens", "sketch"])


def _paths(level: int, runs: int):
    """Rows (path, node) one level down; the first level starts every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32).astype(np.uint64)
            if level == 1:
                starts = [np.full(n, r, np.uint64) for r in range(1, runs + 1)]
            else:
                starts = [batch.column("path").to_numpy().view(np.uint64)]
            for path in starts:
                draw = _mixed(path + np.uint64(level), 0)
                first = draw % np.uint64(TOKENS)
                # a second token in a quarter of the buckets: 1 / 0.8 on average
                second = (first + np.uint64(1) + (draw >> np.uint64(8)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
                share = (draw >> np.uint64(40)) & np.uint64(1023)
                for place, rows in ((first, np.arange(n)), (second, np.flatnonzero(share < 256))):
                    at = place[rows]
                    key = _mixed(path[rows] * _MIX[5] + at * _MIX[6] + tokens[rows, at.astype(np.int64)], 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), batch.column("node").take(pa.array(rows))], ["path", "node"]
                    )

    return run


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of sorted rows, with where each group begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < 2048:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cuts = _cuts(joined, keys)
        if len(cuts) > 1:
            yield joined.slice(0, cuts[-1]), cuts[:-1]
            held = [joined.slice(cuts[-1])]
        else:
            held = [joined]
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield joined, _cuts(joined, keys)


def _cuts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = batch.column(key)
        if pa.types.is_binary(column.type):
            codes = column.dictionary_encode().indices.to_numpy()
        else:
            codes = column.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's component of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _agreeing(sketches: np.ndarray, agree: int) -> np.ndarray:
    linked = np.zeros((len(sketches), len(sketches)), bool)
    for i in range(0, len(sketches), 64):
        linked[i : i + 64] = (sketches[i : i + 64, None, :] == sketches[None, :, :]).sum(2, dtype=np.uint8) >= agree
    return linked


def _bucket_edges(agree: int):
    """A spanning forest of the candidate links of each bucket: edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _groups(batches, ["path", "low", "high"]):
            sketches = _matrix(rows.column("sketch"), np.uint8)
            sizes = np.diff(np.append(cuts, rows.num_rows))
            pairs = cuts[sizes == 2]
            same = (sketches[pairs] == sketches[pairs + 1]).sum(1) >= agree
            left, right = [pairs[same]], [pairs[same] + 1]
            for at, size in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                root = _roots(_agreeing(sketches[at : at + size], agree))
                member = np.flatnonzero(root != np.arange(size))
                left.append(at + root[member])
                right.append(at + member)
            nodes = rows.column("node")
            ends = [nodes.take(pa.array(np.concatenate(x))) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return run


_PICKS = 15


def _copy_groups(large: DataFrame, sketches: DataFrame, agree: int) -> DataFrame:
    """Of large buckets (path, node) those of near copies: path_, pivot and its sketch.

    Fifteen members are picked by hash; in a group of near copies more than half of them
    agree with one of them. A bucket more mixed than its picks costs comparisons, but no pair.
    """
    picked = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"pick{i}") for i in range(_PICKS)]
    picks = large.groupBy("path").agg(*picked)
    picks = picks.select(
        F.col("path").alias("path_"), F.posexplode(F.array(*(f"pick{i}" for i in range(_PICKS)))).alias("place", "pick")
    )
    known = picks.join(sketches, F.col("pick") == F.col("node_")).groupBy("path_")
    ordered = known.agg(F.sort_array(F.collect_list(F.struct("place", "pick", "sketch"))).alias("picks"))

    def near(one: Column, other: Column) -> Column:
        def equal(total: Column, i: Column) -> Column:
            a, b = (F.substring(x, i, F.lit(1)) for x in (one["sketch"], other["sketch"]))
            return total + (a == b).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.lit(TOKENS)), F.lit(0), equal) >= agree

    def followed(pick: Column) -> Column:
        followers = F.size(F.filter("picks", lambda other: near(pick, other)))
        return F.struct(followers.alias("followers"), pick.alias("pick"))

    best = ordered.select("path_", F.array_max(F.transform("picks", followed)).alias("best"))
    best = best.where(F.col("best.followers") > _PICKS // 2)
    return best.select("path_", F.col("best.pick.pick").alias("pivot"), F.col("best.pick.sketch").alias("model"))


def _star_rows(agree: int):
    """Rows of near-copy groups, with whether they agree with their pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, model = (_matrix(batch.column(c), np.uint8) for c in ("sketch", "model"))
                near = pa.array((own == model).sum(1) >= agree)
                columns = ["path", "node", "held", "sketch", "pivot"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), near], [*columns, "near"])

    return run


def _cross_edges(agree: int):
    """Candidate links of a group's odd rows with all its rows, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _groups(batches, ["path", "low", "high"]):
            sketches = _matrix(rows.column("sketch"), np.uint8)
            odd = rows.column("odd").to_numpy(zero_copy_only=False)
            left, right = [], []
            for at, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows], strict=True):
                linked = np.zeros((stop - at, stop - at), bool)
                for i in np.flatnonzero(odd[at:stop]):
                    linked[i] = (sketches[at + i] == sketches[at:stop]).sum(1) >= agree
                root = _roots(linked | linked.T)
                member = np.flatnonzero(root != np.arange(stop - at))
                left.append(at + root[member])
                right.append(at + member)
            nodes = rows.column("node")
            ends = [nodes.take(pa.array(np.concatenate(x), pa.int64())) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return run


def _group_edges(members: DataFrame, rules: JoinRules) -> DataFrame:
    """Candidate links of near-copy groups: rows path, node, held, sketch, pivot, model."""
    schema = "path long, node binary, held long, sketch binary, pivot binary, near boolean"
    stars = stage(members.mapInArrow(_star_rows(rules.agree), schema), "stars")
    edges = stars.where("near and node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    odd = stars.where("not near")
    if odd.isEmpty():
        return edges
    counts = odd.groupBy(F.col("path").alias("path_")).agg(F.count("*").alias("odds"))
    counted = stars.join(counts, F.col("path") == F.col("path_")).withColumns(
        {"low_n": F.ceil(F.col("odds") / rules.block).cast("int"), "high_n": F.ceil(F.col("held") / rules.block).cast("int")}
    )

    def dealt(rows: DataFrame, own: str, other: str, is_odd: bool) -> DataFrame:
        # to its own block on one side, and to every block of the other side
        place = F.pmod(F.xxhash64("node"), F.col(f"{own}_n")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1))
        spread = rows.withColumn(own, place).withColumn(other, every).withColumn("odd", F.lit(is_odd))
        return spread.select("path", "low", "high", "node", "sketch", "odd")

    both = dealt(counted.where("not near"), "low", "high", True).unionByName(dealt(counted, "high", "low", False))
    many = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = both.repartition(many, "path", "low", "high").sortWithinPartitions("path", "low", "high")
    return edges.unionByName(groups.mapInArrow(_cross_edges(rules.agree), "u binary, v binary"))


def _in_blocks(rows: DataFrame, count: str, block: int, keys: list[str]) -> DataFrame:
    """rows with low and high: every pair of blocks of a key's rows is a group of its own."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = rows.withColumns({"blocks": blocks, "own": own}).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    spread = spread.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(many, *keys, "low", "high").sortWithinPartitions(*keys, "low", "high")


def _exact(shared: int, of: int):
    """Decide every pair of a group on its shingle sets: links and least linked node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for rows, cuts in _groups(batches, ["root", "low", "high"]):
            out_rows, links, roots = [], [], []
            nodes = rows.column("node").to_pylist()
            own = rows.column("own").to_numpy()
            low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
            weight = rows.column("copies").to_numpy()
            for at, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows], strict=True):
                sets = [shingle_hashes(v.as_py(), known) for v in rows.column("bytes")[at:stop]]
                linked = _similar(sets, shared, of)
                if low[at] != high[at]:
                    # pairs inside a block belong to the group of that block alone
                    linked &= own[at:stop, None] != own[None, at:stop]
                names = nodes[at:stop]
                order = sorted(range(len(names)), key=names.__getitem__)
                root = np.array(order)[_roots(linked[np.ix_(order, order)])[np.argsort(order)]]
                out_rows.extend(range(at, stop))
                links.extend((linked @ weight[at:stop]).tolist())
                roots.extend(names[r] for r in root.tolist())
            arrays = [rows.column("node").take(pa.array(out_rows, pa.int64())), pa.array(links, pa.int64())]
            arrays += [pa.array(roots, pa.binary()), rows.column("blocks").take(pa.array(out_rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "links", "near", "blocks"])

    return run


def _similar(sets: list[np.ndarray], shared: int, of: int) -> np.ndarray:
    """Pairs with Jaccard similarity of shared / of or more, by counting common shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = times[column] > 1
    owner, column = owner[useful], (np.cumsum(times > 1) - 1)[column[useful]]
    common = np.zeros((n, n), np.float64)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T
    # common / (a + b - common) >= shared / of, in whole numbers
    linked = common * (of + shared) >= shared * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    return linked


def _tag(doc_id: str, text: str) -> Column:
    """128 bits by which rows are told apart."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), doc_id, text).alias("b"))


def _nodes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows doc_id, tag, bytes), staged members, and staged nodes: equal sets are one."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        _tag(doc_id, text).alias("tag"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"),
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, tag struct<a:bigint,b:bigint>, node binary, tokens binary, sketch binary"
    members = stage(rows.mapInArrow(_node_rows, schema), "members")
    nodes = (
        members.where("node is not null")
        .groupBy("node")
        .agg(
            F.count("*").alias("copies"),
            # the least id, null ids last
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("one"),
            F.any_value(F.struct("tokens", "sketch")).alias("hashes"),
        )
    )
    nodes = nodes.select("node", "copies", "one.*", "hashes.*")
    return rows, members, stage(nodes, "nodes")


def candidate_edges(nodes: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """Candidate links (u, v) among nodes (node, tokens, sketch): a spanning forest per bucket."""
    tokens = nodes.select(F.col("node").alias("node_"), "tokens")
    sketches = nodes.select(F.col("node").alias("node_"), "sketch")
    schema = "path long, node binary"
    rows = nodes.select("node", "tokens").mapInArrow(_paths(1, rules.runs()), schema)
    ready: list[DataFrame] = []
    found: list[DataFrame] = []
    for level in range(1, rules.depth + 1):
        counts = rows.groupBy(F.col("path").alias("path_")).agg(F.count("*").alias("held")).where("held > 1")
        met = stage(rows.join(counts, F.col("path") == F.col("path_")).drop("path_"), "paths")
        large = met.where(F.col("held") > rules.bucket)
        # each member of a bucket meets all that the bucket holds
        compared = large.agg(F.sum("held")).first()[0] or 0
        if compared <= rules.few * rules.bucket**3:
            ready.append(met)
            break
        ready.append(met.where(F.col("held") <= rules.bucket))
        copies = stage(_copy_groups(large, sketches, rules.agree), "copies")
        of_group = F.col("path") == F.col("path_")
        members = large.join(copies, of_group).join(sketches, F.col("node") == F.col("node_"))
        if not copies.isEmpty():
            found.append(_group_edges(members.drop("path_", "node_"), rules))
        large = large.join(copies, of_group, "left_anti")
        if level == rules.depth:
            ready.append(large)
            break
        with_tokens = large.join(tokens, F.col("node") == F.col("node_"))
        rows = with_tokens.select("path", "node", "tokens").mapInArrow(_paths(level + 1, rules.runs()), schema)
    met = ready[0]
    for more in ready[1:]:
        met = met.unionByName(more)
    joined = met.join(sketches, F.col("node") == F.col("node_")).select("path", "node", "held", "sketch")
    blocks = _in_blocks(joined, "held", rules.block, ["path"])
    edges = blocks.mapInArrow(_bucket_edges(rules.agree), "u binary, v binary")
    for more in found:
        edges = edges.unionByName(more)
    return edges


def _linked_nodes(rows: DataFrame, nodes: DataFrame, rules: JoinRules) -> DataFrame:
    """(node, links, class) for nodes with a candidate partner, decided exactly."""
    edges = candidate_edges(nodes, rules)
    found = stage(components(edges, "candidates"), "candidates")
    held = found.groupBy(F.col("root").alias("root_")).agg(F.count("*").alias("held"))
    known = nodes.select(F.col("node").alias("node_"), "copies", F.col("tag").alias("tag_"))
    wanted = (
        found.join(held, F.col("root") == F.col("root_"))
        .join(known, F.col("node") == F.col("node_"))
        .select("node", "root", "held", "copies", "tag_")
    )
    # a repeated row has the same tag: one of them is enough
    texts = rows.join(wanted, F.col("tag") == F.col("tag_")).dropDuplicates(["tag"])
    blocks = _in_blocks(texts.select("node", "root", "held", "copies", "bytes"), "held", rules.block, ["root"])
    schema = "node binary, links long, near binary, blocks int"
    pairs = stage(blocks.mapInArrow(_exact(rules.shared, rules.of), schema), "links")
    classes = pairs.where("blocks = 1").select("node", F.col("near").alias("class"))
    split = pairs.where("blocks > 1")
    if not split.isEmpty():
        chains = components(split.select(F.col("node").alias("u"), F.col("near").alias("v")), "classes")
        classes = classes.unionByName(chains.withColumnRenamed("root", "class"))
    links = pairs.groupBy(F.col("node").alias("node_")).agg(F.sum("links").alias("links"))
    return classes.join(links, F.col("node") == F.col("node_")).select("node", "class", "links")


def _classes(rows: DataFrame, nodes: DataFrame, rules: JoinRules) -> DataFrame:
    """(node, links with copies, one of its class: no_id, doc_id, tag) for every node."""
    linked = _linked_nodes(rows, nodes, rules).withColumnRenamed("node", "node_")
    every = nodes.join(linked, F.col("node") == F.col("node_"), "left").select(
        "node",
        F.coalesce("class", "node").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.struct("no_id", "doc_id", "tag").alias("one"),
    )
    every = stage(every, "classes")
    named = every.groupBy(F.col("class").alias("class_")).agg(F.min("one").alias("first"))
    return every.join(named, F.col("class") == F.col("class_")).select("node", "n_links", "first")


def link(docs: DataFrame, rules: JoinRules = JoinRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id and n_links."""
    rows, members, nodes = _nodes(docs, doc_id, text)
    classes = _classes(rows, nodes, rules).select(F.col("node").alias("node_"), "n_links", "first")
    joined = members.join(classes, F.col("node") == F.col("node_"), "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, rules: JoinRules = JoinRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least doc_id, and all their columns.

    Texts without words are no one's copies: only fully repeated rows of them become one.
    """
    rows, members, nodes = _nodes(docs, doc_id, text)
    kept = _classes(rows, nodes, rules).select(F.col("first.tag").alias("kept_tag")).distinct()
    wordless = members.where("node is null").select(F.col("tag").alias("kept_tag")).distinct()
    tagged = docs.select(_tag(doc_id, text).alias("tag"), F.struct("*").alias("row"))
    chosen = tagged.join(kept.unionByName(wordless), F.col("tag") == F.col("kept_tag"), "left_semi")
    return chosen.dropDuplicates(["tag"]).select("row.*")
