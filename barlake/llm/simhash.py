"""Near duplicates by SimHash: binary tries of fingerprints joined with themselves, node pair by node pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import LOWER, UPPER, documents_with, staged, table, with_row
from barlake.session import materialise

BITS, SHINGLE, SEED, MAX_BITS = 64, 3, 42, 2
#: Fingerprints of one group that a task takes as one trie; larger groups are dealt out by further bits.
NODE_ROWS = 1 << 18
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 20
#: Links that one task contracts.
TASK_LINKS = 1 << 17
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if it is set in more than half of the XXH64 hashes of the shingles. No word: zero."""
    words = (text or "").encode().translate(_LOWERED).split()
    if not words:
        return 0
    counts, hashed = np.zeros(BITS, np.int64), max(len(words) - SHINGLE + 1, 1)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = starts[min(SHINGLE, len(words)) :] - 1
    for lo in range(0, hashed, 1 << 16):
        pairs = zip(starts[lo : min(lo + (1 << 16), hashed)].tolist(), ends[lo : lo + (1 << 16)].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > hashed).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint as a signed long; equal hashes for equal words, null and empty texts give zero."""
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items and links a-b, the smallest item of each one's class."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b contracted: one for every node that is not the smallest of its class, to that one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = _smallest(len(nodes), at[: len(a)], at[len(a) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def trie_links(values: np.ndarray, groups: np.ndarray, max_bits: int = MAX_BITS, shared: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of items of one group that differ in at most `max_bits` bits.

    `values` (uint64) are sorted within each group, groups stand together, and the items of a group share their first `shared` bits. A node of a binary trie is a range of items that
    share their first bits. Node pairs start as every group with itself; both sides go down together, a pair splits into the
    pairs of their children, and a pair whose bits differ more often than allowed goes, with all below it. The frontier is cut in pieces, deepest
    first, so that memory stays bounded.
    """
    n = len(values)
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    root = np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)])
    stack, before = [(shared, root)], {}
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [(depth, part) for part in np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1)]
            continue
        if depth == BITS:
            i, j = pairs[0], pairs[2]
            yield i[i < j], j[i < j]
            continue
        if (ones := before.get(depth)) is None:
            ones = before[depth] = np.r_[0, np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int32)]
        a0, a1, b0, b1, errors = pairs
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones of a node begin
        same = a0 == b0  # a node with itself: its two children meet once
        children = [
            np.stack([a0, am, b0, bm, errors]),
            np.stack([am, a1, bm, b1, errors]),
            np.stack([a0, am, bm, b1, errors + 1]),
            np.stack([am, a1, b0, bm, errors + 1])[:, ~same],
        ]
        below = np.concatenate(children, axis=1)
        alive = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= max_bits)
        alive &= (below[0] != below[2]) | (below[1] - below[0] > 1)  # one item with itself links nothing
        below = below[:, alive]
        if below.shape[1]:
            stack.append((depth + 1, below))


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _dealt(distinct: DataFrame, max_bits: int, node_rows: int) -> DataFrame:
    """(turn, top, part, value): every fingerprint once per turn, two that may link together in a group at least once.

    Of `max_bits` + 1 stretches of bits one is free of errors, so each turn rotates another stretch to the front and deals the
    tries out by it: groups are nodes that share it, and no pair above them needs a visit. A group over `node_rows` is
    dealt on by its next bits, with all nodes within the allowed errors of its own, until groups are small on average.
    """
    width = BITS // (max_bits + 1)
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), _rotated(F.col("fp"), i * width).alias("value")) for i in range(max_bits + 1)])
    rows = distinct.select(F.explode(turns).alias("x")).select("x.turn", F.shiftrightunsigned("x.value", BITS - width).alias("top"), "x.value")
    large = rows.groupBy("turn", "top").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > node_rows)
    large = staged(large.select("turn", "top", F.least(F.ceil(F.log2(F.col("rows") / node_rows)), F.lit(BITS - width)).cast("int").alias("more")), "simhash-large")
    marked = rows.join(large, ["turn", "top"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    node = F.expr(f"shiftrightunsigned(shiftleft(value, {width}), {BITS} - greatest(more, 1))")
    bits = F.sequence(F.lit(0), F.col("more") - 1)
    flips = [F.array(F.lit(0).cast("long"))]
    for _ in range(max_bits):
        flips.append(F.array_distinct(F.flatten(F.transform(flips[-1], lambda m: F.transform(bits, lambda b: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))))))
    near = F.array_distinct(F.concat(*flips))
    part = F.transform(near, lambda m: F.struct(F.least(node, node.bitwiseXOR(m)).alias("a"), F.greatest(node, node.bitwiseXOR(m)).alias("b")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return marked.select("turn", "top", F.explode(F.when(F.col("more") > 0, part).otherwise(alone)).alias("part"), "value")


def _local_classes(dealt: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b), one per fingerprint that has a partner in its group: to the smallest of its class there."""
    width = BITS // (max_bits + 1)
    rows = dealt.select("turn", "top", F.col("part.a").alias("a"), F.col("part.b").alias("b"), "value")
    # values in unsigned order: flip the sign bit for the sort
    unsigned = F.col("value").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    spread = rows.repartition("turn", "top", "a", "b").sortWithinPartitions("turn", "top", "a", "b", unsigned)

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        turn, top, a, b, value = columns
        bits = value.view(np.uint64)
        fresh = np.r_[True, (turn[1:] != turn[:-1]) | (top[1:] != top[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(fresh)
        i, j = [], []
        root = np.arange(len(bits))
        for x, y in trie_links(bits, group, max_bits, width):
            i.append(x), j.append(y)
            if sum(map(len, i)) > 4 * FRONTIER:
                root = _smallest(len(bits), np.concatenate([*i, np.arange(len(root))]), np.concatenate([*j, root]))
                i, j = [], []
        root = _smallest(len(bits), np.concatenate([*i, np.arange(len(root))]), np.concatenate([*j, root]))
        moved = np.flatnonzero(root != np.arange(len(bits)))
        back = (turn * width).astype(np.uint64)
        plain = np.where(back > 0, (bits >> back) | (bits << ((np.uint64(BITS) - back) % np.uint64(BITS))), bits).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(plain[moved]), pa.array(plain[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= NODE_ROWS:
                rows_ = [np.concatenate(x) for x in zip(*held)]
                # all but the last group, which may go on
                key = np.stack(rows_[:4])
                cut = int(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[-1]) + 1 if (key[:, 1:] != key[:, :-1]).any() else 0
                if cut:
                    yield links([r[:cut] for r in rows_])
                held = [[r[cut:] for r in rows_]]
        if held:
            yield links([np.concatenate(x) for x in zip(*held)])

    return spread.mapInArrow(run, "a long, b long")


def _contracted(edges: DataFrame, task_links: int) -> DataFrame:
    """The forests of every task's links, up to `task_links` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= task_links:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], names=["a", "b"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root): classes of the graph of links (a, b), each named by its smallest node; nodes without a link are left out.

    Stars: in turn every node hands its larger, then its smaller neighbours to the smallest it knows, until nothing changes; after
    each round tasks contract the links they hold, about `task_links` each. Links that fit in one task are contracted without a round.
    The smallest neighbour comes from partial sums and a join, so a class of any size is no group of one task. Each round is checkpointed to the
    shared folder.
    """
    edges = materialise(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, tasks = now, -(-now[0] // task_links)
        if tasks == 1:
            edges = materialise(_contracted(edges.coalesce(1), task_links))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.filter("a != b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialise(_contracted(small.filter("a != b").distinct().coalesce(tasks), task_links))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _roots(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(node, root) for the distinct fingerprints (fp) that have a partner."""
    return components(_local_classes(_dealt(distinct, max_bits, node_rows), max_bits))


def _classes(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(fp, first_key): for every fingerprint the smallest key in its class, from (key, fp)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("first_key")))
    roots = _roots(distinct.select("fp"), max_bits, node_rows)
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    first = linked.groupBy("root").agg(F.min("first_key").alias("least"))
    told = linked.join(first, "root").select("fp", F.col("least").alias("first_key"))
    return distinct.join(told.withColumnRenamed("first_key", "least"), "fp", "left").select("fp", F.coalesce("least", "first_key").alias("first_key"))


def first_of_classes(rows: DataFrame, roots: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Of rows (row, fp) and classes (node, root) of fingerprints, the row of each class with the smallest key."""
    prints = rows.select(F.col("row").getField(key).alias("key"), "fp")
    counted = materialise(prints.groupBy("fp", "key").agg(F.count(F.lit(1)).alias("copies")))
    named = counted.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("root", "fp"))
    best = named.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp", "copies")).alias("best"))
    winners = staged(best.select("best.key", "best.fp", "best.copies"), "simhash-winners")
    kept = rows.select("row", "fp").withColumn("key", F.col("row").getField(key)).join(winners.withColumnRenamed("fp", "best_fp").withColumnRenamed("key", "best_key"), F.col("fp").eqNullSafe(F.col("best_fp")) & F.col("key").eqNullSafe(F.col("best_key")))
    content = F.md5(F.to_json(F.col("row")).cast("binary"))
    again = kept.filter("copies > 1").groupBy("fp", "key").agg(F.min_by("row", content).alias("row")).select("row")
    return documents_with(kept.filter("copies = 1").select("row").unionByName(again), columns)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every class of near duplicates, columns unchanged: the one with the smallest key (a null key comes last).

    Rows are written once with their fingerprints; classes and winners are found on keys and fingerprints alone. If rows
    of a class share the winning key and fingerprint, the one whose content has the smallest MD5 stays, chosen with
    partial sums: a class of any size is never gathered.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            found = np.array([fingerprint(t.as_py()) for t in row.field(place)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.int64())], names=["row", "fp"])

    packed = with_row(docs)
    rows = staged(packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, fp long"), "simhash-rows")
    return first_of_classes(rows, _roots(rows.select("fp").distinct(), max_bits), docs.columns, key)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fingerprint, component_id): 16 hexadecimal digits, and the smallest key that can be reached over links.

    Fingerprints of three-word shingles link if they differ in at most `max_bits` bits. Texts without words (null, empty,
    white space) have fingerprint zero and link like any other. A class without any key has component_id null; repeated
    rows are in one class; other columns are not looked at; an empty table gives an empty table.
    """
    prints = materialise(fingerprints(docs, key, text))
    classes = _classes(prints, max_bits)
    rows = prints.join(classes, "fp")
    return rows.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_key").alias("component_id"))


def op7_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
