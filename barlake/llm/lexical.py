"""Ranked lexical search by two trees: items and documents in hierarchies of coordinate maxima, searched node pair by node pair."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import LOWER, UPPER, staged, table
from barlake.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Items that one pass asks, and bytes of their texts; more items are asked in further passes.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 1 << 23
#: Documents of a leaf, children of a node, coordinates that a task holds as one tree.
LEAF, FAN, TREE_COORDINATES = 256, 8, 1 << 22
#: One document in so many gives the bars that the search starts with.
FIRST_SHARE = 32
#: Up to here products and sums are exact in doubles.
EXACT = 2.0**53
#: Bytes of no term become blanks, A-Z become a-z, bytes of other scripts stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """Terms of a text in order, A-Z lowered."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, terms, tf): the number of all terms of every document, and those of the vocabulary with their counts."""
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].cast("binary").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block: BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            many, found, counts = [], [], []
            for raw in batch.column(1):
                own = terms(raw.as_py())
                seen = Counter(map(place, own))
                seen.pop(None, None)
                many.append(len(own)), found.append(list(seen)), counts.append(list(seen.values()))
            columns = [batch.column(0), pa.array(many, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "terms", "tf"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, terms array<int>, tf array<long>")


class Items:
    """Items of a block as sparse rows (starts, terms, values) in the order of their tree: leaves are items, nodes cover FAN children."""

    def __init__(self, wanted: list[Counter], weights: np.ndarray):
        own = []
        for number, count in enumerate(wanted):
            at = np.array(sorted(count), np.int64)
            value = np.array([count[t] for t in at.tolist()], np.int64) * weights[at]
            own.append((number, at[value > 0], value[value > 0]))
        # items whose commonest terms agree stand together
        rank = lambda x: tuple(x[1][np.argsort(weights[x[1]], kind="stable")][:4].tolist())
        own.sort(key=rank)
        self.number = np.array([x[0] for x in own], np.int64)
        self.rows = [(at, value) for _, at, value in own]
        self.levels = [[(i, i + 1, at, value.astype(float)) for i, (at, value) in enumerate(self.rows)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([_covered(below[i : i + FAN]) for i in range(0, len(below), FAN)])


def _covered(nodes: list[tuple]) -> tuple:
    """A node over others: the range of what it holds and its coordinate maxima."""
    at, value = np.concatenate([n[2] for n in nodes]), np.concatenate([n[3] for n in nodes])
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return nodes[0][0], nodes[-1][1], at[first], np.maximum.reduceat(value, first) if len(at) else value


class Best:
    """The k best documents of every item of a block, and the score that a further one has to reach."""

    def __init__(self, items: int, k: int, bars: np.ndarray | None = None):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), -1, np.int64)
        # a score above 0, and not below the k-th best that is known already
        self.bar = np.ones(items, np.int64) if bars is None else np.maximum(bars, 1)

    def take(self, rows: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """`docs` are places of documents in rising key order, so of equal scores the smallest place is better."""
        for i, row in enumerate(rows):
            good = np.flatnonzero(scores[i] >= self.bar[row])
            if not len(good):
                continue
            score, doc = np.r_[self.score[row], scores[i][good]], np.r_[self.doc[row], docs[good]]
            score, doc = score[score > 0], doc[score > 0]
            order = np.lexsort((doc, -score))[: self.k]
            self.score[row, : len(order)], self.doc[row, : len(order)] = score[order], doc[order]
            if len(order) == self.k:
                self.bar[row] = max(self.bar[row], score[order[-1]])


def _document_levels(starts: np.ndarray, at: np.ndarray, x: np.ndarray) -> list[list[tuple]]:
    """Levels of a tree over documents in order: leaves of LEAF documents, nodes of FAN children, each with its coordinate maxima."""
    docs = len(starts) - 1
    leaves = []
    for lo in range(0, docs, LEAF):
        hi = min(lo + LEAF, docs)
        part = slice(starts[lo], starts[hi])
        leaves.append(_covered([(lo, hi, at[part], x[part].astype(float))]))
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_covered(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def dual_search(items: Items, best: Best, starts: np.ndarray, at: np.ndarray, x: np.ndarray, places: np.ndarray, size: int) -> int:
    """Search one tree of documents (sparse rows of coordinates) for all items; the number of verified products.

    A node pair's bound is the product of its coordinate maxima, which no pair below exceeds. Where it is under the weakest
    k-th score of the node's items, the pair goes with all below it. Else both sides go down, pairs of high bounds first,
    so that scores rise early. At an item and a leaf the products are taken in whole numbers.
    """
    if len(starts) < 2 or not len(items.rows):
        return 0
    levels = _document_levels(starts, at, x)
    dense = np.zeros(size)
    verified = 0
    weakest = lambda node: best.bar[items.number[node[0] : node[1]]].min()

    def bounds(nodes: list[tuple], doc: tuple) -> list[float]:
        dense[doc[2]] = doc[3]
        found = [float(node[3] @ dense[node[2]]) * (1 + 1e-9) for node in nodes]
        dense[doc[2]] = 0
        return found

    def verify(leaf: tuple, rows: list[int]) -> int:
        lo, hi = leaf[:2]
        needed = np.unique(np.concatenate([items.rows[i][0] for i in rows]))
        part = slice(starts[lo], starts[hi])
        column = np.searchsorted(needed, at[part])
        column[column == len(needed)] = 0
        has = needed[column] == at[part] if len(needed) else np.zeros(0, bool)
        of = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        exact = max(float(items.rows[i][1].sum()) for i in rows) * 1e6 < EXACT
        kind = np.float64 if exact else np.int64
        matrix = np.zeros((hi - lo, len(needed)), kind)
        matrix[of[has], column[has]] = x[part][has]
        asked = np.zeros((len(rows), len(needed)), kind)
        for r, i in enumerate(rows):
            asked[r, np.searchsorted(needed, items.rows[i][0])] = items.rows[i][1]
        best.take(items.number[rows], places[lo:hi], (asked @ matrix.T).astype(np.int64))
        return len(rows) * (hi - lo)

    # (bound, level of items, nodes there, level of documents, node there); the nodes of one entry share a document node
    top = len(items.levels) - 1
    root = levels[-1][0]
    stack = [(len(levels) - 1, 0, top, [0], bounds([items.levels[top][0]], root))]
    while stack:
        high, place, wide, nodes, bound = stack.pop()
        alive = [n for n, b in zip(nodes, bound) if b >= weakest(items.levels[wide][n])]
        if not alive:
            continue
        doc = levels[high][place]
        if wide:  # items go down first: one product a node
            below = [c for n in alive for c in range(n * FAN, min(n * FAN + FAN, len(items.levels[wide - 1])))]
            wide -= 1
            bound = bounds([items.levels[wide][n] for n in below], doc)
            alive = [n for n, b in zip(below, bound) if b >= weakest(items.levels[wide][n])]
            if not alive:
                continue
        if high:
            children = range(place * FAN, min(place * FAN + FAN, len(levels[high - 1])))
            found = [(high - 1, c, wide, alive, bounds([items.levels[wide][n] for n in alive], levels[high - 1][c])) for c in children]
            stack += sorted(found, key=lambda entry: max(entry[4]))
        elif wide:
            stack.append((high, place, wide, alive, bounds([items.levels[wide][n] for n in alive], doc)))
        else:
            verified += verify(doc, alive)
    return verified


def _coordinates(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) for each coordinate; m is 25 + (75 n N) div L."""
    m = np.array([25 + 75 * int(v) * documents // total for v in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))


def _searched(asked: DataFrame, items: list[Counter], weights: np.ndarray, documents: int, total: int, k: int, bars: np.ndarray | None) -> DataFrame:
    """(item, key, score): the k best of every task, for scores that reach the bars."""
    told = asked.sparkSession.sparkContext.broadcast((items, weights, bars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        wanted, weights, bars = told.value
        tree = Items(wanted, weights)
        bar = bars

        def search(held: list[tuple]) -> pa.RecordBatch:
            nonlocal bar
            keys = pa.chunked_array([h[0] for h in held]).combine_chunks()
            n, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            at, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            x = _coordinates(n, sizes, tf, documents, total)
            # places in key order, null keys last, so that ties go to the smaller key
            place = np.empty(len(keys), np.int64)
            by_key = pc.array_sort_indices(keys, null_placement="at_end").to_numpy()
            place[by_key] = np.arange(len(keys))
            # documents whose weightiest term agrees stand together, short ones first
            starts = np.r_[0, np.cumsum(sizes)]
            strong = weights[at] * tf
            of = np.repeat(np.arange(len(n)), sizes)
            most = np.lexsort((at, -strong, of))
            lead = np.full(len(n), -1, np.int64)
            lead[sizes > 0] = at[most][starts[:-1][sizes > 0]]
            order = np.lexsort((n, lead))
            moved = np.repeat(starts[order] - np.r_[0, np.cumsum(sizes[order])[:-1]], sizes[order]) + np.arange(len(at))
            best = Best(len(wanted), k, bar)
            dual_search(tree, best, np.r_[0, np.cumsum(sizes[order])], at[moved], x[moved], place[order], len(weights))
            bar = best.bar
            row, column = np.nonzero(best.doc >= 0)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), keys.take(pa.array(by_key[best.doc[row, column]])), pa.array(best.score[row, column])], names=["item", "key", "score"])

        held: list[tuple] = []
        for batch in batches:
            found = batch.column(2)
            sizes = np.diff(found.offsets.to_numpy()).astype(np.int64)
            held.append((batch.column(0), batch.column(1).to_numpy(), sizes, found.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= TREE_COORDINATES:
                yield search(held)
                held = []
        if held:
            yield search(held)

    return asked.select("key", "n", "terms", "tf").mapInArrow(run, f"item int, key {asked.schema['key'].dataType.simpleString()}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: Spark drops rows beyond the k-th in every task before it shuffles them."""
    return found.selectExpr("*", "row_number() OVER (PARTITION BY item ORDER BY score DESC, key IS NULL, key) AS rank").filter(F.col("rank") <= k)


def _block(docs: DataFrame, asked: list, key: str, text: str, k: int) -> DataFrame | None:
    """(item, key, score, rank) for the items of one block; `item` is the place in `asked`."""
    own = [Counter(terms(raw)) for _, raw in asked]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    wanted = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in own]
    held = staged(vectors(docs, vocabulary, key, text).withColumn("at", F.monotonically_increasing_id()), "lexical-vectors")
    documents, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not vocabulary or not total:
        return None
    weights = np.full(len(vocabulary), weight(documents, 0), np.int64)
    for term, many in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        weights[term] = weight(documents, many)
    search = lambda rows, bars: _ranked(_searched(rows, wanted, weights, documents, total, k, bars), k)
    # the k-th best score among some documents is one that the k-th best of all reaches
    some = search(held.filter(F.pmod(F.xxhash64("at"), F.lit(FIRST_SHARE)) == 0), None)
    bars = np.ones(len(wanted), np.int64)
    for item, score in some.filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
        bars[item] = score
    return search(held, bars)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_key, rank, key, score): the k documents with the highest score above 0 of every item, exactly.

    Ties go to the smaller key, a null key comes last; repeated rows of documents are documents of their own, equal rows of
    items are asked once, and an item without terms (null, empty) or without a scoring document has no rows. Items are asked in
    blocks of bounded size, each with one pass over the texts and one over its sparse vectors; vectors stay where they were written, trees are built in
    each task, and k rows an item and task meet at the end. An empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    distinct = items.select(items[f"`{item_key}`"].alias("id"), items[f"`{item_text}`"].cast("binary").alias("raw")).filter("raw IS NOT NULL").distinct()
    asked = materialise(distinct)
    many, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    blocks = max(1, math.ceil(many / block_items), math.ceil(size / BLOCK_BYTES))
    kinds = f"`{item_key}` {asked.schema['id'].dataType.simpleString()}, rank int, `{key}` {docs.schema[key].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], kinds)
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)) == i)
        rows = [(r.id, bytes(r.raw)) for r in block.collect()]  # BLOCK_BYTES of texts on average
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        found = _block(docs, rows, key, text, k) if rows else None
        if found is not None:
            names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], f"item int, id {asked.schema['id'].dataType.simpleString()}")
            found = found.join(names, "item").select(F.col("id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
            out = found if blocks == 1 else out.unionByName(found)
    return out


def op11_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def check_op11() -> str:
    found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT item, item_id, term, count(*) AS many FROM (SELECT item, item_id, unnest({found}) AS term FROM items) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS nr, doc_id, {found} AS own FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(own)) AS BIGINT) AS terms FROM docs WHERE len(own) > 0),
counts AS (SELECT nr, doc_id, n, term, count(*) AS tf FROM (SELECT nr, doc_id, len(own) AS n, unnest(own) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (SELECT item, item_id, nr, doc_id, CAST(sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
