"""Spelling variants: words one edit apart, found by joining pairs of trie nodes, and the usual form that each rare word belongs to."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import LOWER, UPPER, staged, table
from barlake.session import materialise

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, EVERY, TIMES = 5, 3, 97, 2
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 1 << 19
#: Words drawn for each stretch of a trie to find its bounds; they only balance the stretches.
DRAWN = 64
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RUN = re.compile(RUN.replace("A-Z", ""))


def spelled(text: str | None, key: int | str | None, every: int = EVERY) -> Counter:
    """Words of a text with their counts, letters A-Z lowered. Where `every` divides the CRC-32 h of `<key>:<word>` (never for a null key), the letter h % length is missing."""
    runs = Counter(_RUN.findall((text or "").encode().translate(_LOWERED).decode()))
    if key is None:
        return runs
    base = zlib.crc32(f"{key}:".encode())
    words: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), base)
        at = h % len(run)
        # of runs alone: a word that a run became is not looked at again
        words[run if h % every else run[:at] + run[at + 1 :]] += n
    return words


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """(word, n) of all words with at least `shortest` code points and `least` occurrences. Counts are added in each task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in spelled(t.as_py(), k, every).items():
                    if len(word) >= shortest:
                        found[word] += n
                if len(found) >= COUNTED_WORDS:
                    yield out()
                    found.clear()
        if found:
            yield out()

    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _bounds(words: DataFrame, column: str) -> list[str]:
    """Words that cut the order of `column` into stretches of like size: fewer than the shuffle's partitions, from a sample of DRAWN for each."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = words.count()
    share = min(1.0, 2 * DRAWN * parts / max(many, 1))
    drawn = sorted({r[0] for r in words.select(column).sample(share, 7).limit(4 * DRAWN * parts).collect()})
    step = max(1, len(drawn) // parts)
    return drawn[step::step][: parts - 1]


def _common(a: str, b: str) -> int:
    """Code points that two words have in common at their start."""
    return len(os.path.commonprefix((a, b)))


class _Trie:
    """Node numbers of words that come in order, stretch by stretch.

    All words with one prefix stand together, so a node is new unless the word before has its prefix too. A node that
    more stretches share is a prefix of a bound between them: it has the number of the first bound that starts so, which every
    stretch finds by itself.
    """

    def __init__(self, bounds: list[str]):
        self.bounds = bounds
        self.named: list[list[int]] = []
        for q, word in enumerate(bounds):
            same = _common(word, bounds[q - 1]) if q else -1
            self.named.append([self.named[q - 1][d] if d <= same else (q << 40) | (d << 1) | 1 for d in range(len(word) + 1)])
        self.stretch = -1

    def nodes(self, stretch: int, word: str) -> list[int]:
        """Numbers of the prefixes of 0 to len(word) code points."""
        if stretch != self.stretch:
            self.stretch, self.last, self.path, self.made, self.words = stretch, "", [], 0, -1
        self.words += 1
        same = _common(word, self.last) if self.path else -1
        path = self.path[: same + 1]
        # with the bound before and the bound after the stretch
        shared = [(q, _common(word, self.bounds[q])) for q in (stretch - 1, stretch) if 0 <= q < len(self.bounds)]
        for d in range(same + 1, len(word) + 1):
            number = next((self.named[q][d] for q, most in shared if d <= most), None)
            if number is None:
                self.made += 1
                number = (stretch << 40) | (self.made << 1)
            path.append(number)
        self.last, self.path = word, path
        return path


def _stretches(rows: DataFrame, column: str, bounds: list[str]) -> DataFrame:
    """Rows by stretch of `column`, each stretch in order in one task."""
    placed = rows.mapInArrow(_placing(rows.columns.index(column), bounds), rows.schema.simpleString()[7:-1] + ",stretch:int")
    return placed.repartitionById(len(bounds) + 1, F.col("stretch")).sortWithinPartitions("stretch", column)


def _placing(at: int, bounds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            where = pa.array([bisect_right(bounds, w) for w in batch.column(at).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, where], names=[*batch.schema.names, "stretch"])

    return run


def numbered(words: DataFrame) -> DataFrame:
    """(id, word, n, front): ids in code-point order, and the forward trie's node of every prefix, shortest first."""
    bounds = _bounds(words, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trie = _Trie(bounds)
        for batch in batches:
            ids, fronts = [], []
            for word, stretch in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                fronts.append(trie.nodes(stretch, word))
                ids.append((stretch << 40) | trie.words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0), batch.column(1), pa.array(fronts, pa.list_(pa.int64()))], names=["id", "word", "n", "front"])

    return _stretches(words.select("word", "n"), "word", bounds).mapInArrow(run, "id long, word string, n long, front array<long>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, skips, leads, id, n) of `numbered` words: pairs of a forward and a reversed trie node.

    Every word has the pairs around each of its letters (skips) and at each of its gaps. `leads` marks the first of equal
    letters in a row, so that the words that differ by one letter more are joined once.
    """
    turned = words.select("id", F.reverse("word").alias("turned"), "n", "front")
    bounds = _bounds(turned, "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trie = _Trie(bounds)
        for batch in batches:
            prefix, suffix, skips, leads, sizes = [], [], [], [], []
            fronts = batch.column(3)
            for row, (word, stretch) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                front, back = fronts[row].as_py(), trie.nodes(stretch, word)[::-1]
                long = len(word)
                letters = word[::-1]
                prefix += front[:long] + front
                suffix += back[1:] + back
                skips += [True] * long + [False] * (long + 1)
                leads += [i == 0 or letters[i] != letters[i - 1] for i in range(long)] + [False] * (long + 1)
                sizes.append(2 * long + 1)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            columns = [pa.array(prefix, pa.int64()), pa.array(suffix, pa.int64()), pa.array(skips, pa.bool_()), pa.array(leads, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(i).take(pa.array(of)) for i in (0, 2)], names=["prefix", "suffix", "skips", "leads", "id", "n"])

    return _stretches(turned, "turned", bounds).mapInArrow(run, "prefix long, suffix long, skips boolean, leads boolean, id long, n long")


def _met(prefix: np.ndarray, suffix: np.ndarray, skips: np.ndarray, leads: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Whole groups of equal node pairs, in a group the word at the gap first, then skipping words by falling n and rising id.

    Per word and group: how many other words it meets and the best of them. All skipping words of a group differ in one letter;
    the word at the gap is each of them without that letter.
    """
    start = np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])] if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    size = np.diff(np.r_[first, len(ids)])
    some = np.repeat(size > 1, size)
    if not some.any():
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["id", "near", "best_n", "best_id"])
    skips, leads, ids, n = skips[some], leads[some], ids[some], n[some]
    size = size[size > 1]
    first = np.r_[0, np.cumsum(size)[:-1]]
    rows, group = np.arange(len(ids)), np.repeat(np.arange(len(size)), size)
    gap = ~skips[first]  # at most one, for the word is the prefix and the suffix
    members = size - gap
    best = first + gap
    led = np.minimum.reduceat(np.where(leads, rows, len(ids)), first)
    leading = np.add.reduceat(leads.astype(np.int64), first)
    # a skipping word meets the best other one, and the word at the gap if it leads
    other = np.where(rows == best[group], best[group] + 1, best[group])
    has = members[group] > 1
    other = np.where(has, np.minimum(other, len(ids) - 1), -1)
    near = members[group] - 1
    center = leads & gap[group]
    near = near + center
    middle = first[group]
    better = center & (~has | (n[middle] > n[other]) | ((n[middle] == n[other]) & (ids[middle] < ids[other])))
    other = np.where(better, middle, other)
    # the word at the gap meets the leading ones
    near = np.where(skips, near, leading[group])
    other = np.where(skips, other, np.where(leading[group] > 0, np.minimum(led[group], len(ids) - 1), -1))
    good = near > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(near[good]), pa.array(n[other[good]]), pa.array(ids[other[good]])], names=["id", "near", "best_n", "best_id"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        change = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        # all but the last group, which may go on
        cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if cut:
            yield _met(*[r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None:
        yield _met(*held)


def nearest(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of the words that have a near one: one code point inserted, deleted or replaced.

    A group of equal node pairs is the word at the gap and the words with one letter there, so it is no larger than the alphabet
    and one; every near pair meets in exactly one group.
    """
    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", "skips", F.desc("n"), "id")
    found = met.mapInArrow(_meet, "id long, near long, best_n long, best_id long")
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("at"))).alias("best")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.at")).alias("best_id"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other) for all near pairs of a table of distinct words, both ways: skips join skips, and skips join gaps."""
    known = materialise(numbered(words.select("word", F.lit(1).cast("long").alias("n"))))
    pairs = materialise(node_pairs(known))
    skips = pairs.filter("skips").select("prefix", "suffix", "id", "leads")
    gaps = pairs.filter("NOT skips").select("prefix", "suffix", F.col("id").alias("other"))
    replaced = skips.join(skips.select("prefix", "suffix", F.col("id").alias("other")), ["prefix", "suffix"]).filter("id != other").select("id", "other")
    shorter = skips.filter("leads").join(gaps, ["prefix", "suffix"]).select("id", "other")
    links = replaced.unionByName(shorter).unionByName(shorter.select(F.col("other").alias("id"), F.col("id").alias("other")))
    name = lambda id_, word: known.select(F.col("id").alias(id_), F.col("word").alias(word))
    return links.join(name("id", "word"), "id").join(name("other", "other_word"), "other").select("word", F.col("other_word").alias("other"))


def roots(links: DataFrame) -> DataFrame:
    """(id, form, root) from links (id, form), which never lead back: every pass doubles the way that a link spans."""
    now = materialise(links.select("id", "form", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        now = materialise(now.join(ahead, "root", "left"))
        moved = now.filter("ahead IS NOT NULL").limit(1).count()
        now = now.select("id", "form", F.coalesce("ahead", "root").alias("root"))
        if not moved:
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    A word's form is its near word with the largest n (ties: first in code-point order) if that n is at least `times` its own;
    the root is where following forms ends. n grows along forms, so they end. An empty table gives an empty table.
    """
    known = staged(numbered(words), "spelling-words")
    near = materialise(nearest(node_pairs(known)))
    table_ = known.select("id", "word", "n").join(near, "id", "left")
    told = materialise(table_.withColumn("formed", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))))
    ends = roots(told.filter("formed").select("id", F.col("best_id").alias("form")))
    name = lambda id_, word: known.select(F.col("id").alias(id_), F.col("word").alias(word))
    named = ends.join(name("form", "form_word"), "form").join(name("root", "root_word"), "root").select("id", "form_word", "root_word")
    rows = told.join(named, "id", "left")
    return rows.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("formed"), F.col("best_n")).alias("form_n"),
    )


def op12_trie_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all whole texts (null: none; a null doc_id spells its words in full; repeated rows count again)."""
    return variants(materialise(vocabulary(table(spark, folder, "documents"))))


def check_op12() -> str:
    """The same in SQL: CRC-32 by its table of 256 values, near words by their texts with a letter missing or masked."""
    return f"""
WITH RECURSIVE crc_steps AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
seen AS (SELECT doc_id, w, count(*) AS many FROM runs WHERE length(w) >= {SHORTEST} GROUP BY ALL),
bytes AS (SELECT doc_id, w, many, hex(encode(doc_id || ':' || w)) AS x FROM seen),
hashed AS (SELECT doc_id, w, many, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
  lambda c, b: xor(c // 256, crc.t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT many, CASE WHEN doc_id IS NOT NULL AND h % {EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, CAST(sum(many) AS BIGINT) AS n FROM spelt WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(many) >= {LEAST}),
cut AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
links AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word FROM cut x JOIN words y ON x.a || x.b = y.word),
ranked AS (SELECT l.word, l.other, o.n AS other_n, count(*) OVER (PARTITION BY l.word) AS n_near, row_number() OVER (PARTITION BY l.word ORDER BY o.n DESC, encode(l.other)) AS place
  FROM links l JOIN words o ON o.word = l.other),
told AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= {TIMES} * w.n THEN r.other END AS form, CASE WHEN r.other_n >= {TIMES} * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
way AS (SELECT word, word AS at, form AS up FROM told UNION ALL SELECT way.word, told.word, told.form FROM way JOIN told ON told.word = way.up)
SELECT told.word, told.form, way.at AS root, told.n, told.n_near, told.form_n FROM told JOIN way ON way.word = told.word AND way.up IS NULL
"""
