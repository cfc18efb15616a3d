"""Ranked search, spelling variants and exact copies against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import catalog, exact, lexical, spelling

DATA = "/root/testdata/sf0.001"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "The quick brown fox jumps over the lazy dog near the river bank today. "
ODD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PROSE * 3),
    (4, PROSE * 3),
    (5, PROSE * 3 + "end."),
    (None, PROSE * 3),
    (None, PROSE * 3),
    (6, PROSE.replace(" ", "")),
    (7, PROSE),
    (8, "x" * 50_000 + " " + PROSE * 400 + "\n" + "é" * 3000 + " " + "z" * 300),
    (9, "z" * 300 + " ÀÉÎ Àéî àéî zzz " + "z" * 299),
    (10, "z" * 300 + "\x85\xa0" + "z" * 300 + " \U0001f600 \u0000 FOX-fox_fox"),
]
CLASHES = ["row", "key", "sha", "length", "h", "places", "at", "slice", "stretch", "n", "tf", "terms", "item", "score", "word", "raw"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def bag(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("name", ["op11_dual_tree", "op12_trie_pairs", "op13_bloom_exact"])
def test_sql_of_odd_rows(spark, odd, name, tmp_path):
    """The SQL agrees on null keys, empty and long texts, repeated rows and clashing names, not only on the given tables."""
    odd.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "fox " * 50), (5, "nowhere"), (None, "quick dog"), (6, "z" * 300)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = catalog.QUERIES[name](spark, str(tmp_path))
    cursor = db.execute(catalog.CHECKS[name])
    names = [d[0] for d in cursor.description]
    theirs = Counter(tuple(row[names.index(c)] for c in ours.columns) for row in cursor.fetchall())
    assert bag(ours, *ours.columns) == theirs and theirs


# ---------------------------------------------------------------- 11


def plain_scores(docs, items):
    """(item, doc_id, score) of every pair with a score above 0."""
    cut = lambda t: re.findall(lexical.TERM, (t or "").translate(LOWERED))
    own = [(k, cut(t)) for k, t in docs]
    own = [(k, len(t), Counter(t)) for k, t in own if t]
    total, df = sum(n for _, n, _ in own), Counter(t for _, _, c in own for t in c)
    w = {t: math.floor(1000 * math.log((2 * len(own) + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        for k, n, c in own:
            m = 25 + 75 * n * len(own) // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score:
                out.append((item, k, score))
    return out


def plain_search(docs, items, k):
    best = {}
    for item, doc, score in plain_scores(docs, sorted(set(items), key=repr)):
        best.setdefault(item, []).append((-score, doc is None, doc))
    return Counter((item, r + 1, d, -s) for item, found in best.items() for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))


def test_search(spark, docs, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for k, block in ((10, 1024), (3, 7)):
        got = lexical.search(docs, frame, k=k, block_items=block)
        assert bag(got, "item_id", "rank", "doc_id", "score") == plain_search(rows, items, k)


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    empty = docs.limit(0)
    for d, i in ((docs, none), (empty, some), (empty, none), (docs, spark.createDataFrame([(1, "  ..")], none.schema))):
        out = lexical.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_trees_prune_and_stay_exact():
    """Two trees over clustered vectors: the same results as all products, from far fewer of them."""
    rng = np.random.default_rng(5)
    size, docs, items, k = 400, 6000, 60, 5
    topic = np.sort(rng.integers(0, 8, docs))
    starts, at, x = [0], [], []
    for t in topic:
        own = np.unique(rng.integers(50 * t, 50 * t + 50, 20))
        at.append(own), x.append(rng.integers(1, 1000, len(own)))
        starts.append(starts[-1] + len(own))
    at, x, starts = np.concatenate(at), np.concatenate(x), np.array(starts)
    wanted = [Counter(rng.integers(50 * t, 50 * t + 50, 12).tolist()) for t in rng.integers(0, 8, items)]
    weights = rng.integers(0, 50, size)
    dense = np.zeros((docs, size), np.int64)
    dense[np.repeat(np.arange(docs), np.diff(starts)), at] = x
    asked = np.zeros((items, size), np.int64)
    for i, c in enumerate(wanted):
        asked[i, list(c)] = [n * weights[t] for t, n in c.items()]
    scores = asked @ dense.T
    places = rng.permutation(docs)
    for bars in (None, np.sort(scores, axis=1)[:, -k]):
        best = lexical.Best(items, k, bars)
        verified = lexical.dual_search(lexical.Items(wanted, weights), best, starts, at, x, places, size)
        for i in range(items):
            order = np.lexsort((places, -scores[i]))[:k]
            good = scores[i][order] > 0
            assert best.doc[i][: good.sum()].tolist() == places[order[good]].tolist()
            assert best.score[i][: good.sum()].tolist() == scores[i][order[good]].tolist()
        assert verified < items * docs / 3


def test_bounds_hold_for_every_pair_below():
    rng = np.random.default_rng(6)
    leaves = [(i, i + 1, (a := np.unique(rng.integers(0, 30, 6))), rng.integers(1, 99, len(a)).astype(float)) for i in range(40)]
    node = lexical._covered(leaves)
    dense = np.zeros(30)
    dense[node[2]] = node[3]
    assert node[:2] == (0, 40) and all((dense[at] >= v).all() for _, _, at, v in leaves)
    assert sorted(node[2].tolist()) == sorted({t for leaf in leaves for t in leaf[2].tolist()})


# ---------------------------------------------------------------- 12


def plain_words(rows):
    many = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWERED)
            h = zlib.crc32(f"{key}:{w}".encode()) if key is not None else 1
            many[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in many.items() if len(w) >= 5 and n >= 3}


def apart(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = Counter()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[(w, form[w], root, words[w], len(near[w]), words.get(form[w]))] += 1
    return out


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelled():
    hit = next(k for k in range(10_000) if zlib.crc32(f"{k}:straße".encode()) % 97 == 0)
    at = zlib.crc32(f"{hit}:straße".encode()) % 6
    assert spelling.spelled("STRAße Àb", hit) == Counter({"straße"[:at] + "straße"[at + 1 :]: 1, "Àb": 1})
    assert spelling.spelled("straße", None) == Counter(["straße"]) and not spelling.spelled(None, 1)


def test_letters_go_once():
    """`cdffbde` becomes `cdfbde`, which stands in the text too and whose own hash is divisible: each run loses one letter."""
    assert all(zlib.crc32(f"1:{w}".encode()) % 97 == 0 for w in ("cdffbde", "cdfbde"))
    for text in ("cdffbde cdfbde", "cdfbde cdffbde", "cdffbde cdfbde cdffbde cdfbde"):
        want = Counter()
        for w in text.split():
            h = zlib.crc32(f"1:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
        assert spelling.spelled(text, 1) == want


def test_vocabulary(docs, odd, rows):
    for frame, plain in ((docs, rows), (odd, ODD)):
        assert dict(bag(spelling.vocabulary(frame), "word", "n")) == dict.fromkeys(plain_words(plain).items(), 1)


def crowded():
    """Words of few letters, so that most have many neighbours, with runs of equal letters, shared starts and ends, and very long ones."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(5, 9))) for _ in range(900)}
    words |= {"a" * n for n in range(5, 12)} | {"start" + w for w in list(words)[:80]} | {w + "ending" for w in list(words)[:80]}
    words |= {"z" * 2000, "z" * 2001, "z" * 1000 + "y" + "z" * 1000}
    return {w: rng.choice([3, 4, 6, 8, 8, 16, 40, 100]) for w in sorted(words)}


def test_variants_of_crowded_words(spark):
    words = crowded()
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert bag(spelling.variants(frame), *VARIANT) == plain_variants(words)


def test_near_words(spark):
    words = list(crowded())[:500]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    want = Counter((a, b) for a, b in itertools.permutations(words, 2) if apart(a, b))
    assert bag(spelling.near_words(frame), "word", "other") == want


def test_variants_of_nothing(spark, docs):
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert bag(spelling.variants(one), *VARIANT) == Counter([("alone", None, "alone", 3, 0, None)])


def test_trie_numbers_do_not_depend_on_stretches():
    """Words cut into any stretches: two prefixes have one number exactly if they are equal."""
    words = sorted(set(crowded()) - {w for w in crowded() if len(w) > 100})
    rng = random.Random(3)
    for bounds in ([], sorted(rng.sample(words, 5)), sorted(rng.sample(words, 200)), ["aaaa", "aaab", "zzzzz"]):
        seen = {}
        for stretch in range(len(bounds) + 1):
            trie = spelling._Trie(bounds)
            for w in words:
                if spelling.bisect_right(bounds, w) == stretch:
                    for d, number in enumerate(trie.nodes(stretch, w)):
                        assert seen.setdefault(number, w[:d]) == w[:d]
        assert len(seen) == len({w[:d] for w in words for d in range(len(w) + 1)})


# ---------------------------------------------------------------- 13


def plain_groups(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    size, best = Counter(texts), {}
    for i, ((k, t), x) in enumerate(zip(rows, texts)):
        best[x] = min(best.get(x, (1, False, 0, 0)), (-len(t or ""), k is None, k or 0, i))
    out = Counter()
    for i, ((k, _), x) in enumerate(zip(rows, texts)):
        keep = rows[best[x][3]][0]
        out[(k, keep, size[x], i == best[x][3], hashlib.sha256(x.encode()).hexdigest())] += 1
    return out


GROUP = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_groups(docs, odd, rows):
    for frame, plain in ((docs, rows), (odd, ODD)):
        assert bag(exact.groups(frame), *GROUP) == plain_groups(plain)


def test_exact_groups_in_stretches(spark):
    """More rows than the broadcast bound takes at once, one text with a third of all rows."""
    rng = random.Random(1)
    plain = [(i, "hot  text" if i % 3 == 0 else f"text {rng.randrange(9000)}" + " " * (i % 4)) for i in range(12_000)]
    frame = spark.createDataFrame(plain, "doc_id long, text string").repartition(5)
    hashed = exact.prints(frame, "doc_id", "text", filter_bytes=exact.SLICE_BITS // 8)
    assert hashed.stretches == 3
    assert bag(exact.groups(frame, filter_bytes=exact.SLICE_BITS // 8), *GROUP) == plain_groups(plain)
    kept = {(k, s) for (k, _, _, kept, s) in plain_groups(plain) if kept}
    out = exact.deduplicate(frame, filter_bytes=exact.SLICE_BITS // 8)
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, _ in kept)


def test_only_possible_repeats_are_shuffled(spark):
    plain = [(i, f"text {i}") for i in range(20_000)] + [(i, "again") for i in range(50)]
    alone, maybe = exact._parted(exact.prints(spark.createDataFrame(plain, "doc_id long, text string"), "doc_id", "text"))
    assert alone.count() + maybe.count() == len(plain)
    assert maybe.filter("key < 50").count() >= 50 and maybe.count() < 50 + len(plain) / 100


def test_exact_rows_stay_whole(odd):
    out = exact.deduplicate(odd)
    assert out.columns == odd.columns
    kept = out.collect()
    assert all(r.row == "clash" and r.sha == "clash" for r in kept)
    assert Counter(r.doc_id for r in kept) == Counter(k for (k, _, _, stays, _), n in plain_groups(ODD).items() for _ in range(n) if stays)
    assert exact.groups(odd.limit(0)).count() == 0 and exact.deduplicate(odd.limit(0)).count() == 0
