"""Language-model scores by context-tree weighting over bytes, beside a unigram baseline over words."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import LOWER, UPPER, staged, table

#: Bytes of the longest context; at most 5, so that a context, its next byte and the number of a text fit 64 bits.
DEPTH = 5
#: Bytes and texts whose grams are sorted at once.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 21, 1 << 16
#: Parts of the model, by the two bytes before; the memory of a task is that of one part.
SLICES = 256
#: Bytes of text that a block gathers (a longer document is a block of its own).
BLOCK_BYTES = 1 << 23
END = 10  # a line feed: no word holds one
MODULUS, HELD = 7, 2
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
LN2, LN10 = math.log(2), math.log(10)


# ---------------------------------------------------------------- the tree


def grams(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Context and next byte of every byte of texts that begin at `starts`, as one number: the byte before first, the next byte last. Before a text stand END bytes."""
    n = len(data)
    padded = np.concatenate([np.full(7, END, np.uint8), data])
    eight = np.ndarray((n,), "<u8", padded, 0, (1,))  # a byte and the seven before it, the byte itself on top
    out = eight << np.uint64(8)
    out >>= np.uint64(64 - 8 * depth)
    out <<= np.uint64(8)
    out |= eight >> np.uint64(56)
    sizes = np.diff(np.r_[starts, n])
    for k in range(depth):  # the first bytes of a text see no other text
        kept = 255 | sum(255 << 8 * (depth + 1 - i) for i in range(1, k + 1))
        ends = sum(END << 8 * (depth + 1 - i) for i in range(k + 1, depth + 1))
        at = starts[sizes > k] + k
        out[at] = (out[at] & np.uint64(kept)) | np.uint64(ends)
    return out


def _chunks(sizes: list[int] | np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end, first byte, end) of stretches of whole texts, each of bounded size (or one text)."""
    lo = at = size = 0
    for i, n in enumerate(sizes):
        if i > lo and (size + n > CHUNK_BYTES or i - lo == CHUNK_TEXTS):
            yield lo, i, at, at + size
            lo, at, size = i, at + size, 0
        size += int(n)
    if lo < len(sizes):
        yield lo, len(sizes), at, at + size


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _counted(data: np.ndarray, sizes: list[int], held: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts in order, with their numbers in training texts."""
    parts = []
    for lo, hi, a, b in _chunks(sizes):
        own = np.array(sizes[lo:hi])
        tagged = (grams(data[a:b], np.r_[0, np.cumsum(own)[:-1]], depth) << np.uint64(1)) | np.repeat(np.array(held[lo:hi], np.uint64), own)
        tagged.sort()  # one fast sort of plain numbers; the tag goes with each
        keys = tagged >> np.uint64(1)
        first = _runs(keys)
        parts.append((keys[first], np.add.reduceat(1 - (tagged & np.uint64(1)).astype(np.int64), first)))
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


class _Scorer:
    """Sums over texts of a value per gram: each stretch of texts is sorted once, its grams tagged with the number of their text."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int):
        self.parts, self.texts = [], len(sizes)
        for lo, hi, a, b in _chunks(sizes):
            own = sizes[lo:hi]
            tagged = (grams(data[a:b], np.r_[0, np.cumsum(own)[:-1]], depth) << np.uint64(16)) | np.repeat(np.arange(hi - lo, dtype=np.uint64), own)
            tagged.sort()
            text, keys = (tagged & np.uint64(0xFFFF)).astype(np.uint16), tagged >> np.uint64(16)
            first = _runs(keys)
            self.parts.append((lo, hi, keys[first], np.diff(np.r_[first, len(keys)]).astype(np.int32), text))
        self.every = np.unique(np.concatenate([p[2] for p in self.parts]))

    def sums(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(self.texts)
        for lo, hi, keys, many, text in self.parts:
            out[lo:hi] = np.bincount(text, weights=np.repeat(value[np.searchsorted(self.every, keys)], many), minlength=hi - lo)
        return out


_SMALL = 4096
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_ONE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(counts: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    """Logarithm of gamma(counts + shift): from a table, beyond it by Stirling's series (error under 1e-15 there)."""
    out = small[np.minimum(counts, _SMALL - 1)]
    large = counts >= _SMALL
    if large.any():
        x = counts[large] + shift
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - _log_gamma(zeros + ones, _ONE, 1.0) - math.log(math.pi)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class _Depth:
    """Nodes of one depth: for each of the eight binary decisions the groups of equal context and equal bits so far."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys  # context and next byte, in order
        self.group, self.at, self.zeros, self.ones, self.bit = [], [], [], [], []
        for i in range(8):
            group = keys >> np.uint64(8 - i)
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            bit = ((keys >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64)
            both, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * bit, first)
            fresh = np.zeros(len(keys), np.int64)
            fresh[first] = 1
            self.group.append(group[first])
            self.at.append(np.cumsum(fresh) - 1)
            self.zeros.append(both - ones)
            self.ones.append(ones)
            self.bit.append(bit)
        self.log_e = [log_kt(z, o) for z, o in zip(self.zeros, self.ones)]
        self.log_w = self.log_e
        self.stop = None

    def weigh(self, below: _Depth) -> None:
        """Weighted probabilities from those of the contexts one byte longer, and the weight of stopping here."""
        self.log_w, self.stop = [], []
        for i in range(8):
            child = below.group[i]
            low = np.uint64((1 << i) - 1)
            parent = ((child >> np.uint64(i + 8)) << np.uint64(i)) | (child & low)
            under = np.bincount(np.searchsorted(self.group[i], parent), weights=below.log_w[i], minlength=len(self.group[i]))
            log_w = np.logaddexp(self.log_e[i], under) - LN2
            self.log_w.append(log_w)
            self.stop.append(np.exp(self.log_e[i] - LN2 - log_w))

    def kt(self, i: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Probability of `bit` in groups `at` of decision i."""
        zeros, ones = self.zeros[i][at], self.ones[i][at]
        return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict[int, _Depth]:
    """The nodes of depth 2 and more over distinct, sorted grams with their training counts (zero where training has none)."""
    levels = {}
    for d in range(depth, 1, -1):
        short = ((keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | (keys & np.uint64(255))
        levels[d] = _Depth(*(_summed(short, counts) if d < depth else (keys, counts)))
        if d < depth:
            levels[d].weigh(levels[d + 1])
    return levels


def top_parts(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[tuple[int, int, float, int, int]]:
    """What the two top depths need of a part of the model: (byte before, node, log weight below, zeros, ones)."""
    level = subtree(keys, counts, depth)[2]
    sums: dict[tuple[int, int], list] = {}
    for i in range(8):
        context = (level.group[i] >> np.uint64(i + 8)).astype(np.int64)  # the byte before
        node = (1 << i) + (level.group[i] & np.uint64((1 << i) - 1)).astype(np.int64)
        for c, n, w, z, o in zip(context.tolist(), node.tolist(), level.log_w[i].tolist(), level.zeros[i].tolist(), level.ones[i].tolist()):
            s = sums.setdefault((c, n), [0.0, 0, 0])
            s[0] += w
            s[1] += z
            s[2] += o
    return [(c, n, *s) for (c, n), s in sums.items()]


class Top:
    """Depths 0 and 1: for every node the weight of stopping and the counts. 256 contexts of 256 nodes, whatever the corpus."""

    def __init__(self, rows: list[tuple[int, int, float, int, int]]):
        shape = (256, 256)
        under, zeros, ones = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for c, n, w, z, o in rows:
            under[c, n], zeros[c, n], ones[c, n] = w, z, o
        log_e = log_kt(zeros, ones)
        log_w = np.logaddexp(log_e, under) - LN2
        self.stop1, self.zeros1, self.ones1 = np.exp(log_e - LN2 - log_w), zeros, ones
        self.zeros0, self.ones0 = zeros.sum(axis=0), ones.sum(axis=0)
        log_e0 = log_kt(self.zeros0, self.ones0)
        self.stop0 = np.exp(log_e0 - LN2 - (np.logaddexp(log_e0, log_w.sum(axis=0)) - LN2))


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's next byte in its context: the estimates of all depths, mixed from the deepest up, over eight decisions."""
    levels = subtree(keys, counts, depth)
    nxt, before = (keys & np.uint64(255)).astype(np.int64), (keys >> np.uint64(8 * depth)).astype(np.int64)
    spot = {d: np.searchsorted(levels[d].keys, ((keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | (keys & np.uint64(255))) for d in range(2, depth)}
    total = np.zeros(len(keys))
    for i in range(8):
        bit, node = (nxt >> (7 - i)) & 1, (1 << i) + (nxt >> (8 - i))
        p = levels[depth].kt(i, levels[depth].at[i], bit)
        for d in range(depth - 1, 1, -1):
            at = levels[d].at[i][spot[d]]
            here = levels[d].kt(i, at, bit)
            p = here + (1 - levels[d].stop[i][at]) * (p - here)
        for zeros, ones, stop in ((top.zeros1[before, node], top.ones1[before, node], top.stop1[before, node]), (top.zeros0[node], top.ones0[node], top.stop0[node])):
            here = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            p = here + (1 - stop) * (p - here)
        total += np.log(p)
    return total / LN10


# ---------------------------------------------------------------- packing


def _slice_of(keys: np.ndarray, depth: int) -> np.ndarray:
    return ((((keys >> np.uint64(8 * (depth - 1))) * np.uint64(2_654_435_761)) & np.uint64(2**32 - 1)) * np.uint64(SLICES) >> np.uint64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _sorted_packed(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _by_slice(keys: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, places of its grams) for sorted distinct grams; a gram's place follows from the grams alone."""
    parts = _slice_of(keys, depth)
    order = np.argsort(parts, kind="stable")
    edges = np.flatnonzero(np.r_[True, parts[order][1:] != parts[order][:-1], True]) if len(keys) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(parts[order[lo]]), order[lo:hi]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWERED).split()


def _held(key: object) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % MODULUS == HELD


TEXT, GRAMS, WORDS = 0, 1, 2
_COLUMNS = "block string, kind int, slice int, data binary, counts binary, held array<boolean>, sizes array<long>, n_train long"


def _blocks(docs: DataFrame, depth: int, block_bytes: int) -> DataFrame:
    """Blocks of documents, each once with its text and, by slice, with its distinct grams and words and their training counts."""
    kind = docs.schema["key"].dataType.simpleString()
    fields = ["block", "kind", "slice", "data", "counts", "held", "sizes", "n_train", "keys"]

    def rows_of(keys: list, texts: list[bytes], key_type: pa.DataType) -> pa.RecordBatch:
        name, held = uuid.uuid4().hex, [_held(k) for k in keys]
        sizes = [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        every, full = _counted(data, sizes, held, depth)
        out = [(name, TEXT, -1, _packed(data), None, held, sizes, len(held) - sum(held), keys)]
        for part, at in _by_slice(every, depth):
            out.append((name, GRAMS, part, _sorted_packed(every[at]), _packed(full[at]), None, None, 0, None))
        seen: Counter[bytes] = Counter()
        for text, h in zip(texts, held):
            words = text.split()
            if h:
                seen.update(dict.fromkeys(words, 0))
            else:
                seen.update(words)
        parts: dict[int, list[bytes]] = {}
        for w in seen:
            parts.setdefault(zlib.crc32(w) % SLICES, []).append(w)
        for part, words in parts.items():
            out.append((name, WORDS, part, zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), _packed(np.array([seen[w] for w in words], np.int64)), None, None, 0, None))
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.list_(key_type)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, texts, size, key_type = [], [], 0, None
        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                text = b" ".join(_words(t.as_py())) + bytes([END])
                if texts and size + len(text) > block_bytes:
                    yield rows_of(keys, texts, key_type)
                    keys, texts, size = [], [], 0
                keys.append(k.as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield rows_of(keys, texts, key_type)

    return docs.mapInArrow(run, f"{_COLUMNS}, keys array<{kind}>")


def _model(blocks: DataFrame, depth: int) -> DataFrame:
    """(kind, slice, data, counts, total, kinds): the counts of all blocks added, one row per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, keys, counts, seen, waiting = None, [], [], Counter(), 0

        def done() -> pa.RecordBatch:
            if at[0] == GRAMS:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                row = _sorted_packed(k), _packed(c), int(c.sum()), len(k)
            else:
                words = sorted(seen)
                c = np.array([seen[w] for w in words], np.int64)
                row = zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), _packed(c), int(c.sum()), int((c > 0).sum())
            return pa.RecordBatch.from_pydict({"kind": pa.array([at[0]], pa.int32()), "slice": pa.array([at[1]], pa.int32()), "data": pa.array([row[0]], pa.binary()), "counts": pa.array([row[1]], pa.binary()), "total": pa.array([row[2]], pa.int64()), "kinds": pa.array([row[3]], pa.int64())})

        for batch in batches:
            for kind, part, data, count in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (kind, part):
                    if at is not None:
                        yield done()
                    at, keys, counts, seen, waiting = (kind, part), [], [], Counter(), 0
                if kind == GRAMS:
                    keys.append(_sorted_unpacked(data))
                    counts.append(_unpacked(count, "<i8"))
                    waiting += len(keys[-1])
                    if waiting > 2 * len(keys[0]) + (1 << 20):  # add up now and then: memory follows the distinct grams
                        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, waiting = [k], [c], 0
                else:
                    for w, c in zip(zstandard.ZstdDecompressor().decompress(data).split(), _unpacked(count, "<i8").tolist()):
                        seen[w] += c
        if at is not None:
            yield done()

    rows = blocks.filter(F.col("kind") != TEXT).select("kind", "slice", "data", "counts")
    return rows.repartition("kind", "slice").sortWithinPartitions("kind", "slice").mapInArrow(run, "kind int, slice int, data binary, counts binary, total long, kinds long")


def _top(model: DataFrame, depth: int) -> Top:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for data, count in zip(*(c.to_pylist() for c in batch.columns)):
                rows = top_parts(_sorted_unpacked(data), _unpacked(count, "<i8"), depth)
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["context", "node", "below", "zeros", "ones"])

    parts = model.filter(F.col("kind") == GRAMS).select("data", "counts").mapInArrow(run, "context int, node int, below double, zeros long, ones long")
    sums = parts.groupBy("context", "node").agg(F.sum("below"), F.sum("zeros"), F.sum("ones"))
    return Top([tuple(r) for r in sums.collect()])  # 65,280 rows at most


def _answers(blocks: DataFrame, model: DataFrame, depth: int, top: Top) -> DataFrame:
    """(block, kind, slice, data, counts): for each block and slice the log probabilities of its grams, in their order, and its words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, logs, known = None, None, {}
        for batch in batches:
            out = []
            for kind, part, turn, block, data, count in zip(*(c.to_pylist() for c in batch.columns)):
                if turn == 0:
                    if kind == GRAMS:
                        keys = _sorted_unpacked(data)
                        logs = log10_probabilities(keys, _unpacked(count, "<i8"), depth, top)
                    else:
                        known = dict(zip(zstandard.ZstdDecompressor().decompress(data).split(), _unpacked(count, "<i8").tolist()))
                elif kind == GRAMS:
                    out.append((block, kind, part, _packed(logs[np.searchsorted(keys, _sorted_unpacked(data))].astype("<f4")), None))
                else:
                    words = zstandard.ZstdDecompressor().decompress(data).split()
                    out.append((block, kind, part, data, _packed(np.array([known[w] for w in words], np.int64))))
            if out:
                types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "kind", "slice", "data", "counts"])

    asked = blocks.filter(F.col("kind") != TEXT).select("kind", "slice", F.lit(1).alias("turn"), "block", "data", F.lit(None).cast("binary").alias("counts"))
    told = model.select("kind", "slice", F.lit(0).alias("turn"), F.lit("").alias("block"), "data", "counts")
    spread = told.unionByName(asked).repartition("kind", "slice").sortWithinPartitions("kind", "slice", "turn")
    return spread.mapInArrow(run, "block string, kind int, slice int, data binary, counts binary")


def _scored(blocks: DataFrame, answers: DataFrame, depth: int, n_tokens: int, n_kinds: int, n_ends: int) -> DataFrame:
    floor = n_tokens + (n_kinds + 1)

    def score(text: tuple, logs: list[bytes], words: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        data, held, sizes, keys, key_type = text
        sizes, raw = np.array(sizes, np.int64), zstandard.ZstdDecompressor().decompress(data)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        scorer = _Scorer(np.frombuffer(raw, np.uint8), sizes, depth)
        value = np.empty(len(scorer.every))
        for (_, at), packed in zip(_by_slice(scorer.every, depth), logs, strict=True):
            value[at] = _unpacked(packed, "<f4")
        scores = scorer.sums(value)
        count: dict[bytes, int] = {}
        for blob, counts in words:
            count |= zip(zstandard.ZstdDecompressor().decompress(blob).split(), _unpacked(counts, "<i8").tolist())
        tokens, known, base = [], [], []
        for start, size in zip(starts.tolist(), sizes.tolist()):
            c = np.array([*map(count.__getitem__, raw[start : start + size].split()), n_ends], np.int64)
            tokens.append(len(c))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 1.0) / floor).sum()))
        arrays = [pa.array(keys, key_type), pa.array(held), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([n_tokens] * len(keys), pa.int64()), pa.array(base), pa.array(scores), pa.array(-scores / math.log10(2) / sizes)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        text, logs, words = None, [], []
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for kind, data, counts, held, sizes, keys in zip(*(batch.column(c).to_pylist() for c in ("kind", "data", "counts", "held", "sizes", "keys"))):
                if kind == TEXT:
                    if text is not None:
                        yield score(text, logs, words)
                    text, logs, words = (data, held, sizes, keys, key_type), [], []
                elif kind == GRAMS:
                    logs.append(data)
                else:
                    words.append((data, counts))
        if text is not None:
            yield score(text, logs, words)

    texts = blocks.filter(F.col("kind") == TEXT).select("block", "kind", "slice", "data", F.lit(None).cast("binary").alias("counts"), "held", "sizes", "keys")
    both = texts.unionByName(answers, allowMissingColumns=True)
    key = blocks.schema["keys"].dataType.elementType.simpleString()
    return both.repartition("block").sortWithinPartitions("block", "kind", "slice").mapInArrow(run, f"key {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model is a context tree over bytes for each of the 255 binary decisions that make a byte; every node has a
    Krichevsky-Trofimov estimate from all training text, and the estimates of depths 0 to `depth` are mixed with the weights
    that context-tree weighting gives them. It predicts the words of a text, lower-cased in A-Z and parted by single blanks,
    and an end byte. Training rows are those whose CRC-32 of the key's text, modulo 7, is not 2 (a null key counts as '').
    A null or empty text is the end alone. Repeated rows count as often as they are there and score alike; other columns are not looked at; without
    training rows every estimate is one half. An empty table gives an empty table.

    No table of counts is broadcast, for its size grows with the corpus. Documents are gathered into blocks of bounded size, which
    are written once with their distinct grams and words by slice; tasks by slice add the counts of all blocks and answer each block
    in its own terms; tasks by block put text and answers together. The driver sees the sums of depth 1 (65,280 rows at most).
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth must be 2 to 5")
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    blocks = staged(_blocks(rows, depth, block_bytes), "lm-blocks")
    model = staged(_model(blocks, depth), "lm-model")
    ends = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    total, kinds = model.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    top = _top(model, depth)
    answers = _answers(blocks, model, depth, top)
    return _scored(blocks, answers, depth, total + ends, kinds + (ends > 0), ends).withColumnRenamed("key", key)


def op3_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))
