"""Exact duplicates by two Bloom passes: rows whose hash occurs once pass straight through, only possibly repeated ones shuffle."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import documents_with, table, with_row
from barlake.session import materialise, work_dir

#: Blanks that do not count.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The filter is a table of slices of 2^16 bits; a hash belongs to one slice and has PLACES bits there.
SLICE_BITS, PLACES = 1 << 16, 4
#: Bits a row: about one unrepeated row in 400 is taken for a possible repeat.
BITS_A_ROW = 16
#: Largest filter that is broadcast at once; more rows are taken in several stretches of the hash range.
FILTER_BYTES = 1 << 26
#: Rows that a task marks before it hands on what it has.
MARKED_ROWS = 1 << 20
#: Groups with more than this share of all rows (and over HOT_ROWS rows) are looked up by broadcast: there are at most 1 / HOT_SHARE.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1000
_PRINT = "key, sha, length, at, slice, places"


@dataclass
class Prints:
    """Hashed rows in the shared folder: (key, sha, length, at, slice, places, stretch and, if whole, row)."""

    frame: DataFrame
    rows: int
    stretches: int

    def stretch(self, i: int) -> DataFrame:
        return self.frame.filter(F.col("stretch") == i)


def _hashed(texts: pa.Array) -> list[pa.Array]:
    """SHA-256 without blanks, code points of the original, and 16 bytes of the hash as two longs."""
    texts = texts.fill_null("")
    found = [hashlib.sha256(t.as_py().translate(None, BLANKS)).digest() for t in texts.cast(pa.large_binary())]
    words = np.frombuffer(b"".join(d[:16] for d in found), "<i8").reshape(-1, 2)
    return [pa.array(found, pa.binary()), pc.utf8_length(texts).cast(pa.int64()), pa.array(words[:, 0] & np.int64(2**63 - 1)), pa.array(words[:, 1])]


def prints(docs: DataFrame, key: str, text: str, whole: bool = False, filter_bytes: int = FILTER_BYTES) -> Prints:
    """Hash every row once and write what the passes need; the text itself is read no more unless `whole` keeps the row."""
    spark = docs.sparkSession
    packed = with_row(docs if whole else docs.select(docs[f"`{key}`"], docs[f"`{text}`"]))
    kept = packed.schema["row"].dataType
    key_at, text_at = kept.fieldNames().index(key), kept.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = [row.field(key_at), *_hashed(row.field(text_at))]
            yield pa.RecordBatch.from_arrays(columns + [row] * whole, names=["key", "sha", "length", "h", "places"] + ["row"] * whole)

    schema = f"key {kept[key].dataType.simpleString()}, sha binary, length long, h long, places long"
    made = packed.mapInArrow(run, schema + (f", row {kept.simpleString()}" if whole else ""))
    rows = docs.select(F.lit(1)).count()
    slices = max(1, math.ceil(rows * BITS_A_ROW / SLICE_BITS))
    most = max(1, filter_bytes * 8 // SLICE_BITS)
    stretches = math.ceil(slices / most)
    made = made.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", (F.col("h") % slices).cast("int")).drop("h")
    made = made.withColumn("stretch", (F.col("slice") % stretches).cast("int"))
    path = f"{work_dir(spark).rstrip('/')}/exact-prints-{uuid.uuid4().hex}"
    writer = made.write.partitionBy("stretch") if stretches > 1 else made.write
    writer.parquet(path)
    return Prints(spark.read.schema(made.schema).parquet(path), rows, stretches)


def _distinct_places(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    """slice * 2^16 + bit for every bit of every row, a bit that a row has twice only once."""
    bits = np.sort((places.view(np.uint64)[:, None] >> (16 * np.arange(PLACES, dtype=np.uint64))) & np.uint64(SLICE_BITS - 1), axis=1).astype(np.int64)
    fresh = np.ones(bits.shape, bool)
    fresh[:, 1:] = bits[:, 1:] != bits[:, :-1]
    return (slices[:, None] * SLICE_BITS + bits)[fresh]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """First pass in one task: (slice, bits), each bit listed once, or twice if two rows have it."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        bits, many = np.unique(np.concatenate(held), return_counts=True)
        bits = np.repeat(bits, np.minimum(many, 2))
        slices = bits >> 16
        starts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
        parts = np.split((bits & (SLICE_BITS - 1)).astype("<u2"), starts[1:])
        return pa.RecordBatch.from_arrays([pa.array(slices[starts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        if batch.num_rows:
            held.append(_distinct_places(*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))))
        if sum(map(len, held)) >= MARKED_ROWS * PLACES:
            yield out()
            held = []
    if held:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Marks in order of their slice to (slice, twice): the bits that two rows or more have, as 1,024 longs. Slices without any are left out."""
    last, counts = None, np.zeros(SLICE_BITS, np.uint8)

    def out() -> Iterator[pa.RecordBatch]:
        twice = counts > 1
        if last is not None and twice.any():
            words = np.packbits(twice, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([words], pa.list_(pa.int64()))], names=["slice", "twice"])

    for batch in batches:
        for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if at != last:
                yield from out()
                last, counts = at, np.zeros(SLICE_BITS, np.uint8)
            here, many = np.unique(np.frombuffer(bits, "<u2"), return_counts=True)
            counts[here] = np.minimum(counts[here] + many, 2)
    yield from out()


def repeat_filter(hashed: DataFrame) -> DataFrame:
    """(slice, twice) of all rows (slice, places): a hash that occurs twice has all its bits set there."""
    marks = hashed.select("slice", "places").mapInArrow(_marks, "slice int, bits binary")
    return marks.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice int, twice array<long>")


def _possibly_repeated() -> Column:
    """All bits of `places` are set in `twice`."""
    good = F.lit(True)
    for i in range(PLACES):
        bit = F.shiftrightunsigned("places", 16 * i).bitwiseAND(F.lit(SLICE_BITS - 1)).cast("int")
        good = good & (F.getbit(F.get("twice", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1)
    return F.coalesce(good, F.lit(False))


def _parted(hashed: Prints) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash cannot occur twice, rows whose hash may), by the second pass over each stretch."""
    alone, maybe = [], []
    for i in range(hashed.stretches):
        rows = hashed.stretch(i)
        # proven bound: at most `filter_bytes` of slices in a stretch, however many rows there are
        tested = rows.join(F.broadcast(materialise(repeat_filter(rows))), "slice", "left").withColumn("maybe", _possibly_repeated()).drop("twice")
        alone.append(tested.filter(~F.col("maybe")))
        maybe.append(tested.filter("maybe"))
    both = []
    for parts in (alone, maybe):
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        both.append(whole)
    return both[0], both[1]


def _grouped(maybe: DataFrame) -> DataFrame:
    """(sha, size, best) of the hashes that do occur twice; best is the row that stays."""
    order = F.struct((-F.col("length")).alias("shorter"), F.col("key").isNull().alias("none"), "key", "at")
    return maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("best")).filter("size > 1")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal if their SHA-256 without blanks (space, tab to carriage return) is; null counts as empty, and texts of
    blanks only are equal to it. Of equal texts the row with the most code points stays, then the one with the smallest
    key; a null key comes last, and of rows equal in both exactly one stays. An empty table gives an empty table; other columns are not looked at.
    """
    hashed = prints(docs, key, text, filter_bytes=filter_bytes)
    alone, maybe = _parted(hashed)
    maybe = materialise(maybe.select("key", "sha", "at", "length"))
    found = materialise(_grouped(maybe))
    limit = max(HOT_ROWS, int(hashed.rows * HOT_SHARE))
    told = lambda rows, sizes: rows.join(sizes, "sha", "left")
    # groups that could fill a task are at most 1 / HOT_SHARE, so their table is broadcast; a key of the join behind it has at most `limit` rows
    hot = told(maybe, F.broadcast(found.filter(F.col("size") > limit)))
    rest = told(hot.filter("size IS NULL").drop("size", "best"), found.filter(F.col("size") <= limit))
    out = lambda rows, keep, size, kept: rows.select(F.col("key").alias(key), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    single = F.col("size").isNull()
    named = [out(r, F.when(single, F.col("key")).otherwise(F.col("best.key")), F.coalesce("size", F.lit(1).cast("long")), single | (F.col("best.at") == F.col("at"))) for r in (hot.filter("size IS NOT NULL"), rest)]
    return out(alone, F.col("key"), F.lit(1).cast("long"), F.lit(True)).unionByName(named[0]).unionByName(named[1])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row of each group of equal texts, columns unchanged, chosen as in `groups`. Rows that the filter clears are not shuffled."""
    alone, maybe = _parted(prints(docs, key, text, True, filter_bytes))
    order = F.struct((-F.col("length")).alias("shorter"), F.col("key").isNull().alias("none"), "key", "at")
    winners = maybe.groupBy("sha").agg(F.min(order).alias("best")).select(F.col("best.at").alias("at"))
    kept = alone.select("row").unionByName(maybe.join(winners, "at", "left_semi").select("row"))
    return documents_with(kept, docs.columns)


def op13_bloom_exact(spark: SparkSession, folder: str) -> DataFrame:
    return groups(table(spark, folder, "documents"))


def check_op13() -> str:
    blanks = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{blanks}', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM d WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST)
"""
