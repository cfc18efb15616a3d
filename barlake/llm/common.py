"""What the corpus operators share: reading, words, staging in the shared folder, places of regex matches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import work_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<s:int,k:int,e:int>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared work folder and read it again: the lineage ends there, its size is known, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as struct `row` beside the named columns, so that no column of the table can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def documents_with(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of documents out of `row`, some of them replaced."""
    return packed.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def match_spans(text: Column, pattern: Column | str, kind: int = 0, where: Column | None = None, measure: Callable[[Column], Column] = F.length) -> Column:
    """Places of all leftmost, non-overlapping matches as array<struct<s,k,e>>, end exclusive, in code points or another `measure`.

    The text is split at the matches; a match starts where the pieces and matches before it end. `where` is an array of
    booleans, one per match: those not true are left out. The running sum copies its array once per match, so the cost has a
    term with the square of the number of matches in one text, in pointers (20,000 matches: 0.2 s).
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = [F.split(text, rx, -1).alias("piece"), F.regexp_extract_all(text, rx, F.lit(0)).alias("found")]
    rows = F.arrays_zip(*parts, *([where.alias("ok")] if where is not None else []))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        s = acc["at"] + measure(x["piece"])
        e = s + measure(x["found"])
        here = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        good = x["found"].isNotNull() & x["ok"] if where is not None else x["found"].isNotNull()  # the last piece has no match
        return F.struct(F.coalesce(e, acc["at"]).alias("at"), F.when(good, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"]).cast(SPANS)
