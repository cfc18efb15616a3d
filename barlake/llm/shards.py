"""Placement of documents on shards through a lookup table that the shards fill in turn."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import table
from barlake.session import work_dir

SLOTS = 65_537  # prime, so that every step visits every slot
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
#: Files that the query writes for each shard.
FILES = 2


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Owner (index into `shards`) of each of `slots` slots, a prime number.

    A shard's name gives it a start and a step and so an order of preference over all slots; the shards take turns, each
    claiming the first free slot of its order, until none is free. Shares differ by one slot at most, and a shard that comes
    or goes moves few slots beside its own.
    """
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most as many as slots")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    steps = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner = [-1] * slots
    free = slots
    while True:
        for shard, step in enumerate(steps):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot], at[shard] = shard, (slot + step) % slots
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row of `docs` with `slot` and `shard` (columns of these names are replaced).

    Rows without a key are placed like the key ''. Repeated keys go to one shard. An empty table stays empty. Only the key
    column is looked at. The lookup table has `slots` rows whatever the data, so it is broadcast; no row is shuffled.
    """
    spark = docs.sparkSession
    owner = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return rows.join(F.broadcast(owner), "slot", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "shard")


def write_shards(placed: DataFrame, path: str, files: int = 1, tasks: int | None = None) -> None:
    """One folder per shard with up to `files` files each: rows are dealt to them in turn, so that a large shard, or one key
    that most rows share, can be many tasks. Without `tasks` Spark joins small ones, and their files with them."""
    dealt = placed.withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    keys = ("shard", "_file")
    spread = dealt.repartition(tasks, *keys) if tasks else dealt.repartition(*keys)
    spread.drop("_file").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str, placed: DataFrame, shards: Sequence[str] | None = None) -> DataFrame:
    """Rows as `write_shards` wrote them; of `shards` alone, whose folders only are read."""
    rows = spark.read.schema(placed.schema).parquet(path)
    return rows if shards is None else rows.filter(F.col("shard").isin(*shards))


def op8_shard_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents are placed and written to their shards; the result is read from there."""
    placed = place(table(spark, folder, "documents"))
    path = f"{work_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(placed, path, FILES)
    return read_shards(spark, path, placed).select("doc_id", "slot", "shard")


def check_op8() -> str:
    owner = lookup_table(SHARDS)
    return f"""
WITH slots AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents),
owners AS (SELECT {owner} AS owner)
SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM slots, owners
"""
