"""Ordered series at any length: positions, blocks, running values with carries.

A series (all bars of one instrument, all rows of one fold, ...) may hold a large share of the whole table, so no
window here is partitioned by the series key alone. Rows get a dense position from per-bucket counts, are cut into
blocks of bounded length, and every window runs inside a block:

* a value with a finite or fading memory sees the last `halo` rows of the block before it (copied to the next block);
* a value with unlimited memory (running sums, last known value, running maximum) adds the carry of all earlier
  blocks, which comes from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.session import materialise

BLOCK_ROWS = 8192
BUCKET_SECONDS = 64 * 86400
FIRST = Window.unboundedPreceding
LAST = Window.unboundedFollowing


def _bucketed(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Add `_bucket`. Keys and bucket carry the error of a row that lacks one of them: a join on them, which lets go of nulls, meets it too."""
    if bucket is None:
        bucket = F.floor(F.unix_seconds(F.col(order[0])) / F.lit(BUCKET_SECONDS))
    message = F.lit(f"a row has no {', '.join(by)} or no place in the order")
    whole = lambda x, kind: F.when(x.isNull(), F.raise_error(message).cast(kind)).otherwise(x)
    return df.withColumns({c: whole(F.col(c), df.schema[c].dataType) for c in by} | {"_bucket": whole(bucket.cast("long"), "long")})


def index_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str] = ("ts",),
    bucket: Column | None = None,
) -> DataFrame:
    """Add `pos` (1, 2, ... within the series, in `order`) and `n` (length of the series).

    `bucket` is a coarse, order-preserving number of the row; by default 64 days of the first order column. Only one
    bucket of one series is sorted at a time; the series-wide part works on one row per bucket. A row without a key or
    without a place in the order raises: filter such rows first if they are meant to go.
    """
    keyed = _bucketed(df, by, order, bucket)
    per_series = Window.partitionBy(*by)
    offsets = (
        keyed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *by,
            "_bucket",
            F.coalesce(F.sum("_rows").over(per_series.orderBy("_bucket").rowsBetween(FIRST, -1)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(per_series).alias("n"),
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        keyed.join(offsets, [*by, "_bucket"])
        .withColumn("pos", F.row_number().over(inside) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def last_rows(df: DataFrame, by: Sequence[str], rows: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last `rows` rows of every series with their `pos` and `n`, as `index_rows` gives them.

    Rows are counted per bucket of 64 days; only the buckets that the last rows lie in go on to the sort. The counts are a
    row per bucket, so Spark can test the rows against them where they are read. A frame with `pos` and `n` is filtered.
    """
    if {"pos", "n"} <= set(df.columns):
        return df.filter(F.col("pos") > F.col("n") - F.lit(rows))
    keyed = _bucketed(df, by, order)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    after = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(FIRST, -1)), F.lit(0))
    tail = counts.select(*by, "_bucket", after.alias("_after"), F.sum("_rows").over(Window.partitionBy(*by)).alias("n"))
    turn = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*[F.desc(c) for c in order]))
    near = keyed.join(tail.filter(F.col("_after") < F.lit(rows)), [*by, "_bucket"]).withColumn("_turn", turn).filter(F.col("_turn") <= F.lit(rows))
    placed = near.withColumn("pos", F.col("n") - F.col("_after") - F.col("_turn") + 1)
    return placed.filter(F.col("pos") > F.col("n") - F.lit(rows)).drop("_bucket", "_after", "_turn")


def index_by_range(df: DataFrame, by: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """`index_rows` for tables where no bucket is known to be small: `order` has to be unique within the series.

    Rows are range partitioned on (series, order), which splits a hot series wherever its quantiles fall, and the
    result is checkpointed, so that the numbers of the parts stay the same in both passes.
    """
    keys = [*by, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    kept = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    return index_rows(kept, by, order, F.col("_part")).drop("_part")


def own_block(rows: int = BLOCK_ROWS) -> Column:
    return F.floor((F.col("pos") - 1) / F.lit(rows))


def with_blocks(df: DataFrame, rows: int = BLOCK_ROWS, halo: int = 0) -> DataFrame:
    """Add `block` and `is_halo`; the last `halo` rows of a block appear once more, as halo, in the block after it."""
    if halo > rows:
        raise ValueError("halo must not be longer than a block")
    own = own_block(rows)
    if halo == 0:
        return df.withColumns({"block": own, "is_halo": F.lit(False)})
    near_end = (F.col("pos") - 1) % F.lit(rows) >= F.lit(rows - halo)
    has_next = F.floor((F.col("n") - 1) / F.lit(rows)) > own
    targets = F.when(near_end & has_next, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("block", F.explode(targets)).withColumn("is_halo", F.col("block") != own)


def _local(kind: str, x: Column) -> Column:
    return {
        "sum": lambda: F.sum(x),
        "product": lambda: F.product(x),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "last": lambda: F.last(x, ignorenulls=True),
    }[kind]()


def _merge(kind: str, before: Column, here: Column) -> Column:
    return {
        "sum": lambda: F.coalesce(before + here, before, here),
        "product": lambda: F.coalesce(before * here, before, here),
        "max": lambda: F.greatest(before, here),
        "min": lambda: F.least(before, here),
        "last": lambda: F.coalesce(here, before),
    }[kind]()


Spec = Mapping[str, tuple[str, Column]]


def block_carries(df: DataFrame, by: Sequence[str], specs: Spec, block: str = "block", order: str = "pos") -> DataFrame:
    """One row per block: for each spec the aggregate over all EARLIER blocks of the series, as `_carry_<name>`."""
    totals = df.groupBy(*by, block).agg(
        *[
            (F.max_by(x, F.when(x.isNotNull(), F.col(order))) if kind == "last" else _local(kind, x)).alias(f"_total_{name}")
            for name, (kind, x) in specs.items()
        ]
    )
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(FIRST, -1)
    return totals.select(
        *by, block, *[_local(kind, F.col(f"_total_{name}")).over(earlier).alias(f"_carry_{name}") for name, (kind, _) in specs.items()]
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    specs: Spec,
    block: str = "block",
    order: str = "pos",
    before: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running aggregates from the start of the series up to the row, for `sum`, `product`, `max`, `min` and `last`
    (last non-null). `before` maps new names to spec names whose value is wanted up to the row BEFORE this one.

    The input must be free of halo rows. Its block totals are read directly from it, so the specs should be cheap
    expressions; there is no shuffle beyond the one on (series, block).
    """
    inside = Window.partitionBy(*by, block).orderBy(order)
    columns = {}
    for name, (kind, x) in specs.items():
        columns[name] = _merge(kind, F.col(f"_carry_{name}"), _local(kind, x).over(inside.rowsBetween(FIRST, 0)))
    for new, name in (before or {}).items():
        kind, x = specs[name]
        columns[new] = _merge(kind, F.col(f"_carry_{name}"), _local(kind, x).over(inside.rowsBetween(FIRST, -1)))
    carried = df.join(block_carries(df, by, specs, block, order), [*by, block], "left")
    return carried.withColumns(columns).drop(*[f"_carry_{name}" for name in specs])


def fill_gaps(df: DataFrame, by: Sequence[str], columns: Sequence[str], block: str = "block", order: str = "pos") -> DataFrame:
    """Fill nulls forward, then the leading ones backward, in every named column. Input without halo rows."""
    present = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in columns}
    totals = df.groupBy(*by, block).agg(
        *[F.max_by(F.col(c), present[c]).alias(f"_last_{c}") for c in columns],
        *[F.min_by(F.col(c), present[c]).alias(f"_first_{c}") for c in columns],
    )
    blocks = Window.partitionBy(*by).orderBy(block)
    edges = totals.select(
        *by,
        block,
        *[F.last(f"_last_{c}", ignorenulls=True).over(blocks.rowsBetween(FIRST, -1)).alias(f"_before_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(blocks.rowsBetween(FIRST, LAST)).alias(f"_lead_{c}") for c in columns],
    )
    inside = Window.partitionBy(*by, block).orderBy(order).rowsBetween(FIRST, 0)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_before_{c}"), F.col(f"_lead_{c}")) for c in columns
    }
    return df.join(edges, [*by, block], "left").withColumns(filled).select(*df.columns)


def fading_memory(span: float) -> int:
    """Rows after which the start value of an exponential average of this span has lost all weight in a double."""
    return int(20 * (span + 1))
