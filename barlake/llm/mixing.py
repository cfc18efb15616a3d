"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities. Columns only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import WORD, documents_with, staged, table, with_row

DIMS = ("source", "lang", "topic")
#: Share of a class in the target: its share of the tokens to this power, so that small classes gain and large ones lose.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
RATE = 0.6
TOLERANCE = 1e-6
ROUNDS = 50


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def form_topic(text: Column, words: Column) -> Column:
    """A stand-in where a table has no topic: the form of a text, from its length and its marks."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, "|#*$%&<>{}[]=", ""))
    return F.when(words == 0, "empty").when(marks * 5 > words, "marked").when(words < 60, "short").when(words < 600, "article").otherwise("long")


def _class_of(column: Column) -> Column:
    """A class as text; null is a class of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def fit(cells: DataFrame, dims: Sequence[str], powers: Mapping[str, float], targets: Mapping[str, DataFrame] | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Factors of the cells (columns `dims`, `tokens`) so that the raked weights tokens * product of factors have the target shares in every margin.

    `targets[d]` (columns d as text like the cells', share) replaces the default target of dimension d; classes that it does
    not name get share 0, shares are scaled to 1. Each step sums a margin with partial sums, whatever the hot class, and joins
    the sums back; each round is written once and read again. The table of cells has one row per combination of classes, it
    never passes through the driver: only the largest deviation does. Classes without tokens keep factor 1. Rounds end when no margin is
    off by more than `tolerance` of its target, or after `rounds`: then some targets contradict each other (a class whose cells
    all have target 0 elsewhere), and the last weights stand. `deviation` tells which: the share by which the worst margin is off
    its target (0 where there is nothing to rake).
    """
    frame = cells
    for d in dims:
        given = (targets or {}).get(d)
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"))
        if given is None:
            share = sums.select(d, F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), powers.get(d, 1.0))).otherwise(0.0).alias("raw"))
        else:
            share = sums.join(given.select(d, F.col("share").cast("double").alias("raw")), d, "left").select(d, F.when(F.col("tokens") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("raw"))
        total = share.agg(F.sum("raw").alias("all_raw"))
        share = share.join(F.broadcast(total)).select(d, F.try_divide("raw", "all_raw").alias(f"target_{d}"))  # one row
        frame = frame.join(share, d).withColumn(f"factor_{d}", F.lit(1.0))
    frame = staged(frame, "mixing-cells")
    weight = reduce(lambda a, b: a * b, [F.col(f"factor_{d}") for d in dims], F.col("tokens").cast("double"))
    worst = 0.0
    for _ in range(rounds):
        step = frame
        for d in dims:
            others = reduce(lambda a, b: a * b, [F.col(f"factor_{x}") for x in dims if x != d], F.col("tokens").cast("double"))
            sums = step.groupBy(d).agg(F.sum(others).alias("margin"))
            new = F.when(F.col("margin") > 0, F.col(f"target_{d}") / F.col("margin")).otherwise(F.lit(1.0))
            step = step.join(sums, d).withColumn(f"factor_{d}", new).drop("margin")
        frame = staged(step, "mixing-round")
        # the last margin fits by construction; the others tell how far the round is
        off = [frame.groupBy(d).agg(F.sum(weight).alias("w"), F.first(f"target_{d}").alias("t")).select(F.when(F.col("t") > 0, F.abs(F.col("w") / F.col("t") - 1)).otherwise(0.0).alias("off")) for d in dims[:-1]]
        worst = reduce(DataFrame.unionAll, off).agg(F.coalesce(F.max("off"), F.lit(0.0))).first()[0] if off else 0.0
        if worst <= tolerance:
            break
    return frame.withColumns({"factor": reduce(lambda a, b: a * b, [F.col(f"factor_{d}") for d in dims]), "deviation": F.lit(float(worst))})


def _scale(cells: DataFrame, rate: float) -> float:
    """The number that turns factors into probabilities: the expected tokens are `rate` of all, probabilities above one count as one."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = rate * total
    for _ in range(100):
        capped = F.col("factor") * scale >= 1
        full, open_ = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("factor")))).first()
        if not open_:
            return scale
        new = (rate * total - full) / open_
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new
    return scale


def _uniform(key: Column, text: Column) -> Column:
    """In [0, 1), from the MD5 of key and text: the same row has the same draw in every run."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _calibrated(rows: DataFrame, dims: Sequence[str], powers, targets, rate: float) -> DataFrame:
    """Rows with columns `dims` (classes) and `tokens`, with `weight` (mean 1 over tokens), `probability` and `deviation` added."""
    cells = staged(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "mixing-sums")
    fitted = fit(cells, dims, powers, targets)
    total, scale = cells.agg(F.sum("tokens")).first()[0] or 0, _scale(fitted, rate)
    told = fitted.select(*dims, (F.col("factor") * float(total)).alias("weight"), F.least(F.lit(1.0), F.col("factor") * scale).alias("probability"), "deviation")
    # cells without a token have no weight to rake: their texts are empty, and one is kept like the average
    told = told.join(cells.filter("tokens = 0").select(*dims, F.lit(True).alias("empty")), list(dims), "left")
    told = told.select(*dims, F.when(F.col("empty"), 1.0).otherwise(F.col("weight")).alias("weight"), F.when(F.col("empty"), float(rate)).otherwise(F.col("probability")).alias("probability"), "deviation")
    return rows.join(staged(told, "mixing-weights"), list(dims))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dims: Mapping[str, Column] | None = None,
    powers: Mapping[str, float] = POWERS,
    targets: Mapping[str, DataFrame] | None = None,
    rate: float = RATE,
) -> DataFrame:
    """Per row: key, the classes, n_tokens (words), weight, probability, kept, and the deviation of the fit (see `fit`; the same in every row).

    `dims` names the dimensions to rake (default: columns source and lang and the form of the text as topic). A null class is a class of its
    own; a null or empty text has no tokens; rows that repeat get the same draw; rows with the same key and another text do
    not. An empty table gives an empty table. The draw is `probability` of a uniform number made from key and text.
    """
    body = F.col(f"`{text}`")
    dims = dims if dims is not None else {"source": F.col("source"), "lang": F.col("lang")} | {"topic": form_topic(body, word_count(body))}
    rows = docs.select(F.col(f"`{key}`").alias("key"), _uniform(F.col(f"`{key}`"), body).alias("draw"), word_count(body).alias("tokens"), *[_class_of(c).alias(f"d{i}") for i, c in enumerate(dims.values())])
    rows = _calibrated(rows, [f"d{i}" for i in range(len(dims))], {f"d{i}": powers.get(n, 1.0) for i, n in enumerate(dims)}, _by_place(targets, dims), rate)
    shown = [F.when(F.col(f"d{i}") != "null", F.substring(F.col(f"d{i}"), 2, 2**31 - 1)).alias(n) for i, n in enumerate(dims)]
    return rows.select(F.col("key").alias(key), *shown, F.col("tokens").alias("n_tokens"), "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"), "deviation")


def _by_place(targets: Mapping[str, DataFrame] | None, dims: Mapping[str, Column]) -> dict:
    """Targets (name, share) by the internal names of the dimensions."""
    return {f"d{i}": targets[n].select(_class_of(F.col(n)).alias(f"d{i}"), "share") for i, n in enumerate(dims) if targets and n in targets}


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", powers: Mapping[str, float] = POWERS, rate: float = RATE, dims: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows of `docs` that `mix` keeps, columns unchanged."""
    body = F.col(f"`{text}`")
    dims = dims if dims is not None else {"source": F.col("source"), "lang": F.col("lang")} | {"topic": form_topic(body, word_count(body))}
    columns = {"draw": _uniform(F.col(f"`{key}`"), body), "tokens": word_count(body)} | {f"d{i}": _class_of(c) for i, c in enumerate(dims.values())}
    rows = _calibrated(with_row(docs, **columns), [f"d{i}" for i in range(len(dims))], {f"d{i}": powers.get(n, 1.0) for i, n in enumerate(dims)}, None, rate)
    return documents_with(rows.filter(F.col("draw") < F.col("probability")), docs.columns)


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))
