"""Secret scan with multipart credential linking, in columns only: no Python on the data and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import SPANS, documents_with, match_spans, table, with_row

#: Kinds in the order in which spans that start together are listed. The first three are always reported.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # as long as a run of such letters goes, 18 letters at least
HEX = "[0-9a-f]{16,}"
#: Weak candidates: reported only beside a part that completes them.
IDENTIFIER = r"""(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"""(?i:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ldaps?|s3)://[^\x00-\x20"'<>`\x7F]{3,}"""
#: A scope: between the end of one part of a secret and the start of the next are at most so many code points.
REACH = 400
#: Least length of a part by kind. Parts of one kind do not overlap, so at most n / length + 1 of them start within n code points.
LEAST = (18, 18, 16, 8, 24, 8)


def _spans(text: Column, pattern: str, kind: int, where: Column | None = None) -> Column:
    """Places of one kind; texts without any match cost one pass."""
    return F.when(text.rlike(pattern), match_spans(text, pattern, kind, where)).otherwise(F.array().cast(SPANS))


def _linked(parts: Column, longest: Column, reach: int) -> Column:
    """Weak parts with a completing part in their scope, from all parts of a text in order of start.

    An interval join inside the text. A partner starts at most `reach` behind the end of the part, or at most `reach` and the length
    of the text's `longest` part before its start, so it is among the neighbours in the order, whose number has a bound from
    these stretches and the least lengths. Only those are looked at, and none that could be a partner is left out.
    """
    secret = lambda p: p["k"].isin(0, 2, 4)
    other = lambda p: p["k"].isin(1, 3, 5)
    completes = lambda p, q: (secret(p) & other(q)) | (other(p) & secret(q))
    most = lambda n: sum(F.floor((n + reach) / least) + 1 for least in LEAST).cast("int")
    close = lambda p, q: F.greatest(p["s"], q["s"]) - F.least(p["e"], q["e"]) <= reach

    def has_partner(p, i):
        begin = F.greatest(i - most(longest), F.lit(0))
        around = F.slice(parts, begin + 1, i - begin + 1 + most(p["e"] - p["s"]))
        return F.exists(around, lambda q: completes(p, q) & close(p, q))

    return F.filter(parts, lambda p, i: (p["k"] >= 3) & has_partner(p, i))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _found(packed: DataFrame, reach: int) -> DataFrame:
    """Adds `base` and `spans` (array<struct<s,k,e>>, sorted) to a frame with a text column `text`."""
    text = F.col("text")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    mixed = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
    kinds = [
        _spans(text, ASSIGN, 0, long_enough),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
        _spans(text, IDENTIFIER, 3),
        _spans(text, TOKEN, 4, mixed),
        _spans(text, ENDPOINT, 5),
    ]
    made = packed.withColumn("parts", F.array_sort(F.concat(*kinds)))
    longest = F.coalesce(F.array_max(F.transform("parts", lambda p: p["e"] - p["s"])), F.lit(0))
    based = made.withColumns({"base": F.filter("parts", lambda p: p["k"] < 3), "longest": longest})
    weak = F.size("parts") > F.size("base")
    return based.withColumn("spans", F.when(weak, F.array_sort(F.concat("base", _linked(F.col("parts"), F.col("longest"), reach)))).otherwise(F.col("base"))).drop("parts", "longest")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Secrets per row: key, n_assign, n_access, n_hex, base_sha256, spans (text), places (array<struct<kind,start,end>>).

    Assignments, access identifiers and long hexadecimal runs are always reported. Identifiers (user, login, client id),
    tokens of mixed letters and endpoints are weak: an identifier or endpoint counts only with a secret (assignment,
    hexadecimal run, token), a token only with an access identifier, identifier or endpoint, with at most `reach` code points
    between the end of the earlier part and the start of the later, however long the parts are. A null or empty text has no spans (the
    hash is that of the empty text). Rows are judged one by one: repeated rows give the same twice, null keys stay null, and
    other columns are not looked at.
    """
    packed = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = _found(packed, reach)
    count = lambda k: F.size(F.filter("base", lambda p: p["k"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
        F.transform("spans", lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("places"),
    )


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars", mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The same rows and columns with every reported span replaced by `mask` (spans that overlap by one), `size` counted anew.

    Rows without a span keep text and size as they are, nulls included.
    """
    packed = _found(with_row(docs, text=F.coalesce(F.col(f"`{text}`"), F.lit(""))), reach)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        clear = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        out = F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], clear, F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    touched = F.size("spans") > 0
    masked = packed.withColumn("masked", F.when(touched, done).otherwise(F.col("row").getField(text)))
    changed = {text: F.col("masked")}
    if size is not None and size in docs.columns:
        changed[size] = F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema[size].dataType)).otherwise(F.col("row").getField(size))
    return documents_with(masked, docs.columns, **changed)


def op2_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("places")


def check_op2() -> str:
    """The same in SQL: places as rows, the scope as a join."""

    def places(kind: int, pattern: str, good: str = "true") -> str:
        rx = pattern.replace("'", "''")
        v = f"regexp_extract_all(t, '{rx}', 2)" if kind == 0 else "found"
        return f"""SELECT rid, {kind} AS k, s, s + length(x) AS e FROM (SELECT rid, found[i] AS x, value[i] AS v,
    CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s
  FROM (SELECT *, {v} AS value, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{rx}') AS found, regexp_split_to_array(t, '{rx}') AS pieces FROM d))) WHERE {good}"""

    mixed = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"
    parts = [places(0, ASSIGN, "length(v) >= 12"), places(1, ACCESS), places(2, HEX), places(3, IDENTIFIER), places(4, TOKEN, mixed), places(5, ENDPOINT)]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
parts AS ({" UNION ALL ".join(parts)}),
weak AS (SELECT * FROM parts p WHERE k >= 3 AND EXISTS (SELECT 1 FROM parts q WHERE q.rid = p.rid AND (q.k IN (0, 2, 4)) <> (p.k IN (0, 2, 4)) AND greatest(q.s, p.s) - least(q.e, p.e) <= {REACH})),
base AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, {listed} AS spans FROM parts WHERE k < 3 GROUP BY rid),
every AS (SELECT rid, {listed} AS spans FROM (SELECT * FROM parts WHERE k < 3 UNION ALL SELECT * FROM weak) GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""
