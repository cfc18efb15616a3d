"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes with them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barlake.llm.common import table

#: Fixed values of the base measures.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Share of a document's words that failing lines may take.
MAX_LOSS = 0.5
ENDS = tuple(".!?:;…。！？")
CLOSERS = "\"')]»”’*_ \t\x0b\x0c\r"
#: The same in further scripts.
FURTHER_ENDS = tuple("।॥؟۔؛።፧፨։။។៕།༎᠃᠉᱾᱿꯫꧉᭟෴߹׃．｡；：‼‽⁇⁈⁉")
FURTHER_CLOSERS = "“‘›」』）】〉》］\u200b\u200c\u200d\u200e\u200f"
#: Thai and Lao put no mark at the end: a paragraph mostly of these letters is prose from so many of them on.
MARKLESS = re.compile("[\u0e01-\u0e4e\u0e81-\u0ecd]")
MARKLESS_LETTERS = 40
#: A line ends inside a sentence only if it is this long, and lines are wrapped to a width only up to this one.
OPEN_WORDS, OPEN_CHARS, MAX_WIDTH = 4, 24, 120
LISTED = re.compile(r"[-*•·–+]\s|[0-9]{1,3}[.)]\s")
SEPARATORS = frozenset(("|", "»", ">", "·", "•", "/", "::", "-", "–"))
MENU = frozenset(
    "home menu login logout register search next previous prev back top share contact about sitemap faq help print "
    "skip accueil connexion rechercher suivant startseite anmelden suche weiter zurück kontakt inicio buscar siguiente anterior contacto".split()
)
BOILERPLATE = re.compile(
    r"lorem ipsum|enable javascript|javascript is (?:disabled|required)|cookie policy|use(?:s)? (?:of )?cookies|privacy policy|terms of (?:use|service)"
    r"|subscribe to (?:our|the) newsletter|click here to|follow us on|sign up for|add to cart|share (?:this )?on (?:facebook|twitter)|powered by",
    re.IGNORECASE,
)


def _closed(text: str) -> bool:
    """Ends with an end mark."""
    return text.rstrip(CLOSERS + FURTHER_CLOSERS).endswith(ENDS + FURTHER_ENDS)


def _prose(line: str, words: list[str]) -> bool:
    """A line or paragraph that ends like a sentence, or was cut off within its last one, or is of a script without end marks."""
    if _closed(line) or (len(words) >= 20 and 40 * sum(map(_closed, words)) >= len(words)):
        return True
    if line.isascii():
        return False
    return (n := len(MARKLESS.findall(line))) >= MARKLESS_LETTERS and 2 * n > sum(map(len, words))


def line_fault(line: str, words: list[str], inside: bool = False) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation or boilerplate. A line `inside` a paragraph needs no end mark."""
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators * 5 >= len(words):
        return "navigation"
    if len(words) <= 10 and 2 * sum(w.strip(".,:;!?").lower() in MENU for w in words) > len(words):
        return "navigation"
    marks = sum(line.count(c) for c in "#*$%&|<>{}")
    if marks > len(words):
        return "punctuation"
    if not inside and not _prose(line, words):
        return "punctuation"
    return "boilerplate" if BOILERPLATE.search(line) else None


def _within_paragraphs(lines: list[str], words: list[list[str]], faults: list[str | None]) -> None:
    """Judge the end mark of wrapped lines on their paragraph, in place.

    A line is continued by the next one if that has words and begins with a small letter or one of a script without case, or
    if its first word would not have fitted on the line (the text is wrapped to a width). List items begin anew. A paragraph of
    continued lines has to be prose as a whole; then those of its lines that end inside a sentence pass.
    """
    inner = [line_fault(x, w, True) if f == "punctuation" else f for x, w, f in zip(lines, words, faults)]
    bare = [x.lstrip("> \t") for x in lines]
    widths = [len(x.rstrip()) for x, w in zip(lines, words) if w]
    width = max((n for n in widths if n <= MAX_WIDTH), default=0)
    wrapped = sum(0.8 * width < n <= width for n in widths) >= 3

    def continued(i: int) -> bool:
        if i + 1 == len(lines) or not words[i] or not words[i + 1] or not bare[i + 1] or inner[i] in ("navigation", "punctuation") or inner[i + 1] in ("navigation", "punctuation"):
            return False
        if LISTED.match(bare[i + 1]) or (len(words[i]) < OPEN_WORDS and len(lines[i]) < OPEN_CHARS):
            return False
        first = bare[i + 1].lstrip("\"'([{«“‘„「『（—…¿¡")[:1]
        if first.isalpha() and not first.isupper() and not first.istitle():
            return True
        return wrapped and len(lines[i].rstrip()) <= width < len(lines[i].rstrip()) + 1 + len(bare[i + 1].split(None, 1)[0])

    start = 0
    for i in range(len(lines)):
        if continued(i):
            continue
        some = range(start, i + 1)
        if len(some) > 1 and any(faults[j] != inner[j] for j in some) and _prose(lines[i], words[i]) | _prose("\n".join(lines[start : i + 1]), [w for j in some for w in words[j]]):
            for j in some:
                faults[j] = inner[j]
        start = i + 1


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that stand in the text twice or more. Windows are told apart by rank, by pairs of pairs of pairs: exact, and in memory of a few numbers per word."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width = 1
    while width < WINDOW:
        both = rank[: n - 2 * width + 1] * (int(rank.max()) + 1) + rank[width:]
        kinds, rank = np.unique(both, return_inverse=True)
        if len(kinds) == len(rank):
            return 0
        width *= 2
    again = (np.bincount(rank)[rank] > 1).astype(np.int32)
    cover = np.zeros(n + 1, np.int32)
    cover[: len(again)] += again
    cover[WINDOW : WINDOW + len(again)] -= again
    return int((np.cumsum(cover[:n]) > 0).sum())


def judged(text: str | None, max_loss: float = MAX_LOSS) -> tuple[int, int, int, int, int, bool, bool, int, str | None]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words lost, cleaned text (null stays null)."""
    whole = text or ""
    raw = whole.encode()
    words = raw.split()  # bytes part at ASCII white space only
    chars = len(whole) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    out, duplicates, lost = [], 0, 0
    lines = whole.split("\n")
    inside = [[w.decode() for w in line.encode().split()] for line in lines]
    faults = [line_fault(line, ws) if ws else None for line, ws in zip(lines, inside)]
    if len(lines) > 1 and "punctuation" in faults:
        _within_paragraphs(lines, inside, faults)
    for line, ws, fault in zip(lines, inside, faults):
        if ws:
            duplicates += line in seen
            seen.add(line)
            if fault:
                lost += len(ws)
                continue
        out.append(line)
    n, repeated = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not failed and lost <= max_loss * n
    return n, chars, symbols, duplicates, repeated, failed, kept, lost, None if text is None else "\n".join(out)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", max_loss: float = MAX_LOSS, cleaned: bool = True) -> DataFrame:
    """Key, the measures and, if wanted, the cleaned text of every row.

    A null text has no words, fails and stays null; an empty text fails too. Rows are judged one by one, so repeated rows
    give the same twice and null keys stay null; other columns are not looked at. One pass without a shuffle.
    """
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(judged(t.as_py(), max_loss) for t in batch.column(1))))
            if batch.num_rows:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * cleaned
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", *(m.split()[0] for m in MEASURES.split(", ")), *["cleaned"] * cleaned])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {MEASURES}" + ", cleaned string" * cleaned).withColumnRenamed("key", key)


def clean(docs: DataFrame, text: str = "text", size: str | None = "n_chars", max_loss: float = MAX_LOSS) -> DataFrame:
    """The rows that the rules keep, same columns, failing lines gone from the text and `size` counted anew."""
    names = docs.columns
    at, length = names.index(text), names.index(size) if size in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            results = [judged(t.as_py(), max_loss) for t in batch.column(at)]
            chosen = pa.array([i for i, r in enumerate(results) if r[6]], pa.int64())
            columns = [batch.column(i).take(chosen) for i in range(len(names))]
            texts = [r[8] for r in results if r[6]]
            columns[at] = pa.array(texts, batch.column(at).type)
            if length is not None:
                columns[length] = pa.array([len(t) for t in texts], batch.column(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return measure(table(spark, folder, "documents"), cleaned=False)


def check_op1() -> str:
    """The same in SQL: words, windows, lines and paragraphs as rows."""
    quoted = lambda xs: ", ".join("'" + x + "'" for x in sorted(xs))
    closers = CLOSERS.replace("]", r"\]").replace("'", "''").replace("\t", r"\t").replace("\x0b", r"\x0B").replace("\x0c", r"\x0C").replace("\r", r"\r")
    closed = f"[{''.join(ENDS + FURTHER_ENDS)}][{closers}{FURTHER_CLOSERS}]*$"
    blank = r"[\x20\x09-\x0D]+"
    space = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    opening = r"""["''(\[{«“‘„「『（—…¿¡]"""
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '{blank}'), lambda x: x <> '')"
    prose = lambda closes, n, ends, thai, chars: f"({closes} OR ({n} >= 20 AND 40 * {ends} >= {n}) OR ({thai} >= {MARKLESS_LETTERS} AND 2 * {thai} > {chars}))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, {split("t")} AS words FROM d),
grams AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
lines AS (SELECT rid, k, line, {split("line")} AS lw, regexp_replace(line, '^[> \t]+', '') AS bare, length(regexp_replace(line, '[{space}]+$', '')) AS wide
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)),
told AS (SELECT *, len(lw) AS n, len(list_filter(lw, lambda x: x IN ({quoted(SEPARATORS)}))) AS separators, length(array_to_string(lw, '')) AS chars,
  len(list_filter(lw, lambda x: lower(trim(x, '.,:;!?')) IN ({quoted(MENU)}))) AS menu, length(line) - length(regexp_replace(line, '[#*$%&|<>{{}}]', '', 'g')) AS marks,
  len(list_filter(lw, lambda x: regexp_matches(x, '{closed}'))) AS ends, length(line) - length(regexp_replace(line, '{MARKLESS.pattern}', '', 'g')) AS thai,
  regexp_matches(line, '{closed}') AS closes, regexp_matches(line, '(?i){BOILERPLATE.pattern}') AS boiler FROM lines),
faulty AS (SELECT *, CASE WHEN n = 0 THEN '' WHEN (separators >= 2 AND separators * 5 >= n) OR (n <= 10 AND 2 * menu > n) THEN 'navigation' WHEN marks > n THEN 'marks'
  WHEN NOT {prose("closes", "n", "ends", "thai", "chars")} THEN 'open' WHEN boiler THEN 'boilerplate' ELSE '' END AS fault FROM told),
inner_ AS (SELECT *, CASE WHEN fault <> 'open' THEN fault WHEN boiler THEN 'boilerplate' ELSE '' END AS within FROM faulty),
widths AS (SELECT rid, coalesce(max(wide) FILTER (wide <= {MAX_WIDTH}), 0) AS width FROM inner_ WHERE n > 0 GROUP BY rid),
wraps AS (SELECT rid, any_value(width) AS width, count(*) FILTER (5 * wide > 4 * width AND wide <= width) >= 3 AS wrapped FROM inner_ JOIN widths USING (rid) WHERE n > 0 GROUP BY rid),
following AS (SELECT i.*, width, wrapped, lead(n) OVER l AS n2, lead(bare) OVER l AS bare2, lead(within) OVER l AS within2 FROM inner_ i LEFT JOIN wraps USING (rid) WINDOW l AS (PARTITION BY rid ORDER BY k)),
joined AS (SELECT *, coalesce(n > 0 AND n2 > 0 AND bare2 <> '' AND within NOT IN ('navigation', 'marks') AND within2 NOT IN ('navigation', 'marks')
  AND NOT regexp_matches(bare2, '^(?:[-*•·–+][{space}]|[0-9]{{1,3}}[.)][{space}])') AND NOT (n < {OPEN_WORDS} AND length(line) < {OPEN_CHARS})
  AND (regexp_matches(bare2, '^{opening}*[\p{{Ll}}\p{{Lo}}\p{{Lm}}]') OR (wrapped AND wide <= width AND width < wide + 1 + length(regexp_extract(bare2, '^[{space}]*([^{space}]+)', 1)))), false) AS goes_on FROM following),
grouped AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paragraph FROM joined),
paragraphs AS (SELECT rid, paragraph, count(*) > 1 AND ({prose("arg_max(closes, k)", "arg_max(n, k)", "arg_max(ends, k)", "arg_max(thai, k)", "arg_max(chars, k)")}
  OR {prose("false", "sum(n)", "sum(ends)", "sum(thai)", "sum(chars)")}) AS whole FROM grouped GROUP BY rid, paragraph),
judged AS (SELECT g.*, CASE WHEN whole THEN within ELSE fault END <> '' AS fails, row_number() OVER (PARTITION BY g.rid, line ORDER BY k) > 1 AS copy FROM grouped g JOIN paragraphs p ON p.rid = g.rid AND p.paragraph = g.paragraph),
by_line AS (SELECT rid, count(*) FILTER (copy AND n > 0) AS doubled, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(doubled, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words FROM w LEFT JOIN repeated r USING (rid) LEFT JOIN by_line USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_lost_words <= {MAX_LOSS} * n_words AS kept, n_lost_words FROM f
"""
