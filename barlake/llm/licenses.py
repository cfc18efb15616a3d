"""License detection by ordered signature rules: keyword gate, one pass of rules, containment and priority. No Python on the data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.common import LOWER, UPPER, match_spans, table

#: Words of the text with A-Z lowered, and what stands between them.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words without which no license is named by a common word.
NAMED = ("license", "licence", "licenses", "licences")

#: Phrases that every scan reports, with their labels and the word of each that opens the gate.
PHRASES = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "license"), ("all rights reserved", "reserved", "reserved"))

#: Families of licenses: label, keyword (a word of every name), names, versions; all in words parted by one blank.
FAMILIES = (
    ("agpl", "affero|agpl", r"(?:gnu )?affero (?:general )?public licen[cs]e|(?:gnu )?agpl", ("1", "3")),
    ("lgpl", "lesser|library|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("gpl", "public|gpl", r"(?:gnu )?general public licen[cs]e|(?:gnu )?gpl|gnu public licen[cs]e", ("1", "2", "3")),
    ("gfdl", "documentation|gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache|asl", r"apache(?: software)?(?: foundation)? licen[cs]es?|asl(?= )", ("1 0", "1 1", "2 0")),
    ("mit", "mit|expat", r"(?:the )?(?:mit|expat)(?: x11)? licen[cs]e", ()),
    ("x11", "x11|xfree86", r"(?:x11|xfree86) licen[cs]e", ("1 1",)),
    ("bsd", "bsd|berkeley", r"(?:bsd|berkeley software distribution)(?: style)? licen[cs]e", ()),
    ("bsd-0-clause", "bsd|0bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?|bsd (?:zero|0) clause(?: licen[cs]e)?|0bsd", ()),
    ("bsd-2-clause", "bsd|freebsd", r"(?:two|2) clause bsd(?: licen[cs]e)?|bsd (?:two|2) clause(?: licen[cs]e)?|(?:simplified|free) ?bsd licen[cs]e", ()),
    ("bsd-3-clause", "bsd", r"(?:three|3) clause bsd(?: licen[cs]e)?|bsd (?:three|3) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", ()),
    ("bsd-4-clause", "bsd", r"(?:four|4) clause bsd(?: licen[cs]e)?|bsd (?:four|4) clause(?: licen[cs]e)?|(?:original|old) bsd licen[cs]e", ()),
    ("isc", "isc|internet", r"(?:isc|internet (?:systems|software) consortium) licen[cs]e", ()),
    ("mpl", "mozilla|mpl", r"mozilla public licen[cs]e|mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse|epl", r"eclipse public licen[cs]e|epl", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", ("1 0",)),
    ("cddl", "common|cddl", r"common development and distribution licen[cs]e|cddl", ("1 0", "1 1")),
    ("cpl", "common", r"common public licen[cs]e", ("1 0",)),
    ("cpal", "common|cpal", r"common public attribution licen[cs]e|cpal", ("1 0",)),
    ("eupl", "european|eupl", r"european union public licen[cs]e|eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"(?:clarified |perl )?artistic licen[cs]e", ("1 0", "2 0")),
    ("boost", "boost", r"boost software licen[cs]e", ("1 0",)),
    ("zlib", "zlib|libpng", r"zlib(?: libpng)? licen[cs]e|libpng licen[cs]e", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("beerware", "beer|beerware", r"beer ?ware licen[cs]e", ()),
    ("python", "python|psf", r"(?:python software foundation|psf|python) licen[cs]e", ("2", "2 0")),
    ("php", "php", r"php licen[cs]e", ("3 0", "3 01")),
    ("ruby", "ruby", r"ruby licen[cs]e", ()),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e", ()),
    ("ofl", "ofl|font", r"(?:sil )?open font licen[cs]e|ofl", ("1 0", "1 1")),
    ("odbl", "database|odbl", r"open database licen[cs]e|odbl", ("1 0",)),
    ("odc-by", "attribution", r"open data commons attribution licen[cs]e", ("1 0",)),
    ("pddl", "pddl|dedication", r"(?:open data commons )?public domain dedication and licen[cs]e|pddl", ("1 0",)),
    ("ogl", "government", r"open government licen[cs]e", ("1 0", "2 0", "3 0")),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ()),
    ("osl", "open|osl", r"open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", r"academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ecl", "educational", r"educational community licen[cs]e", ("1 0", "2 0")),
    ("ncsa", "ncsa|illinois", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ()),
    ("openssl", "openssl", r"openssl licen[cs]e", ()),
    ("bsl", "business|busl", r"business source licen[cs]e|busl", ("1 1",)),
    ("sspl", "server|sspl", r"server side public licen[cs]e|sspl", ("1",)),
    ("elastic", "elastic", r"elastic licen[cs]e", ("1 0", "2 0")),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", ("1 0", "2 0", "2 1")),
    ("cc0", "cc0|creative", r"cc0|creative commons zero", ("1 0",)),
    ("cc-by-nc-nd", "cc|creative", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc|creative", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc|creative", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc|creative", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc|creative", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc|creative", r"(?:cc|creative commons) (?:by|attribution)", ("2 0", "2 5", "3 0", "4 0")),
)

#: Notices that name no license: label, keyword, pattern.
NOTICES = (
    ("reserved", "reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", r"(?:c )?copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?"),
    ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", "domain", r"public domain (?:mark|dedication|work)"),
    ("permissive-grant", "permission", r"permission is hereby granted free of charge"),
    ("permissive-grant", "permission", r"permission to use copy modify and or distribute this software"),
    ("redistribution", "redistribution", r"redistribution and use in source and binary forms"),
    ("disclaimer", "warranty|warranties", r"(?:without|no) warrant(?:y|ies) of any kind"),
    ("disclaimer", "provided", r"(?:software|work|material) is provided as is"),
    ("attribution-required", "attribution", r"attribution (?:is )?required"),
    ("non-commercial", "commercial|noncommercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("proprietary", "proprietary|confidential", r"proprietary and confidential|confidential and proprietary"),
    ("no-redistribution", "redistribute|reproduced", r"(?:do not|may not be) (?:redistribute|reproduced)"),
    ("license-file", "license|licence", r"see (?:the )?licen[cs]e (?:file )?for (?:more )?(?:details|information)"),
    ("trademark", "trademark|trademarks", r"(?:registered )?trademarks? of"),
)

#: Confidence of a detection by priority: tag, grant with version, grant, name with version, name, notice.
CONFIDENCE = (1.0, 0.95, 0.9, 0.85, 0.7, 0.5)
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistribute it) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def rules() -> list[tuple[str, str, str, int]]:
    """All signatures, in order: (label, keywords, pattern over words, priority). The smaller priority wins.

    Keywords are words of which one must stand in the text; before a '+' stands a family's own, and then one of NAMED too.
    """
    out = []
    for label, keys, names, versions in FAMILIES:
        name = f"(?:{names})"
        needed = [re.sub(r"\(\?:[^()]*\)\?", "", x) for x in _alternatives(names)]  # without what may be left out
        keys += "+" if all("licen[cs]e" in x for x in needed) else ""
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            later = "(?: (?:or|and) (?:any )?later(?: versions?)?| only)?"
            number = f"{v}{'(?: 0)?' if ' ' not in v else ''}(?! [0-9])"
            spdx = f"spdx licen[cs]e identifier {label.replace('-', ' ')} {number}{later}"
            at = f"(?: licen[cs]e)?(?: version| v| ver)? ?(?:v)?{number}{later}(?: (?:international|unported|licen[cs]e))?"
            out += [(tag, "spdx", spdx, 0), (tag, keys, GRANT + name + at, 1), (tag, keys, name + at, 3)]
        out += [(label, "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ')}", 0), (label, keys, GRANT + name, 2), (label, keys, name, 4)]
    out += [(label, keys, pattern, 5) for label, keys, pattern in NOTICES]
    return out


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keywords() -> list[str]:
    """Words of which one stands in every text that a rule or phrase can match."""
    own = {k for _, keys, _, _ in rules() if keys[-1] != "+" for k in keys.split("|")}
    return sorted(own | {*NAMED} | {word for *_, word in PHRASES})


def _all_keywords() -> list[str]:
    return sorted({*keywords()} | {k for _, keys, _, _ in rules() for k in keys.rstrip("+").split("|")})


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _base(packed: DataFrame) -> DataFrame:
    """Phrases by one pattern over the words: they share no word, so their places cannot overlap."""
    rx = "(?<= )(?:" + "|".join(p for p, *_ in PHRASES) + ")(?= )"
    cut = packed.withColumns({"found": F.regexp_extract_all("norm", F.lit(rx), F.lit(0)), "pieces": F.split("norm", rx, -1)})
    n, after = F.size("found"), F.element_at("pieces", -1)
    last = F.col("n_words") - (_spaces(after) - 1) - (_spaces(F.element_at("found", -1)) + 1)
    names = F.create_map(*[F.lit(x) for pair in PHRASES for x in pair[:2]])
    return cut.withColumns(
        {
            "n_base": n.cast("long"),
            "first_word": F.when(n > 0, (_spaces(F.element_at("pieces", 1)) - 1).cast("long")),
            "last_word": F.when(n > 0, last.cast("long")),
            "base": F.transform(F.array_distinct("found"), lambda p: names[p]),
        }
    )


def _detections(norm: Column, words: Column) -> Column:
    """Detections of all rules whose keyword is there, as array<struct<s,o,k>>, in words: s is the first, o minus the end, so that the order is by start, longest first, then by rule.

    Places are counted in blanks: before a match stands one more blank than words.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("k"), _texts(keys.rstrip("+").split("|")).alias("keys"), _texts(NAMED if keys[-1] == "+" else keys.split("|")).alias("also"), F.lit(f"(?<= )(?:{rx})(?= )").alias("rx")) for i, (_, keys, rx, _) in enumerate(rules())])
    active = F.filter(listed, lambda r: F.arrays_overlap(r["keys"], words) & F.arrays_overlap(r["also"], words) & F.regexp(norm, r["rx"]))
    hits = F.flatten(F.transform(active, lambda r: F.transform(match_spans(norm, r["rx"], measure=_spaces), lambda x: F.struct((x["s"] - 1).alias("s"), (-x["e"]).alias("o"), r["k"].alias("k")))))
    return F.array_sort(hits)


def _kept(hits: Column, priority: Column) -> Column:
    """Containment, then priority. A detection inside one before it in the order goes; what is left has rising starts and ends, and there one goes that overlaps a neighbour of better priority."""
    kind = "array<struct<s:int,o:int,k:int>>"

    def outer(acc, x):
        inside = -x["o"] <= acc["end"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(x)))
        return F.struct(F.greatest(acc["end"], -x["o"]).alias("end"), out.alias("out"))

    chain = F.aggregate(hits, F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("out")), outer, lambda a: a["out"])

    def loses(x, y):
        return (x["s"] < -y["o"]) & (y["s"] < -x["o"]) & (F.element_at(priority, y["k"] + 1) < F.element_at(priority, x["k"] + 1))

    before = lambda xs, i: F.get(xs, i - 1)  # noqa: E731  null before the first
    after = lambda xs, i: F.get(xs, i + 1)
    return chain, lambda xs: F.filter(xs, lambda x, i: ~(F.coalesce(loses(x, before(xs, i)), F.lit(False)) | F.coalesce(loses(x, after(xs, i)), F.lit(False))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License detections per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    `detections` is array<struct<label, first, last, confidence>> with places in words (last exclusive), in order. A null or
    empty text has no words and no labels and scores 0; rows are judged one by one, so repeated rows give the same twice, a
    null key stays null, and other columns of the table are not looked at. A text goes through the rules only if one of
    their keywords stands in it; the gate lets through every text that any rule or phrase could match.
    """
    packed = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # lower() also changes other letters, yet only to letters: the pieces have the same number, and every keyword is found
    cut = packed.withColumn("cut", F.split(F.lower("text"), GAP, -1))
    edges = (F.element_at("cut", 1) == "").cast("int") + ((F.size("cut") > 1) & (F.element_at("cut", -1) == "")).cast("int")
    counted = cut.select(key, "text", (F.size("cut") - edges).cast("long").alias("n_words"), F.arrays_overlap("cut", _texts(keywords())).alias("gate"))
    words = F.when(F.col("gate"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))).otherwise(F.array().cast("array<string>"))
    listed = counted.withColumn("words", words)
    based = _base(listed.withColumn("norm", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))).drop("text", "found", "pieces")
    known = F.array_intersect("words", _texts(_all_keywords()))
    all_rules = rules()
    based = based.withColumn("known", known)  # read twice below, so that it is made once and not for every rule
    found = based.withColumn("hits", F.when(F.size("known") > 0, _detections(F.col("norm"), F.col("known"))).otherwise(F.array().cast("array<struct<s:int,o:int,k:int>>"))).drop("words")
    priority = F.array(*[F.lit(p) for *_, p in all_rules])
    chain, settle = _kept(F.col("hits"), priority)
    kept = found.withColumn("chain", chain).withColumn("kept", settle(F.col("chain")))
    label, confidence = _texts(r[0] for r in all_rules), F.array(*[F.lit(c) for c in CONFIDENCE])
    detections = F.transform(
        "kept",
        lambda x: F.struct(
            F.element_at(label, x["k"] + 1).alias("label"),
            x["s"].alias("first"),
            (-x["o"]).alias("last"),
            F.element_at(confidence, F.element_at(priority, x["k"] + 1) + 1).alias("confidence"),
        ),
    )
    told = kept.withColumn("detections", detections)
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    floor = F.when(F.size("base") > 0, F.lit(CONFIDENCE[-1])).otherwise(F.lit(0.0))
    return told.select(
        key,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(floor, F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))).alias("score"),
        "detections",
    )


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("detections")
