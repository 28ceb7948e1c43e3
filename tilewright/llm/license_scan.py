"""License scan with ordered signature rules, in Spark expressions only.

A text is reduced to its words (ASCII letters and digits and everything beyond ASCII, lower-cased)
joined by single spaces, so that line breaks, comment marks and punctuation don't hide a signature.
A rule is a regular expression over those words with a keyword, a label, a priority and a
confidence. Keywords are sought first, and only the rules of the keywords found are run. Detections
are intervals of words. Read by start (longest first, then by priority and rule order), a detection
is suppressed if one before it of the same or a higher priority contains it; the rest is kept.

Null text counts as empty: no words, no detections, score 0. Documents are treated row by row, so
repeated rows and ids, ties and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import operator
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.chat_format import let
from tilewright.llm.license_signatures import SIGNATURES
from tilewright.session import table

#: What separates words: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters that mark a match; they are separators, so no word holds them.
OPENS, CLOSES = "\x01", "\x02"
#: Phrases of the base scan and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Parts of keywords: a text that holds none of them holds no keyword.
STEMS = (
    "licens", "public", "gpl", "cc by", "cc0", "creative", "spdx", "gfdl", "software", "apache", "mozilla", "eclipse",
    "artistic", "open font", "open database", "academic free", "documentation", "hope that it", "permissi",
    "redistribution and use", "neither the name", "advertising", "provided as is", "free and unenc", "you want",
    "clause", "rights reserved", "confidential", "unauthorized", "common development", "business source",
)

_V = r"(?:version|v)"
_GRANT = r"(?:licensed|released|distributed|available|published|provided|made available) under(?: the)?(?: terms of)?(?: the)?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, regex over words, label, priority, confidence) in order of precedence.

    A keyword stands in every text that its regex matches, whichever alternative it takes.
    Priorities: 4 identifiers, 3 full grants and texts, 2 names with a version, 1 bare names.
    """
    out: list[tuple[str, str, str, int, float]] = []
    add = lambda *x: out.append(x)

    # Identifiers after an SPDX tag.
    spdx = {
        "gpl 1 0": "gpl-1.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 0": "lgpl-2.0", "lgpl 2 1": "lgpl-2.1",
        "lgpl 3 0": "lgpl-3.0", "agpl 1 0": "agpl-1.0", "agpl 3 0": "agpl-3.0", "apache 1 0": "apache-1.0",
        "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "mit 0": "mit-0", "mit": "mit", "x11": "x11", "isc": "isc",
        "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause", "0bsd": "0bsd",
        "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0",
        "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2",
        "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "bsl 1 0": "bsl-1.0", "cc0 1 0": "cc0-1.0",
        "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib", "postgresql": "postgresql", "ncsa": "ncsa",
        "python 2 0": "python-2.0", "ofl 1 1": "ofl-1.1", "upl 1 0": "upl-1.0", "ms pl": "ms-pl", "ms rl": "ms-rl",
        "gfdl 1 1": "gfdl-1.1", "gfdl 1 2": "gfdl-1.2", "gfdl 1 3": "gfdl-1.3", "odbl 1 0": "odbl-1.0",
    }
    for words, label in spdx.items():
        add("spdx", rf"spdx license identifier {words}(?: only| or later)?", label, 4, 1.0)

    # Creative Commons: every combination of terms with every version, and the deeds' long names.
    terms = {"by": "cc-by", "by sa": "cc-by-sa", "by nd": "cc-by-nd", "by nc": "cc-by-nc", "by nc sa": "cc-by-nc-sa", "by nc nd": "cc-by-nc-nd"}
    long_names = {
        "attribution": "cc-by", "attribution share ?alike": "cc-by-sa", "attribution no ?derivs": "cc-by-nd",
        "attribution no ?derivatives": "cc-by-nd", "attribution non ?commercial": "cc-by-nc",
        "attribution non ?commercial share ?alike": "cc-by-nc-sa", "attribution non ?commercial no ?derivs": "cc-by-nc-nd",
        "attribution non ?commercial no ?derivatives": "cc-by-nc-nd",
    }
    versions = ("1 0", "2 0", "2 5", "3 0", "4 0")
    for (words, label), version in product(terms.items(), versions):
        number = version.replace(" ", ".")
        add("cc by", rf"{_GRANT} (?:a )?cc {words} {version}", f"{label}-{number}", 3, 0.98)
        add("cc by", rf"cc {words} {version}", f"{label}-{number}", 2, 0.9)
    for (words, label), version in product(long_names.items(), versions):
        add("creative commons", rf"creative commons {words} {version}", f"{label}-{version.replace(' ', '.')}", 2, 0.95)
    for words, label in terms.items():
        add("cc by", rf"cc {words}", label, 1, 0.6)
    for words, label in long_names.items():
        add("creative commons", rf"creative commons {words}", label, 1, 0.7)
    add("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 2, 0.9)
    add("creative commons", r"creative commons zero", "cc0-1.0", 2, 0.9)
    add("creativecommons", r"creativecommons org licenses (?:by|by sa|by nd|by nc|by nc sa|by nc nd) \d \d", "cc-link", 3, 0.9)

    # The GNU family: names, short names and grants with their versions.
    gnu = {
        ("general public license", "gpl"): ("1", "2", "3"),
        ("(?:lesser|library) general public license", "lgpl"): ("2", "2 1", "3"),
        ("affero general public license", "agpl"): ("1", "3"),
        ("free documentation license", "gfdl"): ("1 1", "1 2", "1 3"),
    }
    for (name, label), numbers in gnu.items():
        for number in numbers:
            full = f"{label}-{number.replace(' ', '.')}" + ".0" * (" " not in number)
            tail = rf"{_V} ?{number}(?: 0)?(?! \d)"
            key = "general public" if "general" in name else "free documentation"
            add(key, rf"{_GRANT} gnu {name} {tail}(?: or (?:at your option )?any later version)?", full, 3, 0.98)
            add(key, rf"gnu {name} (?:as published by the free software foundation )?(?:either )?{tail}", full, 2, 0.95)
            add(label, rf"\bgnu {label} ?{_V}? ?{number}\b(?! \d)", full, 2, 0.9)
            add(label, rf"\b{label} ?{_V}? ?{number}\b(?! \d)", full, 2, 0.8)
        add("general public" if "general" in name else "free documentation", rf"(?:gnu )?{name}", label, 1, 0.7)
        add(label, rf"\b{label}\b", label, 1, 0.5)
    add("general public", r"redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license", "gpl", 3, 0.97)
    add("hope that it will be useful", r"in the hope that it will be useful but without any warranty", "gpl", 2, 0.8)

    # Named licenses with versions.
    named = {
        ("apache license", "apache", "apache"): ("1 0", "1 1", "2 0"),
        ("mozilla public license", "mozilla", "mpl"): ("1 0", "1 1", "2 0"),
        ("eclipse public license", "eclipse", "epl"): ("1 0", "2 0"),
        ("common public license", "common public", "cpl"): ("1 0",),
        ("common development and distribution license", "common development", "cddl"): ("1 0", "1 1"),
        ("european union public license", "european union public", "eupl"): ("1 0", "1 1", "1 2"),
        ("artistic license", "artistic", "artistic"): ("1 0", "2 0"),
        ("boost software license", "boost software", "bsl"): ("1 0",),
        ("academic free license", "academic free", "afl"): ("1 1", "1 2", "2 0", "2 1", "3 0"),
        ("open software license", "open software", "osl"): ("1 0", "1 1", "2 0", "2 1", "3 0"),
        ("open font license", "open font", "ofl"): ("1 0", "1 1"),
        ("universal permissive license", "universal permissive", "upl"): ("1 0",),
        ("open database license", "open database", "odbl"): ("1 0",),
        ("python software foundation license", "python software", "psf"): ("2",),
        ("php license", "php license", "php"): ("3 0", "3 01"),
        ("zope public license", "zope public", "zpl"): ("1 1", "2 0", "2 1"),
        ("microsoft public license", "microsoft public", "ms-pl"): (),
        ("microsoft reciprocal license", "microsoft reciprocal", "ms-rl"): (),
        ("business source license", "business source", "busl"): ("1 0", "1 1"),
        ("server side public license", "server side public", "sspl"): ("1",),
        ("elastic license", "elastic license", "elastic"): ("2 0",),
        ("ibm public license", "ibm public", "ipl"): ("1 0",),
        ("sun public license", "sun public", "spl"): ("1 0",),
        ("lucent public license", "lucent public", "lpl"): ("1 0", "1 02"),
        ("apple public source license", "apple public", "apsl"): ("1 0", "1 1", "1 2", "2 0"),
        ("reciprocal public license", "reciprocal public", "rpl"): ("1 1", "1 5"),
    }
    for (name, key, label), numbers in named.items():
        for number in numbers:
            full = f"{label}-{number.replace(' ', '.')}"
            add(key, rf"{_GRANT} {name} {_V}? ?{number}", full, 3, 0.98)
            add(key, rf"{name} {_V}? ?{number}", full, 2, 0.95)
        add(key, rf"{_GRANT} {name}", label, 2, 0.85)
        add(key, rf"{name}", label, 1, 0.7)

    # Permissive texts and names.
    add("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 3, 0.98)
    add("permission to use", r"permission to use copy modify and or distribute this software for any purpose", "isc", 3, 0.98)
    add("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 3, 0.97)
    add("neither the name", r"neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors", "bsd-3-clause", 3, 0.95)
    add("advertising materials", r"all advertising materials mentioning features or use of this software", "bsd-4-clause", 3, 0.95)
    add("provided as is", r"this software is provided as is without any express or implied warranty", "zlib", 3, 0.9)
    add("free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 3, 0.98)
    add("public domain", r"(?:released|dedicated|placed)(?: in| to| into)? the public domain", "public-domain", 2, 0.85)
    add("public domain", r"public domain", "public-domain", 1, 0.5)
    add("what the fuck you want", r"do what the fuck you want to public license", "wtfpl", 3, 0.98)
    for name in ("mit", "isc", "bsd", "x11", "zlib", "libpng", "ncsa", "openssl", "ruby", "vim", "unlicense", "wtfpl", "beerware", "postgresql"):
        add(f"{name} license", rf"{_GRANT} {name} license", name, 2, 0.95)
        add(f"{name} license", rf"{name} license", name, 1, 0.8)
    for n, names in (("2", ("simplified", "freebsd")), ("3", ("new", "modified", "revised")), ("4", ("original", "old"))):
        add("clause", rf"bsd {n} clause(?: license)?", f"bsd-{n}-clause", 2, 0.95)
        add("clause", rf"{n} clause bsd(?: license)?", f"bsd-{n}-clause", 2, 0.95)
        for name in names:
            add("bsd license", rf"{name} bsd license", f"bsd-{n}-clause", 2, 0.85)

    # Statements of rights that are not open.
    add("all rights reserved", r"all rights reserved", "all-rights-reserved", 1, 0.4)
    add("confidential", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 2, 0.8)
    add("unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", "proprietary", 3, 0.95)
    add("commercial license", r"commercial license", "commercial", 1, 0.5)
    add("licensed commercially", r"licensed commercially", "commercial", 1, 0.5)
    return out + SIGNATURES


def words_of(text: Column) -> Column:
    """The words of a text joined by single spaces."""
    # lower() also maps what is beyond ASCII, which is all parts of words anyway
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")))


def word_count(words: Column) -> Column:
    spaces = F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(spaces + 1)


def _places(words: Column, pattern: Column) -> Column:
    """(start, size) in words of the matches of a pattern that begin and end with whole words.

    Matches are marked by characters that no word holds, so one pass over the words finds them all.
    """
    whole = F.concat(F.lit(r"(?<![^ ])(?:"), pattern, F.lit(r")(?![^ ])"))
    none = F.array().cast("array<struct<start:int,size:int>>")

    def located(each: Column) -> Column:
        at = lambda test: F.filter(F.transform(each, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
        first, last = at(lambda w: F.startswith(w, F.lit(OPENS))), at(lambda w: F.endswith(w, F.lit(CLOSES)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size")))

    marked = F.regexp_replace(words, whole, F.lit(f"{OPENS}$0{CLOSES}"))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(OPENS)), let(F.split(m, " "), located)).otherwise(none))


def _literal_rules(some: list[tuple]) -> Column:
    """All rules as one array, which constant folding makes a literal; ``order`` is the place in the list."""
    names = ("keyword", "regex", "label", "priority", "confidence", "order")
    rows = [dict(zip(names, (*r, i))) for i, r in enumerate(some)]
    kind = "array<struct<keyword:string,regex:string,label:string,priority:int,confidence:double,order:int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def detections(words: Column, rule_list: list[tuple] | None = None) -> Column:
    """All matches of all rules: array of (start, end, priority, order, label, confidence), end exclusive."""
    some = rule_list or rules()
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(r[0] for r in some)])
    found = F.filter(keywords, lambda k: F.contains(words, k))
    run = let(found, lambda ks: F.filter(_literal_rules(some), lambda r: F.array_contains(ks, r["keyword"])))

    def of_rule(r: Column) -> Column:
        return F.transform(
            _places(words, r["regex"]),
            lambda p: F.struct(
                p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), r["priority"].alias("priority"),
                r["order"].alias("order"), r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        )

    return F.flatten(F.transform(run, of_rule))


LEVELS = 4


def suppress(found: Column) -> Column:
    """Detections that no earlier one of the same or a higher priority contains."""
    key = lambda d: F.struct(d["start"], -d["end"], -d["priority"], d["order"], d.alias("d"))
    ordered = F.transform(F.array_sort(F.transform(found, key)), lambda k: k["d"])
    # reach[p-1]: the furthest end so far of a detection of priority p or more; kept: 1 for each that stays, 0 for each that goes
    zero = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("reach"), F.lit("").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        hidden = F.get(acc["reach"], d["priority"] - 1) >= d["end"]
        reach = F.transform(acc["reach"], lambda e, p: F.when(d["priority"] > p, F.greatest(e, d["end"])).otherwise(e))
        return F.struct(reach.alias("reach"), F.concat(acc["kept"], F.when(hidden, "0").otherwise("1")).alias("kept"))

    def stay(sorted_: Column) -> Column:
        marks = F.aggregate(sorted_, zero, step, lambda acc: F.split(acc["kept"], ""))
        return let(marks, lambda m: F.filter(sorted_, lambda d, i: F.get(m, i) == "1"))

    return let(ordered, stay)


def scan(docs: DataFrame, rule_list: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, base (phrase, starts), detections kept after suppression."""
    some = rule_list or rules()
    stems = dict.fromkeys(next((x for x in STEMS if x in k), k) for k in [*BASE, *(r[0] for r in some)])
    gate = functools.reduce(operator.or_, [F.contains("_w", F.lit(x)) for x in stems])
    nothing = F.array().cast("array<struct<start:int,label:string>>")

    def labelled(phrase: str, label: str) -> Column:
        places = _places(F.col("_w"), F.lit(phrase))
        here = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))
        return F.when(F.contains("_w", F.lit(phrase)), here).otherwise(nothing)

    base = F.flatten(F.array(*[labelled(*x) for x in BASE.items()]))
    kept = suppress(detections(F.col("_w"), some))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_w"))
    return rows.select(
        "doc_id",
        word_count(F.col("_w")).cast("bigint").alias("n_words"),
        F.when(gate, base).otherwise(nothing).alias("base"),
        F.when(gate, kept)
        .otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,order:int,label:string,confidence:double>>"))
        .alias("detections"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: license phrases and labels of every document."""
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.transform("base", lambda b: b["label"])
    more = F.transform("detections", lambda d: d["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
