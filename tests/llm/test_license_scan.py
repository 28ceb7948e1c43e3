import re
import time

from pyspark.sql import functions as F

from tilewright.llm import license_scan as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = []
    for phrase, label in m.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    joined, found = " ".join(w), []
    for order, (key, regex, label, priority, confidence) in enumerate(m.rules()):
        if key in joined:
            for x in re.finditer(rf"(?<![^ ])(?:{regex})(?![^ ])", joined):
                found.append((joined.count(" ", 0, x.start()), joined.count(" ", 0, x.end()) + 1, priority, order, label, confidence))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = [d for i, d in enumerate(found) if not any(e[1] >= d[1] and e[2] >= d[2] for e in found[:i])]
    return {
        "n_words": len(w), "n_base": len(places),
        "first_word": min((p[0] for p in places), default=None), "last_word": max((p[0] for p in places), default=None),
        "base_labels": ",".join(sorted({p[1] for p in places})),
        "labels": ",".join(sorted({p[1] for p in places} | {d[4] for d in kept})),
        "score": max((d[5] for d in kept), default=0.0),
    }


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = m.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: r[k] for k in brute("")} == brute(texts[r["doc_id"]]), r["doc_id"]


def test_rules_and_edge_cases(spark, tmp_path):
    long = "mit license " * 3000
    texts = [
        None, "", "MIT License", "mit licenses", "x\nMIT\n * License mit-license", "Licensed under CC BY-NC 4.0.",
        "cc by cc by CC BY-SA 3.0 ccc by", "GNU  General\nPublic License, version 3. gnu general public license",
        "SPDX-License-Identifier: Apache-2.0 OR MIT", "K İ ſ é ÉÀ gpl v2 K", long,
        "licensed under the terms of the GNU Lesser General Public License version 2.1", "bsd 3-clause license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    rows = [(i, t, t and "x", 1.0) for i, t in enumerate(texts)] + [(2, "MIT License", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _w string, base double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = m.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: r[k] for k in brute("")} == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert {r["doc_id"]: r["labels"] for r in got}[5] == "cc-by,cc-by-nc-4.0"


def examples(regex):
    """A text for each choice of alternatives and optional parts of a regex."""
    from re import _constants as k, _parser

    def made(parts):
        out = [""]
        for op, arg in parts:
            if op is k.LITERAL:
                some = [chr(arg)]
            elif op is k.ANY:
                some = ["x"]
            elif op is k.IN:
                some = ["7"]
            elif op in (k.AT, k.ASSERT_NOT):
                some = [""]
            elif op is k.SUBPATTERN:
                some = made(arg[-1])
            elif op is k.BRANCH:
                some = [x for b in arg[1] for x in made(b)]
            else:
                assert op in (k.MAX_REPEAT, k.MIN_REPEAT), op
                some = ([""] if arg[0] == 0 else []) + made(arg[2])
            out = [a + b for a in out for b in some]
        return out

    return made(_parser.parse(regex))


def test_gates_lose_nothing(spark):
    rules = m.rules()
    texts = []
    for key, regex, *_ in rules:
        some = examples(regex.replace(m._GRANT, "licensed under"))
        assert all(key in x and re.fullmatch(regex, x) for x in some), (key, regex)
        texts += some
    for key, regex, label, *_ in rules[-40:] + [r for r in rules if "redistribute" in r[1]]:
        texts += [f"it may be {x} today" for x in examples(regex.replace(m._GRANT, "licensed under"))]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "doc_id long, text string").repartition(8).cache()
    gated, free = (sorted(m.scan(df, r).select("doc_id", "detections").collect()) for r in (rules, [("", *r[1:]) for r in rules]))
    assert gated == free and all(r["detections"] for r in gated)


def test_wordings_without_the_usual_keywords(spark):
    holders = ", ".join(f"the University of Place {i}" for i in range(40))
    end = "nor the names of its contributors"
    texts = [
        "It may be licensed commercially.",
        "redistribute it and/or modify it under the terms of the GNU General Public License",
        f"Neither the name of {holders} {end} may be used",
        "Neither the name of A may be used. MIT License. " + "word " * 300_000 + f"Neither the name of B {end} may be used",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(d["label"], d["end"] - d["start"], d["confidence"]) for d in r["detections"]] for r in m.scan(df).collect()}
    assert got[0] == [("commercial", 2, 0.5)]
    assert got[1] == [("gpl", 15, 0.97)]
    assert got[2] == [("bsd-3-clause", 4 + 5 * 40 + 6, 0.95)]
    assert [x[:2] for x in got[3]] == [("mit", 2), ("bsd-3-clause", 11)]


def test_empty_table(spark):
    assert m.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contained_detections_are_suppressed(spark):
    d = lambda *x: dict(zip(("start", "end", "priority", "order", "label", "confidence"), x))
    found = [d(0, 4, 1, 0, "a", 0.1), d(1, 3, 2, 1, "b", 0.2), d(1, 3, 1, 2, "c", 0.3), d(0, 4, 1, 3, "d", 0.4), d(3, 6, 1, 4, "e", 0.5)]
    kind = "array<struct<start:int,end:int,priority:int,order:int,label:string,confidence:double>>"
    df = spark.createDataFrame([(found,)], f"f {kind}").select(m.suppress(F.col("f")).alias("k"))
    assert [x["label"] for x in df.first()["k"]] == ["a", "b", "e"]


def test_native():
    source = open(m.__file__).read()
    assert "pandas" not in source and "udf" not in source and "mapIn" not in source


def test_many_detections_take_time_in_proportion(spark):
    took = []
    for n in (2000, 20_000):
        df = spark.createDataFrame([(1, "mit license " * n)], "doc_id long, text string")
        began = time.perf_counter()
        r = m.scan(df).select(F.size("base").alias("b"), F.size("detections").alias("d")).first()
        took.append(time.perf_counter() - began)
        assert (r["b"], r["d"]) == (n, n)
    assert took[1] < 15
