"""Verified items against a plain version over all documents, and literal cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexmill.functions.text import clean_core
from lexmill.operators import discourse, verification
from lexmill.plans.registry import table
from lexmill.plans.verification import extracted

from .oracle import SF

SOURCE = "The prime minister took his solemn, secular oath before parliament. He dedicated his entire life to public service. They went home effectively."


def tables(spark, rows, text=SOURCE):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, i, w, q) for i, (w, q) in enumerate(rows)], "doc_id long, item int, word string, quote string")
    families = spark.createDataFrame([("oath", "oath"), ("oaths", "oath"), ("dedicated", "dedicate"), ("dedication", "dedicate")], "w string, family string")
    lemmas = spark.createDataFrame([("dedicated", "dedicate"), ("took", "take")], "w string, lemma string")
    return verification.verify(items, docs, discourse.sentence_pool(docs, sep="\n"), families, lemmas)


def test_literal(spark):
    first, second = SOURCE.split(". ")[0] + ".", SOURCE.split(". ")[1] + "."
    rows = [
        ("secular", "The prime minister took his solemn, **secular** oath before parliament."),
        ("dedicated", first),
        ("dedication", second),
        ("oaths", "[S-1]"),
        ("oath", first),
        ("oppressed", second),
        ("glaive", "Not present in text, but inferred."),
        (None, None),
        ("", ""),
        ("go", "They went home effectively."),
        ("effective", "took his solemn, secular oath before ..."),
        ("took", first),
    ]
    got = {r.item: (r.headword, r.final_quote, r.mended, r.kept, r.reason) for r in tables(spark, rows).collect()}
    assert len(got) == len(rows)
    assert got[0][3] and got[0][1] == first and got[0][2] == "snapped"
    assert got[1] == ("dedicate", second, "swapped", True, None)
    assert got[2][4] == "same family" and got[3][:4] == ("oaths", first, "snapped", True) and got[4][4] == "same family"
    assert got[5][4] == "invented" and got[6][4] == "invented" and got[7][4] == got[8][4] == "empty"
    assert got[9][3] and got[10][3] and got[10][1] == "They went home effectively." and got[11][0] == "take"
    assert tables(spark, [("x", "y")], None).first().reason == "invented"
    assert tables(spark, []).count() == 0


def plain(items, source, sents, core, forms, family):
    """The steps one after another, item by item."""
    seen_words, seen_kin, out = set(), set(), {}
    for item, word, quote in sorted(items):
        clean = core(re.sub(r"\[.*?\]|\(.*?\)", " ", word))
        toks = [t for t in clean.split(" ") if t and t not in verification.STOPS]
        inn = lambda t, text: bool(set(text.split(" ")) & forms[t]) or (not (len(t) >= 5 and t.endswith("ly")) and t[:4] in text)
        n = lambda text: sum(inn(t, text) for t in toks)
        need = max(1, -(-len(toks) // 2))
        m = re.search(r"(?i)\bS-(\d+)\b", quote)
        raw = re.sub(r"(?i)^\s*\[?\bS-\d+\b\]?\s*", "", quote.strip()).strip()
        part = re.sub(r"\.{3,}|…", "", raw.lower()).strip()
        words = set(re.findall(r"\w{3,}", part))
        q = next((s for k, s in sents if m and int(m[1]) == k), None) or next((s for _, s in sents if s.lower() == raw.lower()), None) or next((s for _, s in sents if len(part) >= 15 and part in s.lower()), None)
        if q is None and words:
            scored = [(len(words & set(re.findall(r"\w{3,}", s.lower()))) / len(words), -k, s) for k, s in sents]
            best = max(scored, default=(0, 0, None))
            q = best[2] if best[0] >= 0.75 else None
        q = raw if q is None else q
        if toks and n(core(q)) < need and n(source) == len(toks):
            fit = [(len(s), k, s) for k, s in sents if n(core(s)) == len(toks)]
            q = min(fit)[2] if fit else q
        kin = family.get(clean, clean)
        if kin in seen_kin:
            out[item] = "repeated" if clean in seen_words else "same family"
            seen_words.add(clean)
            continue
        seen_kin.add(kin)
        seen_words.add(clean)
        c = core(q)
        here, there = (n(c) >= need, n(source) >= need) if toks else (clean in c, clean in source)
        g = lambda s: [tuple(s[i : i + 3]) for i in range(len(s) - 2)]
        cw, sw = [x for x in c.split(" ") if x], [x for x in source.split(" ") if x]
        cover = len(set(g(cw)) & set(g(sw))) / max(1, len(set(g(cw)))) if len(cw) >= 3 else 1.0 if c in source else sum(x in sw for x in cw) / max(1, len(cw))
        out[item] = "invented" if not here and not there else "unmatched" if not here and c and c not in source and cover < 0.85 else None
    return out


def test_equals_plain_version(spark):
    docs = table(spark, SF, "documents").where("doc_id < 60").select("doc_id", "text")
    pool = discourse.sentence_pool(docs, sep="\n")
    items = extracted(pool)
    none = spark.createDataFrame([], "w string, family string")
    got = {(r.doc_id, r.item): r.reason for r in verification.verify(items, docs, pool, none, none.withColumnRenamed("family", "lemma")).collect()}
    cores = {r.text: r.c for r in pool.select("text").union(docs.select("text")).union(items.select("word")).union(items.select("quote")).distinct().select("text", clean_core(F.col("text")).alias("c")).collect()}
    forms = {r.w: set(r.f) for r in items.select(F.explode(F.split(clean_core(F.col("word")), " ")).alias("w")).distinct().select("w", verification.forms_of(F.col("w")).alias("f")).collect()}
    core = lambda s: cores[s] if s in cores else spark.createDataFrame([(s,)], "t string").select(clean_core(F.col("t"))).first()[0]
    by, sents, texts = {}, {}, {r.doc_id: cores[r.text] for r in docs.collect()}
    for r in pool.collect():
        sents.setdefault(r.doc_id, []).append((r.sid, r.text))
    for r in items.collect():
        by.setdefault(r.doc_id, []).append((r.item, r.word, r.quote))
    want = {(d, i): why for d, rows in by.items() for i, why in plain(rows, texts[d], sorted(sents[d]), core, forms, {}).items()}
    assert got == want and len(set(got.values())) >= 3
