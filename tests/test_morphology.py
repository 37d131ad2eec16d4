"""Literal cases of word forms, lemmas, families and collisions; nulls, cycles and repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmill.functions import forms as V
from lexmill.operators import collisions as C
from lexmill.operators import morphology as M
from lexmill.operators.iterate import components


def test_verb_forms(spark):
    want = {
        "go": "went gone going goes", "break": "broke broken breaking breaks", "prefer": "preferred preferred preferring prefers", "admit": "admitted admitted admitting admits", "embed": "embedded embedded embedding embeds",
        "overtake": "overtook overtaken overtaking overtakes", "withdraw": "withdrew withdrawn withdrawing withdraws", "rebuild": "rebuilt rebuilt rebuilding rebuilds", "led": "led led leading leads", "taken": "took taken taking takes",
        "be": "was been being is", "found": "found found finding finds", "die": "died died dying dies", "agree": "agreed agreed agreeing agrees", "stop": "stopped stopped stopping stops", "visit": "visited visited visiting visits",
        "carry": "carried carried carrying carries", "box": "boxed boxed boxing boxes", "echo": "echoed echoed echoing echoes", "spread": "spread spread spreading spreads", "rain": "rained rained raining rains",
    }
    want["found"] = "founded founded founding founds"  # a base of its own
    rows = spark.createDataFrame([(k,) for k in want], "w string")
    assert {r.w: " ".join(r.f) for r in rows.select("w", V.verb_forms(F.col("w")).alias("f")).collect()} == want
    tags = spark.createDataFrame([("went", "VB"), ("go", "vbd"), ("go", "XX"), ("", "VBD"), (None, "VBD")], "w string, t string")
    assert [r.f for r in tags.select(V.verb_form(F.col("w"), F.col("t")).alias("f")).collect()] == ["go", "went", None, None, None]


def test_inflected_forms(spark):
    want = {"big": {"big", "bigger", "biggest", "bigs", "bigged", "bigging"}, "the": {"the"}, "good": {"good", "better", "best", "goods", "gooded", "gooding", "gooder", "goodest"}, None: set(), "": set()}
    got = {r.w: set(r.f) for r in spark.createDataFrame([(k,) for k in want], "w string").select("w", V.inflected_forms(F.col("w")).alias("f")).collect()}
    assert got["big"] == want["big"] and got["the"] == {"the"} and {"better", "best"} <= got["good"] and got[None] == got[""] == set()


def test_lemmas(spark):
    levels = {"go": 1.0, "walk": 1.2, "walked": 2.0, "news": 1.0, "new": 1.1, "string": 3.0, "happy": 1.0, "similarity": 4.0, "dissimilarity": 3.5, "performing": 3.0, "study": 1.5, "studies": 1.4, "her": 1.0, "hers": 2.0, "led": 5.0, "lead": 2.0, "box": 2.0, "boxes": 2.0}
    lv = spark.createDataFrame(list(levels.items()), "word string, level double")
    words = ["went", "walked", "news", "string", "dissimilarity", "underperforming", "studies", "hers", "led", "boxes", "Walked ", "zzz", "", None]
    got = {r.w: (r.lemma, r.level and round(r.level, 2)) for r in M.lemmas(spark.createDataFrame([(w,) for w in words], "w string"), lv).collect()}
    assert got == {
        "went": ("go", 1.0), "walked": ("walk", 1.2), "news": ("new", 1.1), "string": ("string", 3.0), "dissimilarity": ("dissimilarity", 5.3), "underperforming": ("underperforming", 4.0), "studies": ("study", 1.5), "hers": ("her", 1.0),
        "led": ("lead", 2.0), "boxes": ("box", 2.0), "zzz": ("zzz", None),
    }


def test_families(spark):
    words = ["walk", "walked", "solve", "solved", "unsolved", "solution", "colour", "color", "colourful", "happy", "unhappy", "nation", "nations", "national", "alone"]
    w = spark.createDataFrame([(x,) for x in words], "w string")
    lv = w.select(F.col("w").alias("word"), F.lit(2.0).alias("level"))
    lemma = M.lemmas(w, lv)
    fam = {r.w: r.family for r in M.word_families(w, lemma).collect()}
    root = {r.w: r.family for r in M.word_families(w, lemma, prefixes=True).collect()}
    assert fam["walked"] == fam["walk"] and fam["nations"] == fam["nation"] == fam["national"] == "nation" and fam["colour"] == fam["color"] == fam["colourful"] == "color"
    assert fam["unsolved"] == "unsolved" and root["unsolved"] == root["solve"] == root["solved"] and root["unhappy"] == "happy" and fam["alone"] == "alone" and set(fam) == set(words)


@pytest.mark.parametrize("n", [2, 40])
def test_components(spark, n):
    """A chain, a ring, a pair with itself, repeats, an unknown node and nulls."""
    nodes = spark.createDataFrame([(f"c{i:03}",) for i in range(n)] + [(f"r{i}",) for i in range(5)] + [("x",), ("x",), (None,)], "node string")
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(n - 1)] + [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] * 2 + [("x", "x"), ("x", "gone"), (None, "x")]
    got = {r.node: r.root for r in components(nodes, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"c{i:03}": "c000" for i in range(n)} | {f"r{i}": "r0" for i in range(5)} | {"x": "x"}
    assert components(nodes.limit(0), spark.createDataFrame([], "a string, b string")).count() == 0


def test_collisions(spark):
    w = spark.createDataFrame([(x,) for x in ("care", "cares", "worry", "insight", "overview", "colour", "color", "summary", "herd", None)], "w string")
    family = spark.createDataFrame([("care", "care"), ("cares", "care"), ("worry", "worry")], "w string, family string")
    near = spark.createDataFrame([("care", "worry"), ("insight", "overview"), ("overview", "summary"), ("overview", "summary"), ("herd", "gone")], "a string, b string")
    preps = spark.createDataFrame([("care", "about"), ("care", "for"), ("worry", "about"), ("insight", "into"), ("overview", "of"), ("summary", "of"), ("herd", "of")], "w string, prep string")
    partners = spark.createDataFrame([("insight", "deep"), ("overview", "deep")], "w string, partner string")
    others = spark.createDataFrame([("herd", "summary"), ("herd", "care"), ("overview", "summary")], "a string, b string")
    got = {(r.target, r.candidate): (r.hit, r.kind) for r in C.collisions(w, family, near, preps, partners, others).collect()}
    one = {
        ("care", "cares"): (True, "double_key_family"), ("color", "colour"): (True, "double_key_family"), ("care", "worry"): (True, "double_key_prep"), ("insight", "overview"): (True, "double_key_collocation"),
        ("overview", "summary"): (True, "double_key_prep"), ("herd", "summary"): (False, "frame_only"), ("care", "herd"): (False, "none"), ("care about", "care for"): (True, "double_key_prep"),
        ("care about", "worry about"): (True, "double_key_prep"), ("overview of", "summary of"): (True, "double_key_prep"),
    }
    assert got == one | {(b, a): v for (a, b), v in one.items()}
