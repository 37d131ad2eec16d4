"""Mended and shaped answers: literal cases, every cut, random damage."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import schema as S
from lexmill.plans.answers import SHAPE
from lexmill.sources.repair import heal, healed

LITERAL = [
    ('{"title":"t","v":[{"w":"parallel","q":"Paralleling their passion...", (Note: \'P\' is "x y" form. We\'ll),"e":"z."}]}', {"title": "t", "v": [{"w": "parallel", "q": "Paralleling their passion...", "e": "z."}]}),
    ('{"a":"v", (Note: x, y), "b":2}', {"a": "v", "b": 2}),
    ('{"a":"v", (Note: (gerund) vs (adjective) call), "b":2}', {"a": "v", "b": 2}),
    ('{"a":"v", (Note: stray)\n"b":2}', {"a": "v", "b": 2}),
    ('{"v":[{"q":"their ships burned" and "watched them go up","e":"x"}]}', {"v": [{"q": 'their ships burned" and "watched them go up', "e": "x"}]}),
    ('{"def":"He said "hi" to her."}', {"def": 'He said "hi" to her.'}),
    ('{"v":[{"q":"a" and "b","e":"The two."}]}', {"v": [{"q": 'a" and "b', "e": "The two."}]}),
    ("[1, 2, ]", [1, 2]),
    ('{"a":1\n "b":2}', {"a": 1, "b": 2}),
    ('{"a":"x"\n "b":"y"}', {"a": "x", "b": "y"}),
    ('[{"a":1}\n{"b":2}]', [{"a": 1}, {"b": 2}]),
    ('{"a":[1,2}', {"a": [1, 2]}),
    ('{"x":[{"l":"h"},\n "concepts":["c"]}]}', {"x": [{"l": "h", "concepts": ["c"]}]}),
    ('{"a":1}, "b":2}', {"a": 1, "b": 2}),
    ('<think>{"a":2}</think>Here: {"a":1} bye', {"a": 1}),
    ('{"a": tru', {"a": True}),
    ('{"a": 1.', {"a": 1}),
    ('{"a"', {"a": None}),
    ('{"a":', {"a": None}),
    ("nothing", {}),
    ("", {}),
    ("{a: True, b: None, c: word}", {"a": True, "b": None, "c": "word"}),
    ('{"a":"x\ny\tz\x01"}', {"a": "x\ny\tz\x01"}),
    ('{"a":"b\\u12', {"a": "b"}),
    ('{"a":"b\\q"}', {"a": "b\\q"}),
]


@pytest.mark.parametrize(("broken", "want"), LITERAL)
def test_literal(broken, want):
    assert json.loads(healed(broken)) == want


def test_cuts_and_damage():
    """Whatever is cut or damaged, the outcome parses; what is whole stays byte for byte; a cut keeps all whole elements."""
    rng = random.Random(1)
    doc = {"vocabulary": [{"word": f"w{i}", "q": 'He said "hi", then left (quickly) [x] {y}.\n\\ é\U0001f600', "n": -1.5e3, "ok": True, "none": None, "l": [[], {}, [1, {"z": "("}]]} for i in range(3)], "title": "a:b,c"}
    for text in (json.dumps(doc), json.dumps(doc, indent=2, ensure_ascii=False)):
        assert healed(text) == text
        for k in range(len(text)):
            got = json.loads(healed(text[:k]))
            whole = text[:k].count('"l":' if "\n" not in text else '"l": ')
            if isinstance(got, dict) and got.get("vocabulary"):
                assert got["vocabulary"][: max(0, whole - 1)] == doc["vocabulary"][: max(0, whole - 1)]
        for _ in range(2000):
            a = list(text)
            for _ in range(rng.randint(1, 4)):
                p = rng.randrange(len(a))
                a[p : p + rng.randint(0, 1)] = rng.choice(['"', "{", "}", "[", "]", ":", ",", "(", ")", "\\", "\x00", "a", "1", ""])
            json.loads(healed("".join(a)))
    for deep in ("[" * 20_000, '{"a":[' * 3000 + '"', '"' * 5000 + "{" + '"' * 5000):
        assert healed(deep)


def test_cut_within_later_keys():
    """Wherever an answer is cut, its strings hold the beginning of theirs, also if the cut is in a key or string behind a comma."""
    doc = {"role": "user", "text": 'He said "hi", "so",\n"x": y, (z).', "more": {"n": 1, "l": ["user", "us,er"]}}
    for text in (json.dumps(doc), json.dumps(doc, separators=(",", ":")), json.dumps(doc, indent=2)):
        for k in range(len(text)):
            got = json.loads(healed(text[:k]))
            for name in ("role", "text"):
                assert doc[name].startswith(got.get(name) or ""), (text[:k], got)
            for x, y in zip((got.get("more") or {}).get("l") or [], doc["more"]["l"], strict=False):
                assert y.startswith(x), (text[:k], got)


def test_heal_column(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, '{"a":[1'), (4, '{"a": 1}')], "id int, t string")
    assert {r.id: r.h for r in rows.select("id", heal("t").alias("h")).collect()} == {1: None, 2: "{}", 3: '{"a":[1]}', 4: '{"a": 1}'}
    assert rows.limit(0).select(heal("t")).count() == 0


def test_enum_words(spark):
    allowed = ("noun", "verb", "phrasal verb", "adjective", "set phrase")
    want = {
        "noun": "noun", " Verb. ": "verb", "ADJECTIVE": "adjective", "adjective/noun": "adjective", "foo / verbs": "verb", "verb (phrasal)": "verb", "phrasal_verb": "phrasal verb", "Set-Phrase": "set phrase",
        "phrasal verbs": "phrasal verb", "adj": "adjective", "a proper noun": "noun", "zzz": "noun", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "w string")
    assert {r.w: r.e for r in rows.select("w", S.enum_word(F.col("w"), allowed).alias("e")).collect()} == want


def test_shapes(spark):
    rows = {
        '{"role":"user","text":"x","n":3,"done":true,"words":[{"w":"a","at":1}]}': (("user", "x", 3, True, [("a", 1)]), []),
        '{"data":{"role":"Users","n":"7","words":{"w":"a"},"more":[]}}': (("user", "", 7, False, []), ["$.done missing", "$.more dropped", "$.n converted", "$.role converted", "$.text missing", "$.words converted"]),
        '{"role":null,"text":12,"n":"x","done":"maybe","words":[1,[],{"w":2,"z":0},{}]}': (("", "12", 0, False, [("2", 0), ("", 0)]), ["$.done converted", "$.n converted", "$.role missing", "$.text converted", "$.words[] dropped", "$.words[].at missing", "$.words[].w converted", "$.words[].w missing", "$.words[].z dropped"]),
        "[]": (("", "", 0, False, []), ["$ converted"]),
        "not json": (("", "", 0, False, []), ["$ missing"]),
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string").withColumn("v", S.unwrapped(SHAPE, F.try_parse_json("t")))
    got = {r.t: (tuple(r.s[:4]) + ([tuple(x) for x in r.s[4]],), r.c) for r in df.select("t", S.shaped(SHAPE, F.col("v")).alias("s"), S.changes(SHAPE, F.col("v")).alias("c")).collect()}
    assert got == rows
    assert df.select(S.shaped(SHAPE, F.col("v"))).schema.fields[0].dataType.simpleString().replace("`", "") == S.sql_type(SHAPE).replace("`", "").replace(": ", ":").replace(", ", ",")
