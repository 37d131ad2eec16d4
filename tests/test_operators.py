"""Literal cases of functions and operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import similarity, text
from lexmill.operators import candidates, discourse, examples, graph, quotes, sense, tickets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_timestamps(spark):
    assert one(spark, text.timestamp_seconds(F.lit("[01:02.50]"))) == 62.5
    assert one(spark, text.timestamp_seconds(F.lit("nothing"))) == 0.0
    assert one(spark, text.timestamp_seconds(text.format_timestamp(F.lit(3725.25)))) == 3725.25


def test_names(spark):
    assert one(spark, text.is_remote(F.lit("https://a.org/x"))) is True
    assert one(spark, text.is_remote(F.lit("a/b.txt"))) is False
    assert one(spark, text.video_id(F.lit("https://www.youtube.com/watch?v=abcdefghijk&t=1"))) == "abcdefghijk"


def test_links_and_edges(spark):
    docs = spark.createDataFrame([("a", "see [[B]] and [[ c |label]] and [[b]] [[A]]"), ("b", None), ("c", "")], "doc_id string, text string")
    found = graph.links(docs, "text")
    assert [(r.doc_id, r.n, r.target) for r in found.orderBy("n").collect()] == [("a", 0, "B"), ("a", 1, "c"), ("a", 2, "b"), ("a", 3, "A")]
    nodes = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("b2", "b", 3), ("c", "C", 4)], "id string, label string, ord int")
    e = graph.edges(found.select(F.col("doc_id").alias("source"), "target"), nodes)
    assert {tuple(r) for r in e.collect()} == {("a", "b"), ("a", "c")}
    assert {tuple(r) for r in graph.degrees(e).collect()} == {("a", 2, 0), ("b", 0, 1), ("c", 0, 1)}
    bad = graph.broken_links(found, spark.createDataFrame([("B",), ("c",), ("A",)], "name string"))
    assert [r.target for r in bad.collect()] == ["b"]


def test_inventory_and_orphans(spark):
    files = spark.createDataFrame([("wiki/u/sources/x.md",), ("wiki/u/x_vocabulary.md",)], "path string")
    got = {tuple(r) for r in graph.inventory(files).collect()}
    assert got == {("wiki/u/sources/x.md", "source", "wiki/u/sources/x.md"), ("x", "source", "wiki/u/sources/x.md"), ("x_vocabulary", "wiki_vocabulary", "wiki/u/x_vocabulary.md")}
    compiled = spark.createDataFrame([("p1", "x.md"), ("p2", "gone.md")], "path string, source string")
    assert [r.path for r in graph.orphans(compiled, spark.createDataFrame([("x.md",)], "name string")).collect()] == ["p2"]


def test_route(spark):
    q = spark.createDataFrame([(1, "the vocabulary of unit 12 rosetta")], "q_id int, question string")
    names = spark.createDataFrame([("rosetta_12_vocabulary", "wiki_vocabulary"), ("rosetta", "source")], "name string, type string")
    got = graph.route(q, names).collect()
    assert [r.name for r in got] == ["rosetta_12_vocabulary"] and got[0].score == 45


def test_choose_blanks():
    body = ["Opening words which stay.", "Although it rained, they made use of several tools that he is able to use.", "However, more than half of them would keep on walking themselves.", "Closing words which stay."]
    got = discourse.choose_blanks(body, 10)
    assert all(2 <= g[0] <= 3 for g in got)
    assert got == sorted(got) and len({g[2] for g in got}) == len(got)
    at = [g[1] for g in got]
    assert all(b - a >= 5 for a, b in zip(at, at[1:], strict=False))
    assert (got[0][2], got[0][3], got[0][4]) == ("although", "subordinating_conjunction", 1)
    assert discourse.choose_blanks(["If only one sentence is there."], 3)[0][2] == "if"
    assert discourse.choose_blanks([], 3) == []


def test_blank_categories():
    cases = {("on", ""): "bound_preposition", ("away", ""): "phrasal_particle", ("used", "to"): "modal_structure", ("used", "it"): None, ("so", "that"): None, ("so", "good"): "degree_operator", ("than", ""): "comparative_operator", ("their", ""): "anaphoric_determiner"}
    assert {k: discourse.blank_category(*k) for k in cases} == cases


def test_cloze_blanks_of_documents(spark):
    text = "\n\n".join("Opening words are here. They would rather wait until somebody pays for each of the meals. Nobody left." for _ in range(3))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = discourse.cloze_blanks(docs).collect()
    assert got and {r.doc_id for r in got} == {1} and [r.blank for r in got] == list(range(1, len(got) + 1))
    assert discourse.cloze_blanks(docs.limit(0)).count() == 0


def test_contained_quotes(spark):
    q = spark.createDataFrame([(1, "two words"), (2, "cat sat on the mat"), (3, None), (4, ""), (5, "two words")], "item_id long, quote string")
    d = spark.createDataFrame([(1, "here are two words in it"), (2, "a bobcat sat on the matter"), (3, None), (4, "nothing")], "doc_id long, text string")
    want = {(1, 1), (5, 1), (2, 2), (4, 1), (4, 2), (4, 4)}
    assert {tuple(r) for r in quotes.contained(d, q).collect()} == want
    assert {tuple(r) for r in quotes.contained(d, q, most=5).collect()} == want  # several automata
    assert quotes.contained(d.limit(0), q).count() == 0 and quotes.contained(d, q.limit(0)).count() == 0


def test_cue_peers_both_ways(spark):
    """Lists of the first hosts of each set of cues give what pairing by cue gives."""
    import random

    rng = random.Random(3)
    rows = [(f"h{i}", c, 0, w) for i in range(150) for c, w in zip(rng.sample("abcdef", 4), (30, 25, 20, 15), strict=True)] + [("two words", "a", 0, 30), ("two words", "b", 0, 30), ("h1", "z", 1, 15)]
    cue = spark.createDataFrame(rows, "host_word string, cue_word string, sense_idx int, weight int")
    a, b = (sorted(map(tuple, sense.cue_peers(cue, limit=7, few=f).collect())) for f in (8, 0))
    assert a == b and len(a) > 900


def test_pool_walk(spark):
    """Against a walk word by word."""
    import zlib

    words = [(f"b{i % 2}", f"word{i:02d}") for i in range(23)]
    pool = spark.createDataFrame(words, "bucket string, word string")
    targets = spark.createDataFrame([("word03", "b1"), ("word04", "b0"), ("else", "b1"), ("gone", "b9")], "target string, bucket string")
    want = set()
    for t, b in (("word03", "b1"), ("word04", "b0"), ("else", "b1")):
        own = sorted(w for x, w in words if x == b)
        at, step, seen = zlib.crc32(t.encode()) % len(own), candidates.step_of(len(own)), []
        while len(seen) < 3:
            if own[at] != t:
                seen.append(own[at])
            at = (at + step) % len(own)
        want |= {(t, w, n + 1) for n, w in enumerate(seen)}
    assert {tuple(r) for r in candidates.pool_walk(targets, pool).collect()} == want


def broken_quotes(spark):
    """Flags of one quiz that quote a line with its line break, behind a closing dot or not."""
    quote = "Atin and. Stnd.\n"
    flags = spark.createDataFrame([(1, 1, f"❌ Explanation anchor not grounded near '{quote}'"), (1, 2, f"❌ Explanation anchor not grounded near '{quote.strip()}'")], "quiz_id long, n int, flag string")
    items = spark.createDataFrame([(1, [(["x"], ["Other."]), (["y"], [f"{quote}More of it."])])], "quiz_id long, items array<struct<names: array<string>, contents: array<string>>>")
    return flags, items


def test_tickets_of_quotes_with_line_breaks(spark):
    """A quote that ends in a line break is looked for as it stands: its dot before the break isn't a closing one."""
    got = tickets.repair_tickets(*broken_quotes(spark)).collect()
    assert sorted((r.ticket, r.field) for r in got) == [(1, "items[1].explanation"), (2, "items[1].explanation")]


def test_mandates_of_quotes_with_line_breaks(spark):
    flags, items = broken_quotes(spark)
    got = tickets.mandates(tickets.repair_tickets(flags.where("n = 1"), items)).collect()
    assert [(r.quiz_id, r.fields) for r in got] == [(1, "items[1].explanation")]


def test_nearest_by_prefix(spark):
    """Against all pairs; a crowded prefix makes no more rows than are asked for of each target."""
    import random

    rng = random.Random(7)
    words = sorted({"the" + "".join(rng.choices("aes", k=rng.randint(0, 6))) for _ in range(300)} | {"thaw", "abc"})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = candidates.nearest_by_prefix(w.select(F.col("word").alias("target")), w, 3, 4).collect()
    best = {a: sorted((abs(len(a) - len(b)), b) for b in words if b[:3] == a[:3])[:4] for a in words}
    assert sorted((r.target, r.ord, r.word) for r in got) == sorted((a, n, b) for a in words for n, b in best[a])


def test_pair_distances(spark):
    """Long words, words beyond ASCII and words that are the beginning of others, against the expressions pair by pair."""
    words = ["theabcdeé", "theabcdef", "theabcde", "theabcdefghijklmnopqrstuvwxyz", "theabcdefghijklmnopqrstuvwxyza", "theabcdefghijklmnopqrstu", "theabcdefghijklmnopqrstv", "thébcdef", "thecbadef", "the", "thefedcba"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = sorted(tuple(r) for r in candidates.pair_distances(w, w, slices=3).select("target", "word", "pref", "suff", "dist").collect())
    t = w.select(F.col("word").alias("target"))
    want = t.join(w, (F.col("target") != F.col("word")) & (F.substring("target", 1, 3) == F.substring("word", 1, 3)))
    assert got == sorted(tuple(r) for r in want.select("target", "word", similarity.common_prefix(F.col("target"), F.col("word")), similarity.common_suffix(F.col("target"), F.col("word")), similarity.bounded_distance(F.col("target"), F.col("word"))).collect())


def plain_lookalikes(sounds, targets, words, count=3):
    """The rules of look-alikes pair by pair."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def same(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    out = set()
    for a in targets:
        found = []
        for b in words:
            (ask, arh, asy), (bsk, brh, bsy) = sounds[a], sounds[b]
            gap, pref, suff, d, beats = abs(len(a) - len(b)), same(a, b), same(a[::-1], b[::-1]), edits(a, b), abs(asy - bsy)
            ends = [x for x in candidates.SCHOLARLY if a.endswith(x) and b.endswith(x)]
            shared = ask == bsk and len(ask) >= 3 or arh == brh and len(arh) >= 3 or a[-4:] == b[-4:] and min(len(a), len(b)) >= 6
            shared = shared or any(min(len(a), len(b)) >= len(x) + 2 for x in ends) or gap <= 3 and (a[:3] == b[:3] or a[1:4] == b[1:4])
            sk, sch = ask != "" and ask == bsk and gap <= 2, bool(ends) and beats <= 2
            ct = min(len(a), len(b)) >= 5 and gap <= 3 and (a.endswith(b) or b.endswith(a)) and arh == brh
            rh = len(arh) >= 3 and arh == brh and d <= 2 or ct
            if a == b or not shared or gap > (4 if sch else 3) or not (d <= 2 or sk or rh or sch or pref >= 4 and len(a) >= 6 or pref >= 3 and suff >= 2):
                continue
            s = {1: 45, 2: 26}.get(d, 0) + 4 * pref + 2 * suff - (0 if sch else 2 * gap) + (18 if sk and d <= 2 else 14 if sk and not beats else 0)
            s += (12 if rh and not beats else 0) + (30 if ct else 0) + ((48 if beats <= 1 else 44) if sch else 0)
            found.append((-s, b))
        out |= {(a, b, -s, i) for i, (s, b) in enumerate(sorted(found)[:count], 1)}
    return out


def test_lookalikes_pair_by_pair(spark, monkeypatch):
    """Crowded and small blocks, words beyond ASCII, targets that the pool lacks; blocks whole and in slices."""
    import random

    rng = random.Random(3)
    parts = ["the", "ing", "tion", "kn", "a", "e", "ist", "ship", "ology", "ph", "c", "ou", "é", "st"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(500)} | {"physics", "music", "topics", "knight", "night", "light"})
    words = [w for w in words if len(w) >= 4]
    targets = [w for w in words if len(w) >= 6][::2] + ["theologist", "knightship"]
    w, t = (spark.createDataFrame([(x,) for x in xs], "word string") for xs in (words, targets))
    sounds = {r.word: (r.skel, r.rhyme, r.syl) for r in candidates.sounded(w.union(t)).collect()}
    want = plain_lookalikes(sounds, targets, words)
    assert len(want) > 400
    for portion in (candidates.SLICE, 7):
        monkeypatch.setattr(candidates, "SLICE", portion)
        assert {(r.target, r.word, r.score, r.place) for r in candidates.lookalikes(t, w).collect()} == want


def test_lookalikes_make_no_pairs_in_spark(spark):
    """A crowded block's pairs don't become rows of a join."""
    w = spark.createDataFrame([(f"theword{i}",) for i in range(300)], "word string")
    d = candidates.lookalikes(w, w)
    assert d.count() == 900
    joins = [line for line in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Join " in line]
    assert len(joins) == 2 and all("block" in x for x in joins)


def test_route_question_by_question(spark):
    """Frequent and rare tokens, repeated ones, types named in questions, equal scores: against all names for each question;
    and names that only a token of all names is in don't become pairs with each question."""
    import random
    import re

    rng = random.Random(5)
    items = [(f"unit_{rng.choice(['alpha', 'beta', 'gammabeta'])}_{i}{x}", k) for i in range(40) for x, k in (("", "other"), ("_vocabulary", "wiki_vocabulary"))]
    asked = [(i, " ".join(rng.choices(["unit", "alpha", "beta", "vocabulary", "x", "it", "3", "17", "gamma", "none"], k=rng.randint(0, 5)))) for i in range(60)] + [(99, None)]
    q, n = spark.createDataFrame(asked, "q_id long, question string"), spark.createDataFrame(items, "name string, type string")
    want = set()
    for i, text in asked:
        ts = [t for t in re.findall("[a-z0-9]+", text or "") if len(t) > 1 or t.isdigit()]
        s = [(sum(20 if t.isdigit() else 10 for t in ts if t in name), name, kind) for name, kind in items]
        s = sorted((-(x + 5 * ("vocabulary" in ts and kind == "wiki_vocabulary")), name) for x, name, kind in s if x)
        want |= {(i, name, -x, k) for k, (x, name) in enumerate([y for y in s if -y[0] > 15][:3], 1)}
    got = graph.route(q, n)
    assert {(r.q_id, r.name, r.score, r.place) for r in got.collect()} == want
    many = q.where("q_id < 10").withColumn("question", F.lit("it unit unit")).crossJoin(spark.range(200).withColumnRenamed("id", "k")).select((F.col("q_id") * 1000 + F.col("k")).alias("q_id"), "question")
    r = graph.route(many, n)
    assert r.count() == 10 * 200 * 3 and "toks" in r._jdf.queryExecution().optimizedPlan().toString()


def test_examples_without_index(spark):
    """The same sentences as by the index: repeated texts, common and absent words, words asked for twice, no hits, few hits;
    and no postings are made."""
    import random

    rng = random.Random(11)
    words = ["the", "of", "tion", "and", "rare", "murder", "ing"]
    texts = [" ".join(rng.choices(words, [9, 7, 5, 3, 1, 1, 5], k=rng.randint(2, 20))) + rng.choice([".", "", "!"]) for _ in range(400)]
    pool = spark.createDataFrame([(i % 37, i, t) for i, t in enumerate(texts + texts[:150] + ["the of of tion."] * 40)], "doc_id long, sid int, text string")
    asked = ["the", "the of", "of of", "rare tion", "and rare murder", "nowhere", "the nowhere", "", None, "ing ing the", "of of tion"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = examples.search_once(q, pool)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in examples.search(q, examples.index(pool), pool).collect()}
    assert got.where("query_id = 0").count() == 3 and "places" not in got._jdf.queryExecution().optimizedPlan().toString()
