"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline
from lexmill.llm import toxicity
from lexmill.llm.common import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_near_duplicate_stage_equals_brute_force(spark):
    docs = table(spark, LARGER, "documents")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = [bytes(x) for x in (r.text or "").encode().lower().split()]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            near += x != y
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert near >= 10  # others than exact copies
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, LARGER).select("doc_id").collect()}
    assert got == {i for i in sets if find(i) == i}


def test_near_duplicate_stage_groups(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(20)]  # each a near copy of its neighbours, not of the far ones
    rows += [(100 + i, " ".join(f"v{j}" for j in range(60)) + f" end{i}") for i in range(50)]
    rows += [(200, None), (201, ""), (202, "two words"), (203, "Two  WORDS"), (204, "two"), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert set(left) == {0, None, 100, 200, 202, 204}
    assert len(left) == 6
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def toxic_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, __t string, y int")


def test_contexts_are_distinct(spark):
    """A frequent word has as many counts as distinct left contexts, however often its documents are copied."""
    rows = [(i, " ".join(f"l{j} often" for j in range(60 + 40 * (i % 2))), i % 2) for i in range(200)]
    lm = toxicity.train(toxic_rows(spark, rows)).lm
    h, doc = toxicity.tokens([b"often"])
    assert lm.counts[lm.places(h)[0]].tolist() == [60, 100, 100]


def test_kneser_ney_brute_force(spark):
    """Ratios and features of every text against plain dictionaries of distinct pairs."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 400) + (" awful" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    texts += [(500 + i, texts[0][1], 1) for i in range(9)] + [(600, "", 0), (601, "once", 1)]
    lm = toxicity.train(toxic_rows(spark, texts)).lm
    pairs = [set(), set()]
    for _, t, y in texts:
        w = words(t)
        pairs[y] |= set(zip(["", *w], w, strict=False))
    by = [Counter(w for _, w in p) for p in (*pairs, pairs[0] | pairs[1])]
    total, kinds = [sum(c.values()) for c in by], [len(c) for c in by]

    def ratio(w, own=None, ours=()):
        p = []
        for y in (0, 1):
            c, t = by[y][w], total[y]
            if own == y:
                c, t = max(0, c - sum(x == w for _, x in ours)), t - len(ours)
            p.append(max(c - 0.75, 0) / t + 0.75 * kinds[y] / t * (by[2][w] + 1) / (total[2] + kinds[2] + 1))
        return np.log(p[1] / p[0])

    for _, t, y in [*texts, (0, "never seen words awful w1 w1", 0)]:
        w = words(t)
        for own, ours in ((None, ()), (y, set(zip(["", *w], w, strict=False)))):
            r = sorted((ratio(x, own, ours) for x in w), reverse=True)
            want = [np.mean(r), r[0], sum(r[:2]) / 2] if r else [0, 0, 0]
            h, doc = toxicity.tokens([t.encode()])
            assert np.allclose(toxicity.features(lm, h, doc, 1, own)[0], want, atol=1e-6)


def test_large_toxicity_models_join(spark, monkeypatch):
    """No count is left out beyond the size of a broadcast: the joined tables give the same scores and rows."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")

    def results():
        m = toxicity.train(toxicity.training_rows(docs, labels))
        return m.lm, sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_documents(docs, m).collect()), sorted(r.doc_id for r in toxicity.drop_toxic(docs, m).collect())

    lm, scores, kept = results()
    monkeypatch.setattr(toxicity, "MOST", 10)
    joined, *got = results()
    assert isinstance(lm, toxicity.KneserNey) and isinstance(joined, toxicity.Tables)
    assert got == [scores, kept]
