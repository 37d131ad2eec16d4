"""The methods of single operators against plain ones."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lexmill.llm import ann, bpe, passages, quality, queries, simhash, topk
from lexmill.llm.common import table

from ..oracle import SF, check


def test_hinge_loss_dual(spark):
    """Dual coordinate descent against projected gradient steps on the dense dual, and its own optimality conditions."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.5)
    y, cost = np.where(rng.random(60) < 0.4, 1.0, -1.0), rng.uniform(0.2, 1.0, 60)
    x[:, 0] += y
    x[3] = 0
    rows = [(np.nonzero(r)[0], r[np.nonzero(r)[0]]) for r in x]
    w, a = quality.dual_descent(rows, y, 12, cost, 5000, close=1e-7)
    assert (a >= 0).all() and (a <= cost).all() and np.allclose(w, (a * y) @ x)
    q, b = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(60)
    step = 1 / np.linalg.norm(q, 2)
    for _ in range(50_000):
        b = np.clip(b - (q @ b - 1) * step, 0, cost)
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    plain = (b * y) @ x
    assert abs(loss(w) - loss(plain)) < 1e-3 * loss(plain)
    assert np.linalg.norm(w - plain) < 1e-2


def test_quality_brute_force(spark):
    """Log-count ratios and the scaled margin against plain sets."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randint(0, 9)}"]) for _ in range(12)) + (" fine" if i % 2 else ""), i % 2) for i in range(80)] + [(90, None, 1), (91, "", 0)]
    m = quality.train(spark.createDataFrame(rows, "doc_id long, __t string, y int"))

    def grams(t):
        w = (t or "").split()
        b = (" " + " ".join(w) + " ").encode()
        return {("w", x) for x in w} | {("p", x) for x in zip(w, w[1:], strict=False)} | ({("t", b[i : i + 3]) for i in range(len(b) - 2)} if w else set())

    n = [Counter(g for _, t, y in rows if y == c for g in grams(t)) for c in (0, 1)]
    both = n[0] + n[1]
    known = {g for g in both if both[g] >= 2}
    assert len(m.words.hashes) == len(known)
    total = [sum(n[c][g] + 1 for g in known) for c in (0, 1)]
    ratio = {g: np.log((n[1][g] + 1) / total[1]) - np.log((n[0][g] + 1) / total[0]) for g in known}
    for _, t, _y in rows:
        assert np.allclose(sorted(m.ratios[m.words((t or "").encode())]), sorted(ratio[g] for g in grams(t) if g in known))


def test_bpe_chunks_of_any_text(spark):
    ranks, pattern = queries.ranks_and_pattern()
    own = bpe.Codec(ranks, pattern)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.bpe._mergeable_ranks, special_tokens={})
    rng, parts = random.Random(5), ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'LL", "1", "22", "é", "日本", "\U0001f600", "!", "--", "\t", "\x1c", " word", "ſ", "　"]
    for _ in range(1500):
        own.chunk, own.overlap = rng.choice([(64, 16), (40, 40), (17, 5), (100, 64)])
        t = "".join(rng.choice(parts) for _ in range(rng.randint(60, 300)))
        assert own.encode(t).tolist() == lib.encode_ordinary(t)


def test_bpe_long_texts_over_tasks(spark):
    """Chunks of long texts as rows; a text without a common boundary; repeated and null ids; decoding."""
    ranks, pattern = queries.ranks_and_pattern()
    lib = bpe.Codec(ranks, pattern).bpe
    docs = [(1, "the quick brown fox 123's " * 40_000), (2, "a" * 200_000), (3, None), (4, ""), (1, "short"), (None, "x y\n" * 30_000), (7, "x y\n" * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = bpe.encode_documents(df, ranks, pattern, spread=0)
    coded = bpe.encode_documents(df, ranks, pattern)
    assert sorted(map(str, every.collect())) == sorted(map(str, coded.collect()))
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == sorted((str(i), lib.encode_ordinary(t or "")) for i, t in docs)
    back = bpe.decode_documents(coded, ranks, pattern)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in docs)


def test_bpe_decodes_odd_ids(spark):
    ranks, pattern = queries.ranks_and_pattern()
    odd = spark.createDataFrame([(1, [1, 2]), (2, None), (3, []), (4, [10**9]), (5, [None])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode_documents(odd, ranks, pattern).collect()}
    assert got == {1: b'"#', 2: None, 3: b"", 4: None, 5: None}
    assert bpe.decode_documents(odd.limit(0), ranks, pattern).count() == 0


@pytest.mark.parametrize("how", [{"bits": 13}, {"broadcast_rows": 0}, {"most_bits": 12}, {"bits": 13, "most_bits": 13, "broadcast_rows": 0}])
def test_passages_with_full_sketches(spark, how):
    """Every cell full, cells answered by blocks instead of a bitmap, no step for copies: the same rows."""
    check(spark, lambda s, d: passages.dedup_passages(table(s, d, "documents"), **how), queries.oracle_sql()["op8_substring_dedup"])


@pytest.mark.parametrize("most_bits", [30, 10])
def test_passages_of_odd_rows(spark, most_bits):
    base = " ".join(f"b{i}" for i in range(30))
    rows = [(1, base), (None, base), (2, "x " + base), (2, base + " y"), (3, None), (4, "one two"), (5, (" ".join(f"c{i}" for i in range(14)) + " ") * 3)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, k1 int, at int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(docs, texts=True, most_bits=most_bits).collect()]
    assert sorted(got, key=str) == sorted([(1, 30, 0, base), (None, 30, 0, base), (2, 31, 30, "x"), (2, 31, 30, "y"), (3, 0, 0, ""), (4, 2, 0, "one two"), (5, 42, 0, rows[-1][1].strip())], key=str)
    assert passages.dedup_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most_bits", [30, 4])
def test_passages_hot_window(spark, most_bits):
    """A passage of every document is removed from all but the first, over several tasks."""
    hot = " ".join(f"h{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own{i} {hot} end{i}") for i in range(3000)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_removed, r.kept) for r in passages.dedup_passages(docs, most_bits=most_bits, texts=True).collect()}
    assert got[0][0] == 0 and all(got[i] == (20, f"own{i} end{i}") for i in range(1, 3000))


def test_top_k_phases(spark):
    """Ties, repeated ids, passes, numbers beyond doubles; and far fewer resolved scores than pairs."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-(2**26), 2**26, 3)]) for i in range(40)] + [(5, [1.0, 2.0, 3.0]), (41, [2.0**30] * 3), (42, [2.0**30] * 3), (43, [1e300] * 3), (44, [2.0**30] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for i, v in exact:
        if i % 4 == 0:
            c = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=False)), 2**63 - 1), -(2**63)), j) for j, w in exact if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c)]
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 4 = 0"), k=5, block=3).collect()) == sorted(want)
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    chosen = vectors.where("vec_id % 20 = 0")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    topk.top_k(vectors, chosen, resolved=counts).write.format("noop").mode("overwrite").save()
    pairs = vectors.count() * chosen.count()
    assert 0 < counts[0].value < 0.1 * pairs and 0 < counts[1].value < 0.7 * pairs


def test_ann_recall_of_a_larger_table(spark):
    """40,000 vectors round 300 centres: recall, and the share of lists that a query probes."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 40_000)] * 2 + rng.normal(size=(40_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict[int, set] = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 500 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, len(u), 500):
        s = u @ u[q]
        s[q] = -9
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found) and len(found) == 80
    quantiser = ann.fit(df.selectExpr("vec_id AS id", "embedding AS v"), 8.0, 16, 65_536, 5, 0.9)
    assert len(quantiser.coarse) > 1000 and quantiser.probes < 0.2 * len(quantiser.coarse)


@pytest.mark.parametrize("kind", ["near copies", "one direction", "tight clusters", "positive"])
def test_ann_recall_of_other_rows(spark, kind):
    """Rows that codes can't tell apart, and such as the sample misjudges: recall by id against brute force, each score."""
    rng = np.random.default_rng(5)
    if kind == "near copies":
        x = rng.normal(size=(6000, 64))
        x[:5400] = x[0] + 1e-3 * rng.normal(size=(5400, 64))
    elif kind == "one direction":
        x = 10 * rng.normal(size=64) + rng.normal(size=(6000, 64))
    elif kind == "tight clusters":
        x = rng.normal(size=(10, 64))[rng.integers(0, 10, 6000)] + 0.02 * rng.normal(size=(6000, 64))
    else:
        x = rng.random((4000, 128))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict[int, list] = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, len(u), 50):
        s = u @ u[q]
        s[q] = -9
        hits += len({r.vec_id for r in found[q]} & set(np.argsort(-s)[:5].tolist()))
        assert len(found[q]) == 5 and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found[q])
    assert hits >= 0.95 * 5 * len(found) and len(found) == len(u) // 50


def test_ann_codes_lose_nothing(spark):
    """Within the probed lists the search is exact, however few are reranked at first."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    quantiser = ann.fit(df, 8.0, 4, 65_536, 5, 0.9)
    index, counts = ann.build_index(df, quantiser)
    quantiser.probes = len(quantiser.coarse)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(index, counts, df.where("id % 100 = 0"), quantiser, 5, rerank=5).collect()]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = [(q, r + 1, int(i)) for q in range(0, 3000, 100) for r, i in enumerate([j for j in np.argsort(-(u @ u[q])) if j != q][:5])]
    assert sorted(got) == want
    assert ann.measured_probes(index, df.where("id % 100 = 0"), quantiser, 5, 1.0, 1024) <= len(quantiser.coarse)


def test_ann_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "FLAT", 8)
    df = table(spark, SF, "embeddings")
    got = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect()
    assert {r.query_id for r in got} and all(r.rank <= 5 for r in got)


def test_ann_crowds_and_thin_lists(spark):
    """A crowd of equal vectors, queries within it and far from it, a query whose id repeats: five neighbours each."""
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(9000)] + [(100_000 + i * 50, [float(a) for a in rng.normal(size=3)]) for i in range(40)] + [(50, [0.3, -1.0, 0.2])] * 30
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got: dict[int, list] = {}
    for r in ann.nearest_neighbours(v, v.where("vec_id % 50 = 0").dropDuplicates(["vec_id"])).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 220 and all(len(x) == 5 for x in got.values())
    assert got[0] == [1, 2, 3, 4, 5] and got[100] == [0, 1, 2, 3, 4] and 50 not in got[50]


def test_simhash_one_dense_ball(spark):
    """20,000 fingerprints that no vantage point parts well: slices, and the same links as a plain search."""
    rng = np.random.default_rng(6)
    base = np.int64(0x0F0F_3333_5555_7777)
    fps = np.unique(np.array([base ^ sum(np.int64(1) << np.int64(b) for b in rng.choice(40, rng.integers(0, 7), replace=False)) for _ in range(20_000)], np.int64))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    star = {r.node: r.root for r in simhash.stars(simhash.similar_links(df, 3, leaf=512)).collect()}
    bits = fps.view(np.uint64)
    near = [np.nonzero(np.bitwise_count(bits ^ x) <= 3)[0] for x in bits]
    seen, label = np.zeros(len(fps), bool), np.full(len(fps), -1)
    for i in range(len(fps)):
        if not seen[i]:
            todo, seen[i] = [i], True
            while todo:
                j = todo.pop()
                label[j] = i
                new = near[j][~seen[near[j]]]
                seen[new] = True
                todo += new.tolist()
    groups: dict[int, set] = {}
    for f, own in zip(fps.tolist(), label.tolist(), strict=True):
        groups.setdefault(own, set()).add(star.get(f, f))
    assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)
    assert len(fps) > 10_000
