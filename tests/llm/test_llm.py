"""The training-data operators: SQL where there is some, else brute force, round trips and held-out accuracy; then edge cases."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from lexmill.llm import ann, bpe, lines, mixing, passages, quality, queries, simhash, topk, toxicity, urls
from lexmill.llm.common import table

from ..oracle import SF, check

LARGER = "/root/testdata/sf0.01"
MODELS = ("/root/testdata/sf0.01", "/root/testdata/sf0.1")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, fp long, rank int, hash long"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name])


def odd_documents(spark):
    """Nulls, empty, long and repeated texts, repeated rows, columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, base), (2, base + " fifteen"), (2, base + " fifteen"), (3, None), (4, ""), (5, " \t\n"), (6, "a" * 200_000), (7, "x y " * 50_000), (8, base), (None, base), (9, "two words"), (10, "Grüße 日本語 \U0001f600\n" * 30)]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 6}", len(t or ""), 0.5, 1, 2, 3, 4) for i, t in rows], DOCS)


def test_simhash_brute_force(spark):
    def fp(t):
        w = [bytes(b) for b in (t or "").encode().lower().split()]
        g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    prints = {i: fp(t) for i, t in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_vantage_trees_lose_no_link(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 2000, dtype=np.int64)
    near = seeds.copy()
    for _ in range(3):
        near ^= np.int64(1) << rng.integers(0, 63, len(seeds))
    fps = np.unique(np.concatenate([seeds, near]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    star = {r.node: r.root for r in simhash.stars(simhash.similar_links(df, 3, leaf=64)).collect()}
    for a, b in zip(seeds.tolist(), near.tolist(), strict=True):
        assert star.get(a, a) == star.get(b, b)


def test_bpe_equals_library(spark):
    ranks, pattern = queries.ranks_and_pattern()
    own = bpe.Codec(ranks, pattern, chunk=64, overlap=8)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.bpe._mergeable_ranks, special_tokens={})
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()] + ["", " " * 500, "a" * 700, "x  \n\n  y\t" * 90, "\x1c\x1d a b　c\r\n" * 40, "it's WE'LL 12345 日本語\U0001f600" * 60]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    got = {r.doc_id: r for r in queries.op4_bpe(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids = np.array(lib.encode_ordinary(r.text or ""), dtype="<u4")
        assert tuple(got[r.doc_id])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_ann_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, LARGER, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found: dict[int, set] = {}
    for r in queries.op7_ann(spark, LARGER).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - rows[r.query_id] @ rows[r.vec_id] / np.linalg.norm(rows[r.query_id]) / np.linalg.norm(rows[r.vec_id])) < 1e-12
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -9
        hits += len(found[q] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        assert len(found[q]) == 5
    assert hits >= 0.9 * 5 * len(found)


@pytest.mark.parametrize("sf_dir", MODELS)
@pytest.mark.parametrize(("name", "column", "mod", "rest", "least"), [("op9_toxicity", "toxic", 3, 1, 0.9), ("op10_quality", "quality", 5, 0, 0.9)])
def test_held_out_ranking(spark, name, column, mod, rest, least, sf_dir):
    truth = {r.doc_id: r[column] for r in table(spark, sf_dir, "labels").collect()}
    got = queries.queries()[name](spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in got)
    a = [r.score for r in got if r.held_out and truth.get(r.doc_id) == 1]
    b = [r.score for r in got if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]) >= least


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, empty):
    docs = odd_documents(spark).limit(0) if empty else odd_documents(spark)
    n = docs.count()
    ranks, pattern = queries.ranks_and_pattern()
    labels = spark.createDataFrame([] if empty else [(1, 1), (2, 0), (3, None), (4, 0), (6, 1), (7, 0), (None, 1)], "doc_id long, toxic int").selectExpr("doc_id", "toxic", "toxic AS quality")
    assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(docs).count() == n
    coded = {r.doc_id: r.n_tokens for r in bpe.encode_documents(docs, ranks, pattern).collect()}
    assert mixing.mix(docs).count() == n
    assert mixing.mixed_documents(docs).columns == docs.columns
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in passages.dedup_passages(docs, bits=20).where("doc_id IS NOT NULL").collect()}
    comp = {r.doc_id: r.component_id for r in simhash.components(docs).where("doc_id IS NOT NULL").collect()}
    m = toxicity.train(toxicity.training_rows(docs, labels))
    assert toxicity.score_documents(docs, m).count() == n
    assert toxicity.drop_toxic(docs, m).columns == docs.columns
    assert toxicity.drop_toxic(docs, m).count() <= n
    q = quality.train(quality.training_rows(docs, labels))
    assert quality.score_documents(docs, q).where("score BETWEEN 0 AND 1").count() == n
    if not empty:
        assert coded[3] == coded[4] == 0 and coded[6] > 0
        assert cut[1] == (14, 0) and cut[8] == (14, 14) and cut[2] == (15, 14) and cut[3] == (0, 0)
        assert comp[8] == 1 and comp[3] == comp[4] == comp[5] == 3
        assert set(comp) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
        left = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
        assert 8 not in left and {1, 3, 6, 7, 9, 10} <= set(left)
    else:
        assert simhash.drop_near_duplicates(docs).count() == 0


def test_line_spread(spark):
    rows = [(i, f"a line of its own {i}\nthis stands on every site\nshort one", f"s{i % 7}") for i in range(40)]
    got = {r.doc_id: r.text.split("\n") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1].split("\n")
    assert all(got[i] == [f"a line of its own {i}", "short one"] for i in range(1, 40))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 9), (1, None, 9), (2, [nan, 1.0], 9), (3, [inf, 0.0], 9), (4, [None, 1.0], 9), (5, [0.0, 0.0], 9), (6, [1.0, 2.0], 9), (7, [2.0, 4.0], 9), (None, [1.0, 1.0], 9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), k=2).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 64 * 128 + 128 * 256), (0, 2, 6, 64 * 64 + 128 * 128)]
    near = [tuple(r)[:3] for r in ann.nearest_neighbours(v, v.where("vec_id % 50 = 0"), k=5).orderBy("rank").collect()]
    assert near == [(0, 1, 6), (0, 2, 7)]
    none = v.limit(0)
    assert topk.top_k(none, none, k=2).count() == 0
    assert ann.nearest_neighbours(none, none, k=2).count() == 0


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x?q"), (5, "http://www.example.com/en/"), (6, "https://a.net/es/#x"), (7, "http://notcom/"), (8, "http://x.com" + "/y" * 100_000)]
    got = {r.page_id: (r.host[:20], r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got == {
        1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"), 4: ("example.com", "example.com/en/", "block"), 5: ("www.example.com", "www.example.com/en/", "allow"),
        6: ("a.net", "net/es/", "block"), 7: ("notcom", None, "allow"), 8: ("x.com", "com/", "allow"),
    }


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids, name
    out = corpus_pipeline.run(spark, SF)
    assert "n_tokens" in out.columns and 0 < out.count() <= 3 * len(ids)
