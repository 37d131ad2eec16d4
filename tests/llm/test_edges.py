"""Nulls, ties, repeats, empty tables and clashing names, operator by operator, by value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import common, lines, mixing, queries, toxicity, urls

NAMES = ("__id", "__th", "__lines", "__did", "__drop", "__n", "__s", "__t", "__g", "__h", "__hash", "c0", "c1", "copies", "below", "key", "node")


def crowded(spark, rows):
    """Documents with a column of each name that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(n).alias(n) for n in NAMES))


TOXIC = "w20 w21 idiot w22 w23 w24 w25 w26 w27 w28 w29"
LINES = [(i, f"own words here {i}\nthis stands on every site\nshort one", f"s{i % 7}") for i in range(20)] + [(30, None, "s1"), (31, "", None), (32, "this stands on every site", None), (32, "this stands on every site", None)]


def test_lines_clashing_names_and_nulls(spark):
    got = lines.dedup_lines(crowded(spark, LINES))
    assert got.columns == ["doc_id", "text", "source", *NAMES]
    rows = got.collect()
    assert len(rows) == len(LINES) and all(r[n] == n for r in rows for n in NAMES)
    text = {r.doc_id: r.text for r in rows}
    assert text[0] == LINES[0][1] and text[1] == "own words here 1\nshort one" and text[30] is None and text[31] == "" and text[32] == ""


@pytest.mark.parametrize("sites", [4, 5, 6])
def test_lines_on_exactly_so_many_sites(spark, sites):
    """Near the threshold sites are counted exactly; at least five of them make a line boilerplate."""
    docs = spark.createDataFrame([(i, "this stands on several sites", f"s{i % sites}") for i in range(60)], "doc_id long, text string, source string")
    gone = [r for r in lines.dedup_lines(docs, counts=True, sigmas=1000.0).collect() if r.n_removed]
    assert len(gone) == (59 if sites >= 5 else 0)
    assert len([r for r in lines.dedup_lines(docs, counts=True, keep_first=False).collect() if r.n_removed]) == (60 if sites >= 5 else 0)
    assert lines.dedup_lines(docs.limit(0), counts=True).count() == 0


def test_lines_written_in_few_files(spark, tmp_path, monkeypatch):
    """The small tables of lines are a file a core at most, however many partitions their shuffles have; same rows."""
    rows = [(i, "\n".join(f"this line {(i + j) % 300} stands here" for j in range(8)), f"s{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in lines.dedup_lines(docs, counts=True).collect())
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    now = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in lines.dedup_lines(docs, counts=True).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    assert len(files) == 2 and all(0 < n <= spark.sparkContext.defaultParallelism for n in files.values()), files
    assert got == want and sum(r[4] for r in got) == 2100


def test_mixing_by_value(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1), "a") for i in range(30)] + [(100 + i, words(3), "b") for i in range(200)] + [(400, None, "a"), (401, "", "a"), (500, words(5), None)]
    df = crowded(spark, rows)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert got[0].target == 90 and got[500].target == 15 and abs(got[100].target - (total - 105)) < 1e-6  # two sources at three times their size
    assert all(r.taken <= 3 * r.size for r in got.values()) and got[400].size == got[401].size == 0
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times: dict[int, int] = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times[0] == times[500] == 3 and times.get(400, 0) <= 3 and times.get(401, 0) <= 3
    one = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(one).collect()) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert mixing.mix(one.limit(0)).count() == 0 and mixing.mixed_documents(one.limit(0)).count() == 0


def test_urls_two_ways(spark):
    pages = [(1, None), (2, "http://EXAMPLE.com/en/x?q"), (3, "http://www.example.com/en/"), (3, "http://www.example.com/en/"), (4, "https://a.net/es/"), (5, "x"), (6, "http://com"), (7, "http://b.org/")]
    df = spark.createDataFrame([(i, u, "h", "p", "r", "v") for i, u in pages], "page_id long, url string, host string, path string, rule string, verdict string")
    rules = [("allow", "example.com", "/en/"), *queries.URL_RULES]  # the last of one rule's verdicts holds
    plain, joined = (sorted(map(str, urls.filter_urls(df, rules, max_rules=m).select("page_id", "host", "path", "rule", "verdict").collect())) for m in (100, 1))
    assert plain == joined and len(plain) == len(pages)
    assert {(r.page_id, r.rule, r.verdict) for r in urls.filter_urls(df, rules).collect() if r.page_id in (2, 6, 7)} == {(2, "example.com/en/", "block"), (6, None, "allow"), (7, None, "allow")}
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {r.verdict for r in urls.filter_urls_joined(df, spark.createDataFrame([], "verdict string, host string, path string")).collect()} == {"allow"}


def test_toxicity_passes_columns_through(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" + (" idiot" if i % 2 and j == i % 9 else "") for j in range(10)), "s") for i in range(60)]
    docs = crowded(spark, [*rows, (90, None, "s"), (91, "", None), (92, TOXIC, "s"), (92, TOXIC, "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, toxicity.train(toxicity.training_rows(docs, labels)))
    left = kept.collect()
    assert kept.columns == docs.columns and all(r[n] == n for r in left for n in NAMES)
    ids = {r.doc_id for r in left}
    assert 92 not in ids and {0, 90, 91} <= ids


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_odd_tables(spark, empty, tmp_path):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six", None), (3, "one two three four five six", None), (None, "no id here", "b"), (5, "x " * 30_000, "b"), (6, "One two  three four five six", "c")]
    docs = crowded(spark, [] if empty else rows)
    spark.createDataFrame([] if empty else [(3, 1), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "source", *NAMES], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() == 0) == empty, name
    assert "n_tokens" in docs.columns


def test_urls_of_one_key(tmp_path, monkeypatch):
    """Strings that share a key: the stored string decides."""
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda t, seed: 7)
    (tmp_path / "rules").write_bytes(urls.digest_file(queries.URL_RULES))
    index = urls.DigestArray(str(tmp_path / "rules"))
    at = index.judge(["example.com", "www.example.com", "a.net", "b.org", "x.com"], ["/en/a", "/en/", "/fr/", "/es/", "/"])
    assert [index.rule(i).decode() if i >= 0 else None for i in at] == ["example.com/en/", "www.example.com/en/", "net/fr/", None, "com/"]
    assert len(set(index.keys.tolist())) == 1 and index.probe([b"never heard of"]).tolist() == [-1]


def test_lines_of_null_texts_against_sql(spark, tmp_path):
    import duckdb

    from ..oracle import plain

    rows = [(i, None if i % 4 == 0 else f"own words here {i}\nthis stands on every site", "en", f"s{i % 7}", 3) for i in range(1, 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op2_line_dedup"])
    names = [d[0] for d in want.description]
    assert sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_models_of_one_class_and_empty_texts(spark):
    """Labels of one class alone: nothing can be told apart, so all texts score as the share of that class, and nothing is
    dropped. Empty and null texts score alike."""
    from lexmill.llm import quality

    docs = spark.createDataFrame([(i, f"some words {i} here", "s") for i in range(40)] + [(90, "", "s"), (91, None, "s")], "doc_id long, text string, source string")
    one = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, toxic int, quality int")
    m = toxicity.train(toxicity.training_rows(docs, one))
    assert toxicity.drop_toxic(docs, m).count() == 42 and {(r.score, r.predicted) for r in toxicity.score_documents(docs, m).collect()} == {(1.0, 1)}
    none = toxicity.train(toxicity.training_rows(docs, one.limit(0)))
    assert {(r.score, r.predicted) for r in toxicity.score_documents(docs, none).collect()} == {(0.0, 0)}
    q = quality.train(quality.training_rows(docs, one))
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, q).collect()}
    assert len(scores) == 42 and scores[90] == scores[91] and all(0 <= x <= 1 for x in scores.values())
