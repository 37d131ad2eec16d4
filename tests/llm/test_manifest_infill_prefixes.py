"""Manifests, infilling and prefix counts against plain versions; odd rows by value."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import infill, merkle, prefixes
from lexmill.llm.common import table

from ..oracle import SF
from .test_llm import odd_documents

SPEC = public_tokenizers.path("word_bpe_49k.json")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    """{position: (leaf, subroot, root, proof, folded, verified)} by lists of levels."""
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(frame, (r[0], r[1], r[2], r[3], t))))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = {}
    for k, r in enumerate(rows):
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), k))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in names}
    above = levels([trees[s][-1][0] for s in names])
    out = {}
    for n, s in enumerate(names):
        for i, x in enumerate(sorted(by[s])):
            r, proof = rows[x[3]], []
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "")) if even and r[4] is not None else x[2]
            for lists, at in ((trees[s], i), (above, n)):
                for level in lists[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings = run[: at % 3] + run[at % 3 + 1 :]
                    proof += siblings
                    folded = sha("".join([*run[: at % 3], folded, *run[at % 3 + 1 :]]))
                    at //= 3
            root = above[-1][0]
            out[x[3]] = (r[0], x[2], trees[s][-1][0], root, sha("".join(proof)), folded, folded == root)
    return out


@pytest.mark.parametrize("sources", [1, 4, 10])
def test_manifest_equals_plain(spark, sources):
    rng = random.Random(sources)
    rows = [(i, f"s{rng.choice([0, 0, rng.randrange(sources)])}" if i % 9 else None, "en", i, f"text {i}\nof lines") for i in range(131)]
    rows += [(7, "s0", "en", 1, "again\n"), (7, "s0", "en", 1, "again\n"), (None, "s0", None, None, None), (300, "alone", "de", 5, ""), (301, "é", "de", None, "\n"), (302, "s0", "en", 2, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, leaf string, size string").repartition(5)
    got = merkle.Manifest(df, merkle.even_crc(F.col("doc_id"))).proofs()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_manifest(rows).values()))


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.Manifest(spark.createDataFrame([], schema)).proofs().count() == 0
    rows = [(5, None, "en", 3, "a\nb")]
    for i in (5, 6):  # the checksum of one of them is even
        rows = [(i, None, "en", 3, "a\nb")]
        df = spark.createDataFrame(rows, schema)
        one = merkle.Manifest(df, merkle.even_crc(F.col("doc_id"))).proofs().collect()
        assert [tuple(r) for r in one] == list(plain_manifest(rows).values())
        assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")
    odd = merkle.Manifest(odd_documents(spark)).proofs().collect()
    assert len(odd) == odd_documents(spark).count() and all(r.verified for r in odd)


def test_manifest_nodes(spark):
    """The manifest itself: each node is the hash of its children, and levels shrink by threes."""
    m = merkle.Manifest(table(spark, SF, "documents"))
    nodes = m.nodes.collect()
    assert all(merkle.digest_of([bytes(c) for c in n.children]) == bytes(n.digest) for n in nodes)
    sizes = {r.tree: r.size for r in m.sources.collect()}
    assert {(n.tree, n.level): n.size for n in nodes} == {(t, lv): -(-s // 3**lv) for t, s in sizes.items() for lv in range(1, merkle.height(s) + 1)}


UNITS = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_infill_marks(spark):
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice(["a", "bc", " ", "\n", "\t ", "é", "日本", " ", "\x1c", "\U0001f600"]) for _ in range(rng.randrange(40)))
        units, data = UNITS.findall(t), t.encode()
        ends = infill.unit_ends(data)
        assert ends.bit_count() == len(units)
        for k in range(len(units) + 1):
            assert data[: infill.place(ends, len(data), k)].decode() == "".join(units[:k])


def test_infill_restores(spark):
    docs = odd_documents(spark).union(spark.createDataFrame([(i, f"  word {i}\tand\n more words é \n" * (i % 7), "en", "s", 1, 0.5, 1, 2, 3, 4) for i in range(100, 400)] + [(500, "has <P> in it", "en", "s", 1, 0.5, 1, 2, 3, 4)], odd_documents(spark).schema))
    made = infill.transform(docs.withColumn("form", F.lit("clash")), rate=100)
    assert made.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars"]
    before = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    rows = made.withColumn("back", infill.restore(F.col("text"), F.col("form"))).collect()
    assert sorted((r.doc_id or -1, r.back) for r in rows) == before
    by = {r.doc_id: r for r in rows}
    assert by[3].form == by[4].form == by[500].form == "plain" and by[3].text == "" and by[3].n == 0 and by[500].n == 4 and by[3].prefix_chars is None
    assert by[5].n == 1 and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert by[7].n == 100_001  # the last unit is the space at the end
    for r in rows:
        if r.form == "spm":
            assert r.text.startswith("<S>") and len(r.text.split("<P>")[1].split("<M>")[0]) == r.prefix_chars and len(r.text.split("<M>")[1]) == r.middle_chars
    assert infill.transform(docs.limit(0)).count() == infill.digests(docs.limit(0)).count() == 0
    assert {r.form for r in infill.transform(docs, rate=0).collect()} == {"plain"}


WORDS = ["'re", "'s", "'ll", "it's", " ", "  ", "\n", "\t", "a", "b", "the", "ing", "Th", "é", "é", "İ", "Σ", "σΣ ", "日本語", "が", "각", "한국", "!!", "'", "<|endoftext|>", "<|endof", "<|startoftext|>", "|>", "1", "23", "½", "\U0001f600", "̀", "x" * 30, "Ᲊ", "क़", " ", "\x1c", "\x85", "internationalization", "ো", "ß", "̈́"]


def test_every_prefix(spark):
    """Each prefix against the library; within a composed sequence it counts as the whole sequence."""
    own, lib = prefixes.PrefixCounter(prefixes.read_spec(SPEC)), Tokenizer.from_file(SPEC)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(7)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(14))) for _ in range(300)]
    texts += [r.text[at : at + 200] for r, at in zip(table(spark, SF, "documents").where("text IS NOT NULL").limit(40).collect(), range(40), strict=False)]
    for t in texts:
        got = own.prefixes(t).tolist()
        assert len(got) == len(t)
        for i in range(len(t)):
            nxt = t[i + 1 : i + 2]
            if not (nxt and (unicodedata.combining(nxt) or nxt in prefixes.joined_backwards())):
                assert got[i] == count(t[: i + 1]), (t, i)
    for r in table(spark, SF, "documents").collect():
        assert (own.prefixes(r.text or "").tolist() or [0])[-1] == count(r.text or "")
    for t in ("a" * 50_000, "ab" * 20_000, "!?" * 20_000, "é" * 9_999):
        assert own.prefixes(t)[-1] == count(t)


def test_prefix_questions(spark):
    spec, lib = prefixes.read_spec(SPEC), Tokenizer.from_file(SPEC)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    docs = odd_documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = prefixes.count_tokens(docs, spec, limit=11).collect()
    assert len(got) == docs.count()
    made = prefixes.prefix_table(docs, spec, block=16)
    cuts = prefixes.longest_prefixes(made, 11, block=16).collect()
    assert sorted((r.doc_id or -1, r.chars) for r in cuts) == sorted((r.doc_id or -1, r.fits_chars) for r in got)
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 11)
        assert count(t[: r.fits_chars]) <= 11 and all(count(t[:k]) > 11 for k in range(r.fits_chars + 1, min(len(t), r.fits_chars + 40) + 1))
    places = spark.createDataFrame([(1, 0), (1, 5), (1, 16), (1, 17), (1, 10**9), (1, -1), (10, 300), (99, 3), (3, 0), (3, 1)], "doc_id long, chars long")
    at = {(r.doc_id, r.chars): r.n_tokens for r in prefixes.tokens_at(made, places, block=16).collect()}
    assert at == {(1, 0): 0, (1, 5): count(texts[1][:5]), (1, 16): count(texts[1][:16]), (1, 17): count(texts[1][:17]), (1, 10**9): None, (1, -1): None, (10, 300): count(texts[10][:300]), (99, 3): None, (3, 0): 0, (3, 1): None}
    assert prefixes.count_tokens(docs.limit(0), spec, 5).count() == prefixes.prefix_table(docs.limit(0), spec).count() == 0
