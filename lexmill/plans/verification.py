"""Queries of extracted items, made of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discourse, verification
from ..operators import morphology as M
from ..operators.iterate import cut
from .lexicon import levels
from .registry import query, table


def extracted(pool):
    """Six items of each document: its first sentence's longest word with that sentence, in its plural with a pointer, again
    with dots; its last sentence's longest word with the first sentence as quote; an invented word with a true and with an
    invented quote."""
    long_word = lambda c: F.try_element_at(F.array_sort(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), 1), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    d = pool.groupBy("doc_id").agg(F.min_by("text", "sid").alias("a"), F.max_by("text", "sid").alias("z")).withColumns({"wa": F.coalesce(long_word(F.col("a")), F.lit("")), "wz": F.coalesce(long_word(F.col("z")), F.lit(""))})
    rows = [("wa", F.col("a")), ("wa", F.lit("[S-1]")), ("wa", F.concat(F.lit("..."), F.substring("a", 3, 40), F.lit("..."))), ("wz", F.col("a")), (None, F.col("a")), (None, F.lit("Not present in the text at all, but inferred."))]
    word = lambda i, w: F.lit("zqxvjk") if w is None else F.concat(w, F.lit("s")) if i == 1 else F.col(w)
    items = F.array(*(F.struct(F.lit(i).alias("item"), word(i, w).alias("word"), q.alias("quote")) for i, (w, q) in enumerate(rows)))
    return d.select("doc_id", F.explode(items).alias("x")).select("doc_id", "x.*")


@query()
def verified_items(spark, sf_dir):
    """Each step sees what the ones before left, so without SQL; tests/test_verification.py has a plain version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pool = cut(discourse.sentence_pool(docs, sep="\n"))
    lv = cut(levels(spark, sf_dir))
    w = lv.select(F.col("word").alias("w"))
    lemma = cut(M.lemmas(w, lv))
    return verification.verify(cut(extracted(pool)), docs, pool, M.word_families(w, lemma), lemma)
