"""Quotes and the texts that contain them."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 22  # characters of quotes that one automaton holds


def contained(docs: DataFrame, quotes: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, doc_id: each text (doc_id, text) with each quote (item_id, quote) that it contains as a substring, whether
    or not it begins and ends at a word. An empty quote is in every text; nulls are in none and contain none.

    The quotes become an automaton that a text passes once, however many quotes there are. An automaton holds at most
    `most` characters of quotes: more are dealt by hash to several, and the texts are read once for each."""
    spark = docs.sparkSession
    quotes = quotes.where("quote IS NOT NULL").groupBy("quote").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    size = quotes.agg(F.coalesce(F.sum(F.length("quote") + F.size("ids")), F.lit(0))).first()[0]
    passes = max(1, -(-2 * size // most)) if size > most else 1
    docs = docs.select("doc_id", "text").where("text IS NOT NULL")
    out = None
    for i in range(passes):
        rows = [(r[0], r[1]) for r in quotes.where(F.pmod(F.xxhash64("quote"), F.lit(passes)) == i).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches, shared=shared):
            found, every = ahocorasick.Automaton(), []
            for quote, ids in shared.value:
                if quote:
                    found.add_word(quote, ids)
                else:
                    every += ids
            if len(found):
                found.make_automaton()
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    hits = [sorted({x for _, ids in found.iter(t) for x in ids} | set(every)) if len(found) else every for t in part.column("text").to_pylist()]
                    at = [j for j, h in enumerate(hits) for _ in h]
                    yield pa.RecordBatch.from_arrays([pa.array([x for h in hits for x in h], pa.int64()), part.column("doc_id").take(pa.array(at, pa.int64()))], ["item_id", "doc_id"])

        here = docs.mapInArrow(scan, f"item_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
        out = here if out is None else out.unionByName(here)
    return out
