"""Line dedup by distinct-site spread, with DataFrame functions only.

A line (trimmed of spaces) is boilerplate if it stands in documents of at least `min_sites` distinct sites. One
aggregation over the 128-bit line keys merges a HyperLogLog sketch of sites for each line, with the row count and the
first occurrence; sketches merge map-side, so that a line of a third of all documents is a few hundred rows at the
reducer. Lines whose estimate is within `sigmas` standard errors of the threshold get an exact distinct count in a
second, small pass; the others are decided by the estimate. Of each boilerplate line the first occurrence (smallest
doc_id, then place) stays, so that no text is lost from the corpus; keep_first=False removes that one as well.

Text moves once, in the last join, with the places to remove; the lines themselves travel as hashes. The join of line
occurrences with the boilerplate lines is a broadcast while these are at most `broadcast_rows`, else a shuffled join,
which AQE splits where a line is hot.

Null texts stay null. Blank lines and lines under `min_words` words are never boilerplate: they are parts of ordinary
prose. A null source counts as one site. Rows that repeat a doc_id and text are treated alike (all keep what the first
keeps). Other columns pass through, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stash


def _lines(docs: DataFrame, id_: str, text: str, site: str, min_words: int) -> DataFrame:
    line = F.trim(F.col("__l"))
    # a possessive pattern: linear time on any line
    long_enough = F.col("__l").rlike(r"^\s*+(?:\S++\s++){%d}\S" % (min_words - 1)) if min_words > 1 else F.col("__l").rlike(r"\S")
    return (
        docs.select(F.col(f"`{id_}`").alias("__id"), F.xxhash64(f"`{text}`").alias("__th"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{site}`").cast("string")), F.lit("")).alias("__site"), F.posexplode(F.split(f"`{text}`", "\n")).alias("__pos", "__l"))
        .where(long_enough)
        .select("__id", "__th", "__site", "__pos", F.xxhash64(line).alias("__k1"), F.xxhash64(F.lit(7), line).alias("__k2"))
    )


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int, sigmas: float, broadcast_rows: int) -> DataFrame:
    """(__k1, __k2, __first) of the lines that at least min_sites sites hold."""
    error = sigmas * 1.04 / 2 ** (lg_k / 2)
    spread = (
        lines.groupBy("__k1", "__k2")
        .agg(F.hll_sketch_agg("__site", lg_k).alias("__sk"), F.count(F.lit(1)).alias("__n"), F.min(F.struct("__id", "__th", "__pos")).alias("__first"))
        .where(F.col("__n") >= min_sites)  # so many sites take so many rows
        .select("__k1", "__k2", "__first", F.hll_sketch_estimate("__sk").alias("__est"))
        .where(F.col("__est") >= min_sites * (1 - error))
    )
    spread = stash(spread, "lines", few=True)
    far = F.col("__est") > min_sites * (1 + error)
    near = spread.where(~far)
    exact = lines.join(bounded(near.select("__k1", "__k2"), broadcast_rows), ["__k1", "__k2"], "left_semi").groupBy("__k1", "__k2").agg(F.count_distinct("__site").alias("__n")).where(F.col("__n") >= min_sites)
    return stash(spread.where(far).drop("__est").unionByName(near.join(exact, ["__k1", "__k2"], "left_semi").drop("__est")), "boilerplate", few=True)


def dedup_lines(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 5, min_words: int = 3, keep_first: bool = True, lg_k: int = 12, sigmas: float = 3.0, broadcast_rows: int = 500_000, counts: bool = False
) -> DataFrame:
    """docs without the boilerplate lines; with counts, also n_lines and n_removed (columns of these names give way)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't clash with those used here
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    i, t = names[id_], names[text]
    lines = _lines(docs, i, t, names[site], min_words)
    found = bounded(boilerplate_lines(lines, min_sites, lg_k, sigmas, broadcast_rows), broadcast_rows)
    hits = lines.join(found, ["__k1", "__k2"])
    if keep_first:
        hits = hits.where(~F.struct("__id", "__th", "__pos").eqNullSafe(F.col("__first")))
    drop = hits.groupBy(F.col("__id").alias("__did"), F.col("__th").alias("__dth")).agg(F.collect_set("__pos").alias("__drop"))
    # texts travel as their lines, split once below the join: an expression above it would be split anew for each line
    out = docs.select(*(F.col(n) for n in names.values() if n != t), F.col(i).alias("__id"), F.xxhash64(t).alias("__th"), F.split(t, "\n").alias("__lines"))
    out = out.join(drop, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    clean = F.array_join(F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.transform(kept, lambda i: F.element_at("__lines", i + 1))), "\n")
    more = {"n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")} if counts else {}
    return out.select(*((clean if c == text else F.col(n)).alias(c) for c, n in names.items() if c not in more), *(v.alias(k) for k, v in more.items()))
