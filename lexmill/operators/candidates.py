"""Alternatives to a target word: look-alikes by blocked similarity, deterministic walks through a pool, ranked unions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S

#: Endings of scholarly nouns.
SCHOLARLY = ("ics", "ist", "ism", "ship", "ware", "type", "ology", "archy", "cracy")
#: Fraction of a pool by which a walk steps.
GOLDEN = 0.6180339887


def sounded(words: DataFrame) -> DataFrame:
    """word and what the blocks and scores need of it, computed once for each word."""
    w = F.col("word")
    return words.select(*words.columns, S.consonant_skeleton(w).alias("skel"), S.rhyme_tail(w).alias("rhyme"), S.syllables(w).alias("syl"))


def blocks(s: DataFrame) -> DataFrame:
    """A row for each block of a word: first three letters, second to fourth letter, consonant skeleton, rhyme, ending."""
    w, n = F.col("word"), F.length("word")
    named = [F.when(F.length("skel") >= 3, F.concat(F.lit("k:"), "skel")), F.when(F.length("rhyme") >= 3, F.concat(F.lit("r:"), "rhyme")), F.when(n >= 6, F.concat(F.lit("e:"), F.substring(w, n - 3, F.lit(4))))]
    named += [F.when(F.endswith(w, F.lit(x)) & (n >= len(x) + 2), F.lit(f"a:{x}")) for x in SCHOLARLY]
    named += [F.concat(F.lit(f"{i}:"), F.substring(w, F.lit(i), F.lit(3))) for i in (1, 2)]
    return s.select("*", F.explode(F.array_compact(F.array(*named))).alias("block"))


#: What counts for how much in the score of a look-alike.
NEAR, CLOSE, PREFIX, SUFFIX, GAP, SKELETON, SAME_BEAT, RHYME, CONTAINED, LEARNED, LEARNED_BEAT = 45, 26, 4, 2, 2, 18, 14, 12, 30, 44, 4
#: Targets of a block that are compared in one group, and pairs that are compared at once.
SLICE, AT_ONCE = 1024, 2**18
NONE = np.iinfo(np.int32).min


def within_two(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of words, 3 and more standing for more than 2: rows of character codes, and lengths that differ
    by 2 at most. Only places up to 2 from the diagonal matter."""
    a, b, far = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.uint8(9)
    out = np.where(la == 0, lb, 9).astype(np.uint8)
    prev = [np.full(len(la), d, np.uint8) for d in (9, 9, 0, 1, 2)]
    for i in range(1, int(la.max(initial=0)) + 1):
        now = []
        for k in range(5):
            j = i + k - 2
            if j < 1 or j > len(b):
                now.append(np.full(len(la), i if j == 0 else far, np.uint8))
                continue
            d = prev[k] + (a[i - 1] != b[j - 1])
            if k < 4:
                d = np.minimum(d, prev[k + 1] + np.uint8(1))
            now.append(np.minimum(d, now[k - 1] + np.uint8(1)) if k else d)
        prev = now
        for k in range(5):
            np.copyto(out, now[k], where=(la == i) & (lb - la == k - 2))
    return out


def word_codes(words: np.ndarray) -> dict[str, np.ndarray]:
    """Of each word its length, its characters' codes from the front and from the back (0 beyond it), and as bits which
    characters it has an odd number of times, by code mod 64."""
    width = words.dtype.itemsize // 4
    codes, n = words.view(np.uint32).reshape(len(words), width), np.char.str_len(words).astype(np.int32)
    at = n[:, None] - 1 - np.arange(width)
    back = np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), 0)
    bits = np.where(codes > 0, np.left_shift(np.uint64(1), codes.astype(np.uint64) % np.uint64(64)), np.uint64(0))
    small = np.uint8 if codes.max(initial=0) < 256 else np.uint32
    return {"n": n, "codes": codes.astype(small), "back": back.astype(small), "odd": np.bitwise_xor.reduce(bits, axis=1)}


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal leading characters, each row of codes with each."""
    same, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        same &= a[:, k, None] == b[None, :, k]
        if not same.any():
            break
        out += same
    return out


def pair_scores(f: dict[str, np.ndarray], t: np.ndarray, c: np.ndarray, widest: int) -> np.ndarray:
    """Scores of each target (rows t of f) with each word (rows c); NONE where the pair isn't a look-alike, is a word with
    itself or differs in length by more than `widest`."""
    of = lambda k: (f[k][t][:, None], f[k][c][None, :])
    (la, lb), (oa, ob), (ra, rb), (ka, kb), (ea, eb), (ya, yb) = map(of, ("n", "odd", "rhyme", "skel", "ends", "syl"))
    gap, beats = np.abs(la - lb), np.abs(ya - yb)
    pref, suff = common(f["codes"][t], f["codes"][c]), common(f["back"][t], f["back"][c])
    may = (gap <= widest) & ~((gap == 0) & (pref >= la))
    one = may & (gap <= 1) & (pref + suff >= np.maximum(la, lb) - 1)
    two = np.zeros(may.shape, bool)
    i, j = np.nonzero(may & ~one & (gap <= 2) & (np.bitwise_count(oa ^ ob) <= 4))  # an edit changes the parity of two characters at most
    two[i, j] = within_two(f["codes"][t[i]], f["codes"][c[j]], f["n"][t[i]], f["n"][c[j]]) == 2
    near, skel, rhyme = one | two, (ka == kb) & (ka >= 0) & (gap <= 2), ra == rb
    contains = (np.minimum(la, lb) >= 5) & (gap <= 3) & (suff >= np.minimum(la, lb)) & rhyme
    scholarly = ((ea & eb) > 0) & (beats <= 2)
    rhymes = (rhyme & f["long_rhyme"][t][:, None] & near) | contains
    hit = near | skel | rhymes | scholarly | ((pref >= 4) & (la >= 6)) | ((pref >= 3) & (suff >= 2))
    hit &= may & (gap <= np.where(scholarly, 4, 3))
    score = one * NEAR + two * CLOSE + pref * PREFIX + suff * SUFFIX - ~scholarly * gap * GAP + skel * np.where(near, SKELETON, (beats == 0) * SAME_BEAT)
    score += (rhymes & (beats == 0)) * RHYME + contains * CONTAINED + scholarly * (LEARNED + (beats <= 1) * LEARNED_BEAT)
    return np.where(hit, score, NONE).astype(np.int32)


def best_of_groups(rows: pd.DataFrame, count: int) -> pd.DataFrame:
    """target, word, score: for each target of each group (block and slice) its best look-alikes there, by score, then word.
    Rows come by group, then words before targets (asked), then by word."""
    words = rows["word"].to_numpy().astype(str)
    f = word_codes(words) | {"syl": rows["syl"].to_numpy(np.int32), "rhyme": pd.factorize(rows["rhyme"])[0], "long_rhyme": rows["rhyme"].str.len().to_numpy() >= 3}
    f["skel"] = np.where(rows["skel"].to_numpy() == "", -1, pd.factorize(rows["skel"])[0])
    f["ends"] = sum((np.char.endswith(words, x).astype(np.int32) << i for i, x in enumerate(SCHOLARLY)))
    asked, block = rows["asked"].to_numpy(bool), rows["block"].to_numpy()
    begins = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (rows["slice"].to_numpy()[1:] != rows["slice"].to_numpy()[:-1])])
    found = []
    for begin, end in zip(begins, np.r_[begins[1:], len(rows)], strict=True):
        at = np.arange(begin, end)
        c, t = at[~asked[begin:end]], at[asked[begin:end]]
        step = max(1, AT_ONCE // max(1, len(c)))
        for k in range(0, len(t) if len(c) else 0, step):
            part = t[k : k + step]
            score, each = pair_scores(f, part, c, 3 if block[begin][:2] in ("1:", "2:") else 4), np.arange(len(part))
            for _ in range(count):
                best = score.argmax(axis=1)  # of equal ones the first, which is the first by word
                value = score[each, best]
                ok = value > NONE
                found.append((words[part[ok]], words[c[best[ok]]], value[ok]))
                score[each, best] = NONE
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.array([], str), np.array([], str), np.array([], np.int32)]
    return pd.DataFrame({"target": cols[0].astype(object), "word": cols[1].astype(object), "score": cols[2]})


def lookalikes(targets: DataFrame, pool: DataFrame, count: int = 3) -> DataFrame:
    """target, word, score, place: the best look-alikes of each target, by score, then word. A similarity join by shared
    blocks: as the score of a pair is the same in each block, the best of each block are enough, and pairs don't leave the
    task that compares them. The targets of a crowded block are dealt to slices, each with all words of the block."""
    own, every = (blocks(sounded(d.select("word").distinct())) for d in (targets, pool))
    sizes = own.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    asked = own.join(sizes, "block").select("*", F.pmod(F.xxhash64("word"), "slices").alias("slice"), F.lit(True).alias("asked"))
    words = every.join(sizes, "block").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asked"))
    parts = 16 * targets.sparkSession.sparkContext.defaultParallelism
    rows = asked.unionByName(words).drop("slices").repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", "asked", "word")

    def best(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held and tuple(held[-1][["block", "slice"]].iloc[-1]) == tuple(b[["block", "slice"]].iloc[-1]):
                held.append(b)  # one group goes on throughout
                continue
            last = (b["block"] == b["block"].iloc[-1]) & (b["slice"] == b["slice"].iloc[-1])
            yield best_of_groups(pd.concat([*held, b[~last]], ignore_index=True), count)
            held = [b[last]]
        if held:
            yield best_of_groups(pd.concat(held, ignore_index=True), count)

    scored = rows.mapInPandas(best, "target string, word string, score int").groupBy("target", "word").agg(F.max("score").alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "word"))).where(F.col("place") <= count)


def step_of(n: int) -> int:
    """The stride of a walk through a pool of n words: the golden part of n, raised until it is coprime to n."""
    step = int(n * GOLDEN) or 1
    while math.gcd(step, n) != 1:
        step += 1
    return step


def pool_walk(targets: DataFrame, pool: DataFrame, count: int = 3) -> DataFrame:
    """target, word, turn: words of a target's bucket in the order of a golden-stride walk from crc32(target) on, without
    the target itself. The turn of a place is a matter of arithmetic, so the walk needs no loop: the first `count + 1` places
    are computed and joined. The stride is computed once for each bucket. targets: target, bucket; pool: bucket, word."""
    places = pool.distinct().withColumn("p", F.row_number().over(Window.partitionBy("bucket").orderBy("word")) - 1)

    @F.pandas_udf("long")
    def stride(n: pd.Series) -> pd.Series:
        return n.map(step_of)

    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("step", stride("n"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(count + 1)).cast("int") - 1)).alias("k")
    turns = targets.join(sizes, "bucket").select("target", "bucket", "n", "step", k)
    turns = turns.select("target", "bucket", F.col("k").alias("turn"), ((F.crc32("target") % F.col("n") + F.col("k") * F.col("step")) % F.col("n")).cast("int").alias("p"))
    hit = turns.join(places, ["bucket", "p"]).where(F.col("word") != F.col("target"))
    return hit.withColumn("turn", F.row_number().over(Window.partitionBy("target").orderBy("turn"))).where(F.col("turn") <= count).select("target", "word", "turn")


def pair_distances(targets: DataFrame, pool: DataFrame, letters: int = 3, slices: int = 16) -> DataFrame:
    """target, word, pref, suff, dist: each target with each other word of the pool that begins with the same letters; lengths
    of common prefix and suffix, edit distance up to 2, else 99. All pairs come out. The targets of a prefix are dealt to
    `slices` parts, with its words in each, so that a frequent prefix isn't one task; what the comparison needs of a word is
    computed before the join."""
    part = F.pmod(F.xxhash64("word"), F.lit(slices)).alias("part")
    parts = max(slices * 4, targets.sparkSession.sparkContext.defaultParallelism * 4)
    of = [S.packed(F.col("word")).alias("p"), S.packed(F.reverse("word")).alias("r"), F.reverse("word").alias("back"), F.substring("word", 1, letters).alias("head")]
    t = targets.select(F.col("word").alias("target"), part, *of).repartition(parts, "head", "part").alias("t")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("part")
    w = pool.select("word", *of).select("*", each).repartition(parts, "head", "part").alias("w")
    j = t.hint("shuffle_hash").join(w, (F.col("t.head") == F.col("w.head")) & (F.col("t.part") == F.col("w.part")) & (F.col("target") != F.col("word")))
    p, r = ((F.col(f"t.{k}"), F.col(f"w.{k}")) for k in ("p", "r"))
    return j.select("target", "word", S.packed_prefix(*p, F.col("target"), F.col("word")).alias("pref"), S.packed_prefix(*r, F.col("t.back"), F.col("w.back")).alias("suff"), S.packed_distance(*p, F.col("target"), F.col("word")).alias("dist"))


def nearest_by_prefix(targets: DataFrame, pool: DataFrame, letters: int, most: int) -> DataFrame:
    """target, word, ord: of the pool's words that share a target's first letters, those of the nearest length, then first by
    word; ord is the difference in length. At least `most` of them, or all there are, the target itself among them. They
    depend on the target's length and letters alone, so they are found once for all targets of the same, from the first
    `most` words of each length: pairs of words don't arise."""
    key = lambda c: [F.substring(c, 1, letters).alias("head"), F.length(c).alias("n")]
    first = lambda *order: F.row_number().over(Window.partitionBy("head", "n").orderBy(*order)) <= most
    of = pool.select("word", *key("word")).distinct().withColumn("first", first("word")).where("first").select("head", F.col("n").alias("length"), "word")
    t = targets.select("target", *key("target"))
    near = t.select("head", "n").distinct().join(of, "head").withColumn("ord", F.abs(F.col("n") - F.col("length")))
    near = near.withColumn("first", first("ord", "word")).where("first").drop("first", "length")
    return t.join(near, ["head", "n"]).select("target", "word", "ord")


def ranked_union(tiers: list[DataFrame], banned: DataFrame | None = None, count: int = 3) -> DataFrame:
    """target, word, tier, place: candidates of several tiers (target, word, ord), the lowest tier of a word counting, without
    banned pairs (target, word); by tier, then order, then word."""
    every = None
    for i, d in enumerate(tiers):
        d = d.select("target", "word", F.lit(i).alias("tier"), "ord")
        every = d if every is None else every.unionByName(d)
    g = every.where("target <> word").groupBy("target", "word").agg(F.min(F.struct("tier", "ord")).alias("b"))
    if banned is not None:
        g = g.join(banned.select("target", "word").distinct(), ["target", "word"], "left_anti")
    order = Window.partitionBy("target").orderBy("b.tier", "b.ord", "word")
    return g.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select("target", "word", F.col("b.tier").alias("tier"), "place")
