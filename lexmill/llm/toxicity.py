"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary labelled training documents, give each token a log-likelihood ratio. Both are
Kneser-Ney's distributions of words by continuation counts: a word counts as often as there are distinct words that it
follows in texts of the class, so that a document with a thousand copies counts as one. A class takes the discounted share
of a word and backs off to a count that both classes share, the distinct words that it follows in either: a word that is
rare or new says little, since both models end at the same count. Contexts are counted exactly, as distinct pairs of
neighbouring words, and no word or pair is left out, however rare. (A level of bigram probabilities above it was tried: it
ranks worse, as rare contexts then outweigh telling words; figures in the README.)

What is compared is normalised by length: the mean ratio of the whole text, and the mean of its one and of its two most
telling tokens, as an insult in a long text is one of few words. A logistic regression turns the three into a score. It is
fitted on training documents, at most `calibrate` of them (those of smallest hash of id and text), each scored without its own
contexts, so that its own rare words don't count as known.

Counts cover all training rows and grow with them. Pairs are made distinct by one shuffle, combined map-side; words are
counted from them by another. The words' counts are a written table. Up to MOST words it is broadcast; beyond, texts are
scored in groups, each joined with the rows of the table that it needs. Both ways give the same scores.

Words are runs of letters and digits after lower-casing A-Z. Null and empty texts have the neutral ratio 0, with its score.
Without training rows of both classes all scores are the share of toxic rows (0 without rows). Labels, language, source and
id are no inputs of a score. Rows that repeat are scored alike; columns of any name pass through `drop_toxic`.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stash, text_slices
from .labels import held_out, labelled, logistic, probability, some_rows

MOST = 1 << 22  # words up to which their counts are broadcast, 20 bytes each; beyond, the table is joined
DISCOUNT = 0.75
#: Bytes that part words: ASCII other than letters and digits.
BLANKS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document of each word)."""
    split = [t.lower().translate(BLANKS).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(sizes.sum())).view(np.int64), np.repeat(np.arange(len(split)), sizes)


def runs(batch, text: str = "__t", most: int = 1 << 22):
    """(first row, texts) of about `most` bytes."""
    start, out, size = 0, [], 0
    for i, t in text_slices(batch, text):
        out.append(t or b"")
        size += len(out[-1])
        if size >= most:
            yield start, out
            start, out, size = i + 1, [], 0
    if out:
        yield start, out


def before(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each word; 0 where a document begins."""
    out = np.zeros(len(h), h.dtype)
    same = doc[1:] == doc[:-1]
    out[1:][same] = h[:-1][same]
    return out


def distinct_pairs(v: np.ndarray, w: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The first place of each distinct combination."""
    if not len(w):
        return np.zeros(0, np.int64)
    order = np.lexsort((v, w, *more))
    new = np.zeros(len(w), bool)
    new[0] = True
    for x in (v, w, *more):
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    return np.sort(order[new])


def word_counts(rows: DataFrame) -> DataFrame:
    """w, c0, c1, c: the distinct words that w follows, by class and in both together. rows: __t, y."""

    def pairs(batches):
        for b in batches:
            ys = np.array(b.column("y").to_pylist(), np.int8)
            for start, texts in runs(b):
                h, doc = tokens(texts)
                v, y = before(h, doc), ys[start + doc]
                first = distinct_pairs(v, h, y)
                for i in range(0, len(first), 1 << 16):
                    at = first[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(h[at]), pa.array(y[at] + np.int8(1))], ["v", "w", "classes"])

    distinct = rows.mapInArrow(pairs, "v long, w long, classes tinyint").groupBy("v", "w").agg(F.bit_or("classes").alias("classes"))
    by_class = (F.count_if(F.col("classes").bitwiseAND(1 << y) > 0).alias(f"c{y}") for y in range(2))
    return stash(distinct.groupBy("w").agg(*by_class, F.count(F.lit(1)).alias("c")), "words")


class Whole:
    """What a model takes of all counts: sums of contexts by class and in both, and how many words have any."""

    def __init__(self, counts: DataFrame):
        one = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("c0", "c1", "c")), *(F.count_if(F.col(c) > 0) for c in ("c0", "c1", "c"))).first()
        self.total, self.kinds = np.array(one[:3], np.float64), np.array(one[3:], np.float64)
        self.words = int(one[5])


class KneserNey:
    """words: sorted hashes; counts: their rows (c0, c1, c), and a row of zeros for all other words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, whole: Whole):
        order = np.argsort(words)
        self.words, self.counts, self.whole = words[order], np.vstack([counts[order], np.zeros((1, 3))]).astype(np.float32), whole

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def ratios(self, h: np.ndarray, doc: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log-likelihood ratio of each token; with own (a class), as if this one document's contexts weren't in that class's
        counts (the shared counts, which favour neither class, stay as they are)."""
        c, total, kinds = self.counts[self.places(h)].astype(np.float64), self.whole.total.copy(), self.whole.kinds
        if own is not None and len(h):
            mine = h[distinct_pairs(before(h, doc), h)]
            kind, n = np.unique(mine, return_counts=True)
            n = n[np.searchsorted(kind, h)]
            c[:, own] = np.maximum(c[:, own] - n, 0)
            total[own] -= len(mine)
        total = np.maximum(total, 1)
        shared = (c[:, 2] + 1) / (total[2] + kinds[2] + 1)
        toxic, other = (np.maximum(c[:, y] - DISCOUNT, 0) / total[y] + max(min(1.0, DISCOUNT * kinds[y] / total[y]), 1e-9) * shared for y in (1, 0))
        return np.log(toxic) - np.log(other)


TOP = (1, 2)


def features(lm: KneserNey, h: np.ndarray, doc: np.ndarray, n: int, own: int | None = None) -> np.ndarray:
    """Mean ratio of each of n documents, and of its TOP most telling tokens (short texts filled up with neutral ones)."""
    x = np.zeros((n, 1 + len(TOP)))
    if not len(h):
        return x
    r = lm.ratios(h, doc, own)
    sizes = np.bincount(doc, minlength=n)
    x[:, 0] = np.bincount(doc, weights=r, minlength=n) / np.maximum(sizes, 1)
    starts = np.cumsum(sizes) - sizes
    some = np.nonzero(sizes)[0]
    for k in range(1, max(TOP) + 1):  # the highest, then the highest of what is left
        high = np.maximum.reduceat(r, starts[some])
        for i, most in enumerate(TOP):
            if k <= most:
                x[some, 1 + i] += np.where(np.isfinite(high), high, 0) / most
        at = np.nonzero(r == np.repeat(high, sizes[some]))[0]
        r[at[np.unique(doc[at], return_index=True)[1]]] = -np.inf
    return x


class Tables:
    """A model whose words are too many to be broadcast: their counts as a written table."""

    def __init__(self, words: DataFrame, whole: Whole):
        self.words, self.whole = words, whole

    def rows(self, docs: DataFrame) -> DataFrame:
        """__g, w, c0, c1, c: what the texts of each group need."""

        def words(batches):
            for b in batches:
                group = b.column("__g").to_numpy(zero_copy_only=False)
                for start, texts in runs(b):
                    h, doc = tokens(texts)
                    g = group[start + doc]
                    first = distinct_pairs(g, h)
                    for i in range(0, len(first), 1 << 16):
                        at = first[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(h[at])], ["__g", "w"])

        return docs.select("__g", "__t").mapInArrow(words, "__g long, w long").distinct().join(self.words, "w").select("__g", "w", "c0", "c1", "c")


def with_model(docs: DataFrame, lm: KneserNey | Tables | None, run, schema, group: int = 4096) -> DataFrame:
    """run(model, batches) over docs (with __t): with the broadcast model, or in groups of about `group` rows, each with the
    rows of the table that it needs. Both give the same."""
    if not isinstance(lm, Tables):
        shared = docs.sparkSession.sparkContext.broadcast(lm)
        return docs.mapInArrow(lambda it: run(shared.value, it), schema)
    whole, groups = lm.whole, max(1, docs.count() // group)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    g = docs.withColumn("__g", F.pmod(F.xxhash64(*hashed, F.rand(3)), F.lit(groups)))  # repeated rows are dealt too
    g = stash(g, "groups")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return wanted.empty_table()
        own = KneserNey(right.column("w").to_numpy(), np.stack([right.column(c).to_numpy() for c in ("c0", "c1", "c")], 1).reshape(-1, 3), whole)
        out = list(run(own, left.drop_columns(["__g"]).combine_chunks().to_batches()))
        return pa.Table.from_batches(out) if out else wanted.empty_table()

    return g.groupBy("__g").cogroup(lm.rows(g).groupBy("__g")).applyInArrow(one, schema)


class Model:
    def __init__(self, lm: KneserNey | Tables | None, weights: np.ndarray):
        self.lm, self.weights = lm, weights


def score(lm: KneserNey | None, weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    if lm is None:
        return np.full(len(texts), weights[0])
    h, doc = tokens(texts)
    return probability(features(lm, h, doc, len(texts)), weights)


def train(rows: DataFrame, calibrate: int = 8192) -> Model:
    """rows: doc_id, __t, y."""
    by_class = dict(rows.groupBy("y").count().collect())
    if len(by_class) < 2:
        return Model(None, np.array([float(1 in by_class)]))
    counts = word_counts(rows)
    whole = Whole(counts)
    lm: KneserNey | Tables = Tables(counts, whole)
    if whole.words <= MOST:
        got = counts.toArrow()
        lm = KneserNey(got.column("w").to_numpy(), np.stack([got.column(c).to_numpy() for c in ("c0", "c1", "c")], 1).reshape(-1, 3), whole)
        del got

    names = [f"x{j}" for j in range(1 + len(TOP))]

    def own_features(lm, batches):
        for b in batches:
            ys = b.column("y").to_pylist()
            x = np.zeros((b.num_rows, 1 + len(TOP)))
            for i, t in text_slices(b, "__t"):
                h, doc = tokens([t or b""])
                x[i] = features(lm, h, doc, 1, ys[i])[0]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j].copy()) for j in range(x.shape[1])), pa.array(ys, pa.int64()), b.column("__h")], [*names, "y", "__h"])

    some = some_rows(rows, calibrate, sum(by_class.values()))
    got = with_model(some, lm, own_features, ", ".join(f"{c} double" for c in names) + ", y long, __h long").orderBy("__h", *names, "y").limit(calibrate).toArrow()
    x, y = np.stack([got.column(c).to_numpy() for c in names], 1), got.column("y").to_numpy().astype(float)
    return Model(lm, logistic(x, y))


def score_documents(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted."""
    weights = model.weights

    def run(lm, batches):
        for b in batches:
            parts = [score(lm, weights, texts) for _, texts in runs(b)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return with_model(docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t")), model.lm, run, "doc_id long, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    return labelled(docs, labels, "toxic", id_, text, ~held_out(id_, 3, 1))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that the model rejects; all of them where training rows had one class, which tells nothing apart."""
    if model.lm is None:
        return docs
    weights, columns = model.weights, docs.columns
    own = {c: free_name(columns, f"__c{i}") for i, c in enumerate(columns)}  # names that can't clash with __t and __g
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col(f"`{text}`").alias("__t"))

    def keep(lm, batches):
        for b in batches:
            for start, texts in runs(b):
                ok = score(lm, weights, texts) < threshold
                part = b.slice(start, len(texts)).filter(pa.array(ok))
                if part.num_rows:
                    yield part.select(list(own.values()))

    kept = with_model(inner, model.lm, keep, inner.drop("__t").schema)
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))
