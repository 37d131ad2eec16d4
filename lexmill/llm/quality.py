"""Quality by naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of neighbouring words and byte triples, each a 64-bit hash. The n-grams of the
model are those that at least `least` of the fitted rows hold (others tell no two rows apart, and a linear model gives those
it never saw no weight); each is a feature by itself, none shares a bin. An indicator is scaled by the feature's class
log-count ratio, log((a + good) / |a + good|) - log((a + bad) / |a + bad|), of document counts over all training rows; a row
is brought to length 1. On the scaled rows a linear model with hinge loss is fitted by dual coordinate descent, with costs
that even out the classes. The fit takes at most `sample` labelled rows (those of smallest hash of id and text): that bound
is a parameter, and bounds the model. A fifth of them isn't fitted but sets the logistic scale of the score.

Words are `[^\\x20\\x09-\\x0D]+`, as they are. Null and empty texts have no features: their score is that of margin 0. Without
training rows of both classes all scores are the share of good rows (0 without rows). Labels, language, source and id are no
inputs of a score. Rows that repeat are scored alike; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_slices
from .labels import held_out, labelled, logistic, probability, some_rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def ngrams(text: bytes | None) -> np.ndarray:
    """The n-grams of a text, words and pairs as often as they stand."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    triples = np.unique(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]).astype(np.uint64) | np.uint64(1 << 30)
    return np.concatenate([h, _mix(h[:-1] * np.uint64(3) + h[1:]), _mix(triples)]).view(np.int64)


class Vocabulary:
    """The n-grams of a model: sorted hashes; a feature is a place among them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The distinct features of a text in ascending order."""
        x = ngrams(text)
        if not len(x) or not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.unique(at[self.hashes[at] == x])


def vocabulary(sample: DataFrame, least: int) -> Vocabulary:
    def grams(batches):
        for b in batches:
            for _, t in text_slices(b, "__t"):
                x = np.unique(ngrams(t))
                for i in range(0, len(x), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)])], ["g"])

    got = sample.mapInArrow(grams, "g long").groupBy("g").count().where(F.col("count") >= least).select("g").toArrow()
    return Vocabulary(got.column("g").to_numpy())


def log_ratios(rows: DataFrame, words: Vocabulary, alpha: float) -> np.ndarray:
    """Of all rows; each task sums its rows' features in arrays and sends those it has seen."""
    shared, width = rows.sparkSession.sparkContext.broadcast(words), len(words.hashes)

    def count(batches):
        n = np.zeros((2, width), np.int64)
        for b in batches:
            for (_, t), y in zip(text_slices(b, "__t"), b.column("y").to_pylist(), strict=True):
                n[y, shared.value(t)] += 1
        at = np.nonzero(n.sum(0))[0]
        for i in range(0, len(at), 1 << 16):
            a = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(n[0, a]), pa.array(n[1, a])], ["f", "n0", "n1"])

    got = rows.mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # a row for each feature at most
    n = np.zeros((2, width))
    n[:, got.column("f").to_numpy()] = [got.column("n0").to_numpy(), got.column("n1").to_numpy()]
    n += alpha
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: np.ndarray, rounds: int, seed: int = 11, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hinge loss, |w|**2 / 2 + sum of cost * max(0, 1 - y * w.x), and the dual variables, 0 <= a <= cost, one
    of which is brought to its optimum at a time. x: (features, values) rows."""
    w, a = np.zeros(width), np.zeros(len(x))
    norm = np.array([v @ v for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            if norm[i] == 0:
                continue
            at, v = x[i]
            g = y[i] * (w[at] @ v) - 1
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            if new != a[i]:
                w[at] += (new - a[i]) * y[i] * v
                worst = max(worst, min(abs(g), abs(new - a[i]) * norm[i]))
                a[i] = new
        if worst < close:
            break
    return w, a


class Model:
    def __init__(self, words: Vocabulary, ratios: np.ndarray, weights: np.ndarray, scale: np.ndarray):
        self.words, self.ratios, self.weights, self.scale = words, ratios, weights, scale

    def margins(self, texts) -> np.ndarray:
        out = []
        for t in texts:
            f = self.words(t)
            v = self.ratios[f]
            size = np.sqrt(v @ v)
            out.append((self.weights[f] @ v) / size if size > 0 else 0.0)
        return np.array(out)

    def score(self, texts) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.scale[0])
        return probability(self.margins(texts)[:, None], self.scale) if len(texts) else np.zeros(0)


def train(rows: DataFrame, alpha: float = 1.0, sample: int = 6000, cost: float = 1.0, rounds: int = 50, least: int = 2) -> Model:
    """rows: doc_id, __t, y."""
    by_class = dict(rows.groupBy("y").count().collect())
    if len(by_class) < 2:
        return Model(Vocabulary(np.zeros(0, np.int64)), np.zeros(0), np.zeros(0), np.array([float(1 in by_class)]))
    some = some_rows(rows, sample, sum(by_class.values()))
    last = some.select("__h").orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
    some = stash(some.where(F.col("__h") <= F.lit(last)).limit(sample), "sample")  # rows of one hash are the same
    words = vocabulary(some, least)
    ratios = log_ratios(rows, words, alpha)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def features(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([pa.array([shared.value(t).astype(np.int32) for _, t in text_slices(part, "__t")], pa.list_(pa.int32())), part.column("y").cast(pa.int64()), part.column("__h")], ["f", "y", "h"])

    got = some.mapInArrow(features, "f array<int>, y long, h long").toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    feats = [np.asarray(f.values) for c in got.column("f").chunks for f in c]
    feats, y = [feats[i] for i in order], got.column("y").to_numpy()[order]
    x = []
    for f in feats:
        v = ratios[f]
        size = np.sqrt(v @ v)
        x.append((f, v / size if size > 0 else v * 0))
    sign = np.where(y > 0, 1.0, -1.0)
    share1 = np.clip(y.mean(), 0.01, 0.99)
    costs = np.where(y > 0, cost * 0.5 / share1, cost * 0.5 / (1 - share1))
    fold = np.arange(len(x)) % 5 == 0
    fit = np.nonzero(~fold)[0]
    if len(set(y[fold])) < 2 or len(set(y[fit])) < 2:
        fold[:] = True
        fit = np.arange(len(x))
    w, _ = dual_descent([x[i] for i in fit], sign[fit], len(words.hashes), costs[fit], rounds)
    rest = np.nonzero(fold)[0]
    scale = logistic(np.array([[w[x[i][0]] @ x[i][1]] for i in rest]), y[rest].astype(float))
    return Model(words, ratios, w, scale)


def score_documents(docs: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score([t for _, t in text_slices(b, "__t")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__t")).mapInArrow(run, "doc_id long, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    return labelled(docs, labels, "quality", id_, text, ~held_out(id_, 5, 0))
