"""URL filters with a sorted digest array.

The rules (host, path prefix, verdict) become one file: the rules' 64-bit XXH64 keys in ascending order, their verdicts,
and the rule strings. Spark copies the file to each executor, where every Python worker maps it into memory, so that
all workers of a machine share its pages. A url is probed with the strings (last k labels of its host + first n
characters of its path), for those (k, n) alone that occur in the rules, the longest host first and then the longest
path: vectorised binary search over the keys, then comparison with the stored string, so that a collision of keys can't
give a verdict. Nothing is shuffled; a common host costs nothing extra. Rule sets above `max_rules` aren't put into a
file: `filter_urls_joined` probes the same candidates with a shuffled join on the key, confirmed by the string.

Null urls and urls without "://": host and path are empty, no rule fits, the verdict is the method's own ("allow",
as the list holds exceptions to it). Repeated rows are judged one by one. Rules that repeat: the last one holds. A
path that is shorter than a rule's, the empty one included, doesn't start with it.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_file

SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_col(url: str):
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_col(url: str):
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_file(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The sorted digest array of rules (verdict, host, path) as the bytes of one file."""
    last = {(h, p): v for v, h, p in rules}
    verdicts = sorted(set(last.values()))
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode(), SEED), h + p, verdicts.index(v)) for (h, p), v in last.items())
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in last}, reverse=True)
    texts = [r[1].encode() for r in rows]
    head = json.dumps({"n": len(rows), "verdicts": verdicts, "shapes": shapes}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    ends = np.cumsum([0, *map(len, texts)]).astype("<u8")
    keys = np.array([r[0] for r in rows], dtype="<u8")
    return struct.pack("<Q", len(head)) + head + keys.tobytes() + ends.tobytes() + np.array([r[2] for r in rows], dtype="u1").tobytes() + b"".join(texts)


class DigestArray:
    """A digest file mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = struct.unpack_from("<Q", self.map)[0]
        head = json.loads(self.map[8 : 8 + size])
        n, at = head["n"], 8 + size
        self.verdicts, self.shapes = head["verdicts"], head["shapes"]
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.ends = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        self.kinds = np.frombuffer(self.map, "u1", n, at + 8 * (2 * n + 1))
        self.text_at = at + 8 * (2 * n + 1) + n

    def rule(self, i: int) -> bytes:
        return self.map[self.text_at + int(self.ends[i]) : self.text_at + int(self.ends[i + 1])]

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """For each string the place of its rule, or -1."""
        out = np.full(len(texts), -1, np.int64)
        if not len(self.keys) or not texts:
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts))
        low = np.searchsorted(self.keys, keys, "left")
        high = np.searchsorted(self.keys, keys, "right")
        for i in np.nonzero(high > low)[0]:
            out[i] = next((j for j in range(low[i], high[i]) if self.rule(j) == texts[i]), -1)
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """For each url the place of the longest rule that fits it, or -1."""
        found = np.full(len(hosts), -1, np.int64)
        labels = [h.split(".") for h in hosts]
        for k, n in self.shapes:
            open_ = [i for i in np.nonzero(found < 0)[0] if len(labels[i]) >= k and len(paths[i]) >= n]
            found[open_] = self.probe([(".".join(labels[i][-k:]) + paths[i][:n]).encode() for i in open_])
        return found


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_rules: int = 5_000_000) -> DataFrame:
    """df with the columns host, path, rule and verdict (existing columns of these names give way). rules: (verdict,
    host, path); more than max_rules of them are joined as a table."""
    if len(rules) > max_rules:
        last = {(h, p): v for v, h, p in rules}
        return filter_urls_joined(df, df.sparkSession.createDataFrame([(v, h, p) for (h, p), v in last.items()], "verdict string, host string, path string"), url, default)
    data = digest_file(rules)
    name = f"urlrules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    put_file(df.sparkSession, name, data)
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    src = df.select(*(F.col(f"`{c}`") for c in kept), host_col(f"`{url}`").alias("host"), path_col(f"`{url}`").alias("path"))
    schema = src.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def judge(batches):
        index = DigestArray(SparkFiles.get(name))
        for b in batches:
            at = index.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            rule = pa.array([index.rule(i).decode() if i >= 0 else None for i in at], pa.string())
            verdict = pa.array([index.verdicts[index.kinds[i]] if i >= 0 else default for i in at], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    return src.mapInArrow(judge, schema)


def filter_urls_joined(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """As filter_urls for rule tables (verdict, host, path) of any size: the candidates of each distinct (host, path) meet
    the rules in a join on the key, and the stored strings confirm. Only the distinct (labels, length) shapes of the
    rules, which are few, go to the driver. Rows of a table have no order: of two verdicts of one rule the greater string holds
    (block before allow)."""
    text = F.concat("host", "path")
    last = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shaped = last.select(F.xxhash64(text).alias("__key"), text.alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("__k"), F.length("path").alias("__n"))
    shapes = [(r[0], r[1]) for r in shaped.select("__k", "__n").distinct().limit(10_001).collect()]
    if len(shapes) > 10_000:
        raise ValueError("rules with more than 10,000 shapes")
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    src = df.select(*(F.col(f"`{c}`") for c in kept), host_col(f"`{url}`").alias("host"), path_col(f"`{url}`").alias("path"))
    cand = [
        F.when((F.size(F.split("host", r"\.")) >= k) & (F.length("path") >= n), F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.concat(F.array_join(F.slice(F.split("host", r"\."), -k, k), "."), F.substring("path", 1, n)).alias("t")))
        for k, n in shapes
    ]
    probes = src.select("host", "path").distinct().select("host", "path", F.explode(F.array_compact(F.array(*cand) if cand else F.array().cast("array<struct<k:int,n:int,t:string>>"))).alias("c"))
    hit = probes.join(shaped, (F.xxhash64("c.t") == F.col("__key")) & (F.col("c.t") == F.col("rule")) & (F.col("c.k") == F.col("__k")) & (F.col("c.n") == F.col("__n")))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("__k", "__n")).alias("__b"))
    return src.join(best, ["host", "path"], "left").select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.col("__b.rule").alias("rule"), F.coalesce("__b.verdict", F.lit(default)).alias("verdict"))
