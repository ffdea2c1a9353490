"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z) and cut at white space; its features are the n-grams of 3 to
5 characters (code points) of each word, its ends marked, hashed to ``FEATURES`` buckets.
A feature's value is log(1 + count) over the norm of all of the text's values, times the
feature's ratio r = log((p + a) / (P + a)) - log((q + b) / (Q + b)): p of the P toxic and
q of the Q clean training texts have it, and a : b = P : Q, so that a feature never seen
has ratio 0. Logistic regression over these values, both classes weighing the same, gives the weights.

Training reads labelled rows alone, and of them a bounded sample, by least hash of the
key: ``MOST_TOXIC`` and ``MOST_CLEAN`` texts, ``MOST_CHARS`` code points together; a text
that doesn't fit is left out, and later ones still are taken. One task fits the weights
of the features with a ratio beyond ``LEAST_RATIO``; the driver gets these alone. Scoring
reads every text whole, with a model of one number for each bucket, whatever the corpus.

Defined cases: null and empty texts have no features and the score of the bias alone;
a key with several labels is toxic if one says so; null labels are left out; without a
label of each kind nothing can be learnt, and every text scores 0; repeated rows each
get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .shingles import U, bounded_batches

LOG = 20
FEATURES = 1 << LOG
SIZES = (3, 4, 5)
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 4096, 6144, 32_000_000
LEAST_RATIO = 0.1
_PART = 1 << 20
#: Code points that are hashed at once.
_BLOCK = 1 << 17


def _grams(points: np.ndarray, starts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size the n-grams that begin at one of the first ``starts`` code points: their places and buckets."""
    b = points.astype(U)
    b[(b >= 65) & (b <= 90)] += U(32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    b[space] = 32
    spaces = np.concatenate([[0], np.cumsum(space)])
    h, at, buckets = np.zeros(len(b), U), [], []
    for n in range(1, max(SIZES) + 1):
        h = h[: len(b) - n + 1] * U(0x100000001B3) + b[n - 1 :] + U(1)
        if n in SIZES:
            # Only the ends of an n-gram may be space, and not all of the rest.
            own = np.flatnonzero(spaces[n - 1 : len(b)] == spaces[1 : len(b) - n + 2])
            own = own[: np.searchsorted(own, starts)]
            x = h[own] * U(0x9E3779B97F4A7C15)
            at.append(own)
            buckets.append((((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(64 - LOG)).astype(np.int32))
    return at, buckets


def _tally(buckets: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order, each once, and the sums of their counts."""
    own, n = np.concatenate(buckets), np.concatenate(counts)
    order = np.argsort(own, kind="stable")
    own, n = own[order], n[order]
    edge = np.flatnonzero(np.diff(own, prepend=-1))
    return own[edge], np.add.reduceat(n, edge) if len(edge) else n


def counted(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its features' buckets, in order, and their counts.

    Short texts are hashed several at a time; a long one by blocks of places where
    n-grams begin, so that memory beside the texts is bounded.
    """
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") < _BLOCK):
            size += len(texts[high] or "") + 1
            high += 1
        part = [f" {t or ''}" for t in texts[low:high]]
        points = np.frombuffer(("".join(part) + " " * max(SIZES)).encode("utf-32-le", "surrogatepass"), np.uint32)
        # An n-gram belongs to the text of its second character.
        offset = np.concatenate([[0], np.cumsum([len(t) for t in part])]) - 1
        found: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []) for _ in part]
        for a in range(0, size, _BLOCK):
            for at, buckets in zip(*_grams(points[a : a + _BLOCK + max(SIZES)], _BLOCK), strict=True):
                edges = np.searchsorted(at + a, offset)
                for i, (mine, n) in enumerate(found):
                    if edges[i] < edges[i + 1]:
                        own = np.sort(buckets[edges[i] : edges[i + 1]])
                        edge = np.flatnonzero(np.diff(own, prepend=-1))
                        mine.append(own[edge])
                        n.append(np.diff(edge, append=len(own)))
            if size > _BLOCK:
                found = [(([x[0]], [x[1]]) if len(mine) > 1 and (x := _tally(mine, n)) else (mine, n)) for mine, n in found]
        for mine, n in found:
            yield _tally(mine, n) if mine else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        low = high


def values(counts: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    return v / np.sqrt((v * v).sum()) if len(v) else v


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        for toxic, (buckets, _) in zip(batch.column("toxic").to_pylist(), counted(batch.column("text").to_pylist()), strict=True):
            (p if toxic else q)[buckets] += 1
    some = np.flatnonzero(p + q)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(p[some]), pa.array(q[some])], names=["f", "p", "q"])


def _fitted(ratio):
    """The whole sample, in order, to one row: indices of the weighted buckets, their weights, the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratio.value
        used = np.flatnonzero(r)
        place = (np.cumsum(r != 0) - 1).astype(np.int32)
        y, f, v = [], [], []
        for batch in batches:
            y += batch.column("toxic").to_pylist()
            for buckets, counts in counted(batch.column("text").to_pylist()):
                x = values(counts)
                keep = r[buckets] != 0
                f.append(place[buckets[keep]])
                v.append((x[keep] * r[buckets[keep]]).astype(np.float32))
        sizes = np.array([len(x) for x in f], np.int64)
        # One after the other, so that no more than one of them is held twice.
        f = np.concatenate(f)
        v = np.concatenate(v)
        weights, bias = fit(np.array(y, np.float64), sizes, f, v, len(used))
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32)]), pa.array([(weights * r[used]).astype(np.float32)]), pa.array([bias])], names=["f", "w", "bias"])

    return run


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """The bounded sample (toxic, text) of labelled documents."""
    said = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    # All rows of a key are taken together or not at all.
    known = docs.select(F.col(key), F.length(text).alias("n")).join(said, key).groupBy(key, "toxic").agg(F.sum("n").alias("n"))
    narrow = known.where(F.col("n").between(1, MOST_CHARS)).select(key, "n", "toxic", F.xxhash64(key).alias("h"))
    order = [F.col("h"), F.col(key)]
    rows = [r for toxic, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)) for r in narrow.where(F.col("toxic") == toxic).orderBy(*order).limit(most).collect()]
    taken, chars = [], 0
    for r in sorted(rows, key=lambda r: (r["h"], r[key])):
        if chars + r["n"] > MOST_CHARS:
            continue
        chars += r["n"]
        taken.append((r[key], r["toxic"], r["h"]))
    # MOST_TOXIC + MOST_CLEAN keys at most.
    chosen = docs.sparkSession.createDataFrame(taken, f"{key} {docs.schema[key].dataType.simpleString()}, toxic int, h long")
    return scratch.save(docs.select(key, text).join(F.broadcast(chosen), key).select("toxic", "h", F.col(text).alias("text")), "labelled")


def fit(y: np.ndarray, sizes: np.ndarray, f: np.ndarray, v: np.ndarray, n: int, epochs: int = 80, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of n features and the bias: logistic regression by Adam over all texts at once.

    Text i has label y[i] and sizes[i] of the features (f, v). Sums run over a few texts at
    a time, so that little is held besides f and v.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cuts = sorted({*np.searchsorted(starts, np.arange(0, starts[-1], _PART)).tolist(), len(y)})
    parts = [(a, b, slice(starts[a], starts[b])) for a, b in zip(cuts, cuts[1:])]
    scale = np.sqrt(sum(np.square(v[p], dtype=np.float64).sum() for _, _, p in parts) / len(y)) or 1.0
    w, m, s = (np.zeros(n + 1) for _ in range(3))
    each = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for e in range(1, epochs + 1):
        grad = np.append(ridge * w[:-1], 0.0)
        for a, b, p in parts:
            of = np.repeat(np.arange(b - a), sizes[a:b])
            z = np.bincount(of, weights=v[p] * w[f[p]], minlength=b - a) / scale + w[-1]
            g = each[a:b] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[a:b])
            grad[:-1] += np.bincount(f[p], weights=v[p] * g[of], minlength=n) / scale
            grad[-1] += g.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**e)) / (np.sqrt(s / (1 - 0.99**e)) + 1e-9)
    return w[:-1] / scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float] | None:
    """The model: a weight for each bucket (its ratio included) and the bias; None if nothing can be learnt."""
    bounded_batches(docs.sparkSession)
    labelled = sample(docs, labels, key, text, label)
    size = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    toxic, clean = size[1], size[0]
    smooth = min(100.0, max(2.0, (toxic + clean) / 25))
    a, b = smooth * toxic / (toxic + clean), smooth * clean / (toxic + clean)
    seen = labelled.mapInArrow(_presence, "f int, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    value = F.log((F.col("p") + a) / (toxic + a)) - F.log((F.col("q") + b) / (clean + b))
    # FEATURES rows at most; those that say little stay behind.
    telling = seen.select("f", value.cast("float").alias("r")).where(F.abs("r") >= LEAST_RATIO).toArrow()
    ratio = np.zeros(FEATURES, np.float32)
    ratio[telling.column("f").to_numpy()] = telling.column("r").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    # One task has the whole sample, which is bounded; the driver gets a weight for each bucket.
    whole = labelled.coalesce(1).sortWithinPartitions("h", "toxic", "text").mapInArrow(_fitted(shared), "f array<int>, w array<float>, bias double").toArrow()
    shared.destroy()
    weights = np.zeros(FEATURES, np.float32)
    weights[whole.column("f").combine_chunks().flatten().to_numpy()] = whole.column("w").combine_chunks().flatten().to_numpy()
    return weights, whole.column("bias")[0].as_py()


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            z = np.array([float((values(c) * weights[f]).sum()) for f, c in counted(texts)]) + bias
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != 1], pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], names=[*[n for i, n in enumerate(batch.schema.names) if i != 1], "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, key: str = "doc_id", text: str = "text", at: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, ``keep``, score (0 to 1) and predicted (1 from ``at``)."""
    bounded_batches(docs.sparkSession)
    if model is None:
        scored = docs.select(key, *keep, F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        named = docs.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
        kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
        scored = named.mapInArrow(_scored(shared), f"_id {docs.schema[key].dataType.simpleString()}{kinds}, score double").select(F.col("_id").alias(key), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "score")
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(key.cast("string")) % 3 == 1
