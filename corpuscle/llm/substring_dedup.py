"""Substring dedup by level-wise doubling.

A word goes if a window of ``length`` (50) consecutive words covers it whose sequence
also starts in a document with a smaller doc_id. To find these windows without moving
a row for every word of the corpus, candidates start short and double:

* Level 1, a quarter of the length (13 words): in each window of the full length, the
  quarter window with the least hash is picked. Equal full windows pick equal quarters,
  so nothing is lost, while only about one word in twenty starts a pick. Picks that
  occur in one document alone are dropped.
* Level 2, half the length (26): each surviving pick is extended to twice its length,
  to the left and to the right; every full window around it holds one of the two.
  Halves that occur in one document alone are dropped.
* Level 3, the full length: the full windows around surviving halves. Of each, the
  least doc_id is found, and the later documents get it back as repeated.

Texts whose word sequences are equal move as one: their least doc_id goes through the
levels, and what repeats in it repeats in the others, which repeat it entirely besides.
A sequence or a passage that a third of all documents share is counted by partial
aggregates and never gathered; documents get back only hashes of their own windows.

Full windows are told apart by 128 bits. Defined cases: a null or blank text has no
words and is kept as it is; rows of one doc_id and different texts are separate texts
that never outdate each other; a null doc_id neither loses words nor outdates any; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .shingles import U, Words, bounded_batches, portions, signed

SECOND = 0x1234567


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` neighbours, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def picks(words: Words, length: int) -> np.ndarray:
    """Starts of the quarter windows that some full window picks."""
    quarter = -(-length // 4)
    n = len(words.hash)
    if n < length:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    hashes = words.windows(quarter)
    whole = owner[: n - length + 1] == owner[length - 1 :]
    span = length - quarter + 1
    least = np.where(whole, _sliding(hashes, span, np.minimum), U(0))
    # A start is picked if one of the full windows that hold it has its hash as the least.
    pad = np.zeros(span - 1, U)
    best = _sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    return np.flatnonzero((hashes == best) & (best > 0))


def _level1(length: int):
    quarter, half = -(-length // 4), 2 * -(-length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in portions(texts):
                words = Words(texts[low:high])
                at = picks(words, length)
                own = np.searchsorted(words.first, at, side="right") - 1
                n = len(words.hash)
                q, h = words.windows(quarter), words.windows(half)
                # Extensions beyond the text do not exist: null.
                right, left = at, at - (half - quarter)
                has_r = right + half <= words.first[own + 1]
                has_l = left >= words.first[own]
                r = pa.array(signed(h[np.where(has_r, right, 0)]) if len(h) else np.zeros(len(at), np.int64), mask=~has_r)
                l_ = pa.array(signed(h[np.where(has_l, left, 0)]) if len(h) else np.zeros(len(at), np.int64), mask=~has_l)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][own]), pa.array(signed(q[at]) if n else np.zeros(0, np.int64)), l_, r], names=["id", "q", "l", "r"])

    return run


def _around(words: Words, i: int, quarter: int, length: int, halves: set[int], every: np.ndarray) -> np.ndarray:
    """Starts of the full windows of text i that hold a surviving half."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    half = 2 * quarter
    if b - a < length:
        return np.zeros(0, np.int64)
    mine = np.isin(every[a : b - half + 1], np.fromiter(halves, np.int64, len(halves)))
    hit = np.flatnonzero(mine)
    cover = np.zeros(b - a - length + 2, np.int64)
    lo = np.maximum(hit - (length - half), 0)
    hi = np.minimum(hit, b - a - length)
    good = lo <= hi
    np.add.at(cover, lo[good], 1)
    np.add.at(cover, hi[good] + 1, -1)
    return a + np.flatnonzero(np.cumsum(cover)[:-1] > 0)


def _level3(length: int):
    quarter = -(-length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            halves = batch.column("halves").to_pylist()
            for low, high in portions(texts):
                words = Words(texts[low:high])
                every = signed(words.windows(2 * quarter))
                one, two = words.windows(length), words.windows(length, SECOND)
                out_id, out_1, out_2 = [], [], []
                for i in range(high - low):
                    at = _around(words, i, quarter, length, set(halves[low + i]), every)
                    if len(at):
                        # A window that a text repeats counts once.
                        _, once = np.unique(one[at], return_index=True)
                        at = at[once]
                        out_id.append(np.full(len(at), ids[low + i], np.int64))
                        out_1.append(one[at])
                        out_2.append(two[at])
                if out_id:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(signed(np.concatenate(out_1))), pa.array(signed(np.concatenate(out_2)))], names=["id", "h1", "h2"])

    return run


def removed(words: Words, i: int, length: int, gone: list[int] | None, whole: bool, every: np.ndarray) -> np.ndarray:
    """Which words of text i go."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    out = np.zeros(b - a, bool)
    if b - a < length:
        return out
    if whole:
        return ~out
    if gone:
        hit = np.flatnonzero(np.isin(every[a : b - length + 1], np.array(gone, np.int64)))
        edge = np.zeros(b - a + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
        out = np.cumsum(edge)[:-1] > 0
    return out


def _cut(length: int, give_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            gone, whole = batch.column("gone").to_pylist(), batch.column("whole").to_pylist()
            for low, high in portions(texts):
                words = Words(texts[low:high])
                any_ = any(gone[low:high])
                every = signed(words.windows(length)) if any_ else np.zeros(0, np.int64)
                n, cut, kept = [], [], []
                for i in range(high - low):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    off = removed(words, i, length, gone[low + i], whole[low + i], every)
                    n.append(b - a)
                    cut.append(int(off.sum()))
                    text = texts[low + i]
                    if give_text:
                        kept.append(_without(words, i, off, text) if cut[-1] else text)
                    else:
                        rest = b" ".join(text.split()) if text and not cut[-1] else b" ".join(words.data[s:e] for s, e, o in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), off.tolist(), strict=True) if not o)
                        kept.append(hashlib.sha256(rest).hexdigest().encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *[batch.column(c).slice(low, high - low) for c in batch.schema.names if c not in ("id", "text", "gone", "whole")]],
                    names=["id", "n_words", "n_removed", "kept", *[c for c in batch.schema.names if c not in ("id", "text", "gone", "whole")]],
                )

    return run


def _without(words: Words, i: int, off: np.ndarray, text: bytes) -> bytes:
    """The text without its removed words; what stands between kept neighbours stays as it is."""
    a, b, base = int(words.first[i]), int(words.first[i + 1]), int(words.offset[i])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~off).astype(np.int8), [0]])))
    runs = [text[words.start[a + x] - base : words.end[a + y - 1] - base] for x, y in edge.reshape(-1, 2)]
    return b"\n".join(runs)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        marks = [hashlib.blake2b(b" ".join((t or b"").split()), digest_size=16).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["id", "mark"])


def repeated(docs: DataFrame, key: str, text: str, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """(id, gone: hashes of the windows that also start in a smaller doc_id) and (id, mark) of texts that repeat a smaller one."""
    bounded_batches(docs.sparkSession)
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    marks = scratch.save(body.mapInArrow(_sequences, "id long, mark binary"), "marks")
    firsts = scratch.save(marks.groupBy("mark").agg(F.min("id").alias("first"), F.max("id").alias("_top")).where("first < _top").select("mark", "first"), "firsts")
    copies = scratch.save(marks.join(firsts, "mark").where("id > first").select("id", "mark", "first").distinct(), "copies")
    # A doc_id with several texts stays a text of its own for each; its copies of others go through the levels too.
    lone = marks.groupBy("id").agg(F.max("mark").alias("_a"), F.min("mark").alias("_b")).where("_a = _b").select("id")
    skip = copies.join(lone, "id", "left_semi").select("id").distinct()
    reps = body.join(skip, "id", "left_anti")

    one = scratch.save(reps.mapInArrow(_level1(length), "id long, q long, l long, r long"), "quarters")
    # Saved, so that the join below has plain exchanges on both sides and a hot key can be split.
    often = scratch.save(one.groupBy("q").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("q"), "often")
    two = one.join(often, "q").select("id", F.explode(F.array("l", "r")).alias("h")).where("h IS NOT NULL").distinct()
    two = scratch.save(two, "halves")
    often = scratch.save(two.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h"), "often")
    halves = two.join(often, "h").groupBy("id").agg(F.collect_list("h").alias("halves"))
    three = scratch.save(reps.join(halves, "id").mapInArrow(_level3(length), "id long, h1 long, h2 long"), "windows")
    least = scratch.save(three.groupBy("h1", "h2").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").drop("_hi"), "least")
    gone = three.join(least, ["h1", "h2"]).where("id > _lo").groupBy("id").agg(F.collect_set("h1").alias("gone"))
    return scratch.save(gone, "gone"), copies.select("id", "mark").join(lone, "id", "left_semi")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, give_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, n_words, n_removed, ``keep``, and what is left of the text.

    That is ``kept_sha256``, of the kept words joined by one space, or with ``give_text``
    ``text``, in which runs of kept words stay as they were, one to a line.
    """
    gone, copies = repeated(docs, key, text, length)
    whole = copies.select("id").distinct().withColumn("whole", F.lit(True))
    # Repeated texts and repeated windows meet the documents in one join.
    marks = gone.join(whole, "id", "full")
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    joined = named.join(marks, "id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    kinds = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    cut = joined.mapInArrow(_cut(length, give_text), f"id long, n_words long, n_removed long, kept string{kinds}")
    return cut.select(F.col("id").alias(key), "n_words", "n_removed", F.col("kept").alias("text" if give_text else "kept_sha256"), *[F.col(f"_{c}").alias(c) for c in keep])
