"""Packing along a space-filling curve.

Each document is tokenised, and its token counts, hashed to signed buckets, are
projected to ``DIMS`` dimensions; every dimension is cut into 2**``BITS`` cells, and the
cell's index on a Hilbert curve is the document's key. Documents are range-sorted by
key, so that neighbours on the curve have like contents, and laid end to end; every
``size`` tokens a sequence ends. Documents are cut where a sequence ends, so that only
the last sequence of all has padding.

The range-sort moves a row of some forty bytes for each document: its key, its size and
the number of its row among the saved token ids. Within a task, places are a running
sum; the tasks' totals, one row for each task, then give each task its start. Places and
token ids (two bytes each) meet in a join on the row's number, by hash, so that long
documents, whose keys lie close together, are spread over all tasks. No key can fill a
task: equal keys are ordered by document and row.

Where a vocabulary's file says that it lower-cases words and drops white space (see
``by_words``), no token depends on anything outside a word, and a worker remembers the
ids of words it has met, up to a bound. With any other file whole texts are encoded.

Defined cases: a null text is empty; an empty one has only the end token; equal rows and
rows of one key are documents of their own, told apart by ``row``; an empty table gives
an empty result. A null key is kept and sorts first.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .shingles import U, Words, bounded_batches, mix, portions

DIMS, BITS, BUCKETS = 3, 10, 4096
#: Words that a worker remembers before it starts anew, at about 30 bytes each.
REMEMBERED = 1_000_000
#: Documents that a task of the range-sort orders, about, where there are more than the session's tasks.
SORTED = 1_000_000
_held: dict[str, Ids] = {}


def id_type(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


@functools.lru_cache
def vocabulary_size(path: str) -> int:
    """For the driver, which needs no more of a vocabulary and doesn't keep it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def by_words(tokenizer) -> bool:
    """Whether lower-cased words between white space can be encoded apart, each piece of them ending in ``</w>``."""
    told = json.loads(tokenizer.to_str())
    steps = (told["normalizer"] or {}).get("normalizers") or []
    cuts = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    space = [s for s in steps if s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "]
    kept = cuts[0].get("type") == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and " " not in cuts[0]["pattern"].get("Regex", " ")
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and bool(space) and kept and told["model"].get("end_of_word_suffix") == "</w>"


class Ids:
    """Token ids of texts: each text's as one array, from words met before where that can be."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = id_type(self.tokenizer.get_vocab_size())
        names = self.tokenizer.get_vocab()
        self.by_words = by_words(self.tokenizer)
        self.closes = np.zeros(max(names.values(), default=0) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Remembered words: their hashes in order, and where each one's ids lie in ``ids``."""
        self.known, self.low, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.type)

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in _held:
            _held[path] = cls(path)
        return _held[path]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and each one's number of ids."""
        texts = [w.decode("utf-8", "replace") for w in words]
        # A word of letters alone is one piece, which ends in the one token that closes a piece; such words are
        # encoded many at a time, and cut apart there. The others are encoded one by one.
        # The same holds for letters with one full stop or comma behind them, which is a piece of its own.
        stem = [x[:-1] if x[-1:] in (".", ",") else x for x in texts]
        plain = [i for i, x in enumerate(stem) if x.isalpha() and "\u0130" not in x]
        count = np.zeros(len(words), np.int64)
        other = sorted(set(range(len(words))) - set(plain))
        firsts, parts = [], []
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] if texts[i] is stem[i] else f"{stem[i]} {texts[i][-1]}" for i in part])], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.closes[got]) + 1
            pieces = np.cumsum([1 + (texts[i] is not stem[i]) for i in part])
            if len(ends) == pieces[-1]:
                ends = ends[pieces - 1]
                count[part] = np.diff(ends, prepend=0)
                firsts += part
                parts.append(got)
            else:
                other += part
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                count[i] = len(e.ids)
                firsts.append(i)
                parts.append(np.array(e.ids, self.type))
        order = np.array(firsts, np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, self.type)
        low = np.zeros(len(words), np.int64)
        low[order] = np.concatenate([[0], np.cumsum(count[order])])[:-1]
        return ragged(ids, low, count), count

    def _remember(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words of hashes that are in order and not known."""
        ids, count = self._encode(words)
        low = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.known, hashes)
        self.known, self.low, self.count = np.insert(self.known, at, hashes), np.insert(self.low, at, low), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text; together the texts should have some megabytes at most."""
        if not self.by_words:
            return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self.known) > REMEMBERED:
            self._forget()
        # Lower case is a step of the vocabulary itself; texts that hold names of special tokens, or I before a dot
        # above, which is composed first, are encoded as they are.
        odd = [i for i, t in enumerate(texts) if b"<|" in t or b"\xcc\x87" in t]
        words = Words([b"" if i in set(odd) else t for i, t in enumerate(texts)] if odd else texts, lower=True)
        raw = np.frombuffer(words.data, np.uint8)
        # A single full stop or comma behind a letter is a piece of its own; cut off, the word is remembered once.
        last = raw[words.end - 1]
        before = raw[np.maximum(words.end - 2, 0)] | 32
        stop = ((last == 46) | (last == 44)) & (words.end - words.start > 1) & (before >= 97) & (before <= 122)
        each = 1 + stop.astype(np.int64)
        own = np.repeat(np.arange(len(each)), each)
        tail = np.diff(own, prepend=-1) == 0
        start = np.where(tail, words.end[own] - 1, words.start[own])
        end = np.where(stop[own] & ~tail, words.end[own] - 1, words.end[own])
        hashes, index, inverse = np.unique(words.spans(start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            data, lo, hi = words.data.lower(), start[index[new]].tolist(), end[index[new]].tolist()
            self._remember(hashes[new], [data[x:y] for x, y in zip(lo, hi, strict=True)])
            at = np.searchsorted(self.known, hashes)
        low, count = self.low[at][inverse], self.count[at][inverse]
        ids = ragged(self.ids, low, count)
        sums = np.concatenate([[0], np.cumsum(count)])
        first = sums[np.concatenate([[0], np.cumsum(each)])[words.first]]
        out = np.split(ids, first[1:-1])
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, self.type)
        return out


def ragged(values: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[low : low + count] of each, end to end."""
    ends = np.cumsum(count)
    if not len(ends):
        return values[:0]
    at = np.arange(ends[-1]) + np.repeat(low - ends + count, count)
    return values[at]


def projection(n: int) -> np.ndarray:
    """For each token id its row of the projection: hashed to a signed bucket, projected by fixed random numbers."""
    ids = mix(np.arange(n, dtype=U) + U(1))
    rows = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    sign = np.where(ids >> U(63), 1, -1).astype(np.float32)
    return rows[(ids % U(BUCKETS)).astype(np.int64)] * sign[:, None]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of integers below 2**bits), by Skilling's transpose."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = Ids.of(path), TaskContext.get().partitionId() << 40
        table = projection(ids.tokenizer.get_vocab_size())
        last = np.array([end], ids.type)
        for whole in batches:
            texts = whole.column(1).cast(pa.binary()).to_pylist()
            for low, high in portions(texts, 1 << 20):
                tokens = [np.append(t, last) for t in ids([t or b"" for t in texts[low:high]])]
                means = np.array([sum((table[t[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64) for a in range(0, len(t), 1 << 16)), np.zeros(DIMS)) / len(t) for t in tokens])
                # Means lie close to the origin; the spread is stretched over the cells.
                cells = np.clip((np.tanh(means * 2.0) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                rows = pa.array(row + np.arange(high - low, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(low, high - low), rows, pa.array(hilbert(cells, BITS)), pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                    names=["id", "row", "curve", "crc", "n", "tokens"],
                )
                row += high - low

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = at + np.cumsum(batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(ends), task, np.int32)), pa.array(ends - batch.column("n").to_numpy()), batch.column("n")], names=["row", "task", "at", "n"])
        at = int(ends[-1]) if len(ends) else at


def _pieces(size: int, type_: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, start, length, crc, seq, offset = [], [], [], [], [], []
            places = batch.column("place").to_numpy()
            for i, t in enumerate(batch.column("tokens")):
                own, place, at = np.frombuffer(t.as_buffer(), type_).astype("<u4"), int(places[i]), 0
                while at < len(own):
                    n = min(size - (place + at) % size, len(own) - at)
                    which.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own[at : at + n]))
                    seq.append((place + at) // size)
                    offset.append((place + at) % size)
                    at += n
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), *[pa.array(x, pa.int64()) for x in (start, length, crc)], batch.column("n").take(take), pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), batch.column("row").take(take)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"])

    return run


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = 4096, end: int = 2) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and row (which tells equal keys apart).

    ``vocabulary`` is the path of a tokenizers file that executors can open.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = id_type(vocabulary_size(vocabulary))
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # Saved, because the range-sort reads its input twice, and the join once more.
    keyed = scratch.save(body.mapInArrow(_tokenise(vocabulary, end), "id long, row long, curve long, crc long, n long, tokens binary"), "tokens")
    order = ["curve", "id", "crc", "row"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // SORTED))
    along = keyed.select(*order, "n").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    laid = scratch.save(along.select("row", "n").mapInArrow(_place, "row long, task int, at long, n long"), "laid")
    # One row for each task of the range-sort.
    starts, at = [], 0
    for r in sorted(laid.groupBy("task").agg(F.sum("n").alias("z")).collect()):
        starts.append((r["task"], at))
        at += r["z"]
    base = spark.createDataFrame(starts, "task int, base long")
    places = laid.join(F.broadcast(base), "task").select("row", (F.col("at") + F.col("base")).alias("place"))
    placed = keyed.select("id", "row", "n", "tokens").join(places.hint("merge"), "row").select("id", "row", "place", "n", "tokens")
    pieces = placed.mapInArrow(_pieces(size, kind), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long")
    return pieces.withColumnRenamed("id", key)
