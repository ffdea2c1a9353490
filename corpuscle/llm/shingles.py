"""Words and windows of whole texts as arrays of 64-bit hashes.

The words of many texts are cut and hashed at once with numpy, straight from UTF-8
bytes: a prefix sum of bytes times powers of an odd base gives the hash of any span
as one difference, and the same over word hashes gives the hash of any window of
words. Texts are taken in portions of about ``PORTION`` bytes, and a text that is
longer is hashed by blocks of as many; beside the text itself a worker then holds a
few numbers for each of its words, whatever the batch.

Words are ``[^\\x20\\x09-\\x0D]+``; with ``lower``, A-Z are lower-cased first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import SparkSession

U = np.uint64
PORTION = 1 << 18
#: Bytes of an Arrow batch, whose default of 64 MB is held several times over by the JVM and the worker of every task.
BATCH = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Plans of this session pass rows to Python in batches of ``BATCH`` bytes at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n (n or more of them)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, U)
            while len(p) < size:
                p = np.concatenate([p, p * U(pow(b, len(p), 1 << 64))])
            made.append(p)
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def portions(texts: Sequence[bytes | None], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, of one text at least."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield low, i
            low, size = i, 0
        size += n + 1
    if low < len(texts):
        yield low, len(texts)


class Words:
    """The words of several texts: ``hash``, ``start`` and ``end`` (bytes of ``data``), and of text i those from first[i] to first[i + 1]."""

    def __init__(self, texts: Sequence[bytes | None], lower: bool = False) -> None:
        self.data = b"\n".join([t or b"" for t in texts]) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = ~_SPACE[raw]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.offset)
        self._fold = _LOWER if lower else _SAME
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each span of bytes, which follow each other; it depends on the span's bytes alone."""
        raw = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(start), U)
        at = 0
        while at < len(start):
            low = int(start[at])
            to = int(np.searchsorted(end, low + PORTION, side="right"))
            if to == at:  # longer than a block
                folded = self._fold[raw[low : end[at]]].astype(np.uint8).tobytes()
                out[at] = int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")
                at += 1
                continue
            part = raw[low : end[to - 1]]
            up, down = powers(_BASE, len(part))
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(self._fold[part] * up[: len(part)], out=sums[1:])
            a, b = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0xA24BAED4963EE407))
            at = to
        return out

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """The hash of the window that starts at each word; meaningless where it leaves its text."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, U)
        values = mix(self.hash + U(seed)) if seed else self.hash
        up, down = powers(_WORD_BASE, len(values))
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * down[:n] + U(length))

    def sequence(self, i: int, seed: int = 0) -> int:
        """The hash of all words of text i."""
        a, b = self.first[i], self.first[i + 1]
        up, _ = powers(_WORD_BASE, int(b - a))
        values = self.hash[a:b]
        values = mix(values + U(seed)) if seed else values
        return int(mix(np.array([(values * up[: b - a]).sum(dtype=U) + U(b - a)], U))[0])

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles (repeats included), those of text i from bounds[i] to bounds[i + 1].

        A text with fewer words than ``length`` has one shingle, the whole sequence; one without words has none.
        """
        count = np.diff(self.first)
        n = np.where(count >= length, count - length + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(bounds[-1], U)
        all_ = self.windows(length)
        for i in range(len(n)):
            if count[i] >= length:
                out[bounds[i] : bounds[i + 1]] = all_[self.first[i] : self.first[i] + n[i]]
            elif count[i]:
                out[bounds[i]] = self.sequence(i)
        return out, bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
