"""Host-level quality rules.

Each document is measured against simple rules over its whole text. Failures are
then counted by host, each host's failure rates are shrunk towards the rate of
all hosts with an empirical beta prior (method of moments), and the hosts'
verdicts are joined back to their documents. A host with three documents of which
two fail is thus not judged like one with three thousand of which two thousand fail.

The prior's spread is that of the hosts' rates beyond what chance alone gives them, so
hosts that differ by chance are all drawn to the mean, and none goes. A host goes where
one of its rates is, two posterior standard deviations to spare, above both ``TIMES`` the
mean rate of all hosts and ``FLOOR``, or above ``MOST``.

Only built-in column functions run here: words and lines become arrays within
their row, so no text and no word is ever shuffled; the only exchange is of
partial counts by host.

Defined cases: a null or blank text has no words and fails ``too_few_words``; a
null host is a host of its own; repeated rows each count and each get a row; an
empty table gives an empty result; further columns are left out unless named in
``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text, without empty strings; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACE)) > 0)
    return F.size(lines) - F.size(F.array_distinct(lines))


def measure(docs: DataFrame, keep: Sequence[str], text: str = "text", window: int = 3) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    ``n_repeat_words`` counts the words covered by a window of ``window`` words that
    occurs twice or more in the text. Windows are hashed with their position, sorted,
    and kept where a neighbour has the same hash; the kept positions, sorted again,
    give the covered words as a sum of gaps. Sorting keeps long repetitive texts at
    n log n. Texts whose windows all differ, seen by their distinct count, skip it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(*keep, words(F.col(text)).alias("_w"), (F.length(without(body, SPACE))).cast("long").alias("word_chars"), (F.length(body) - F.length(without(body, SYMBOLS))).cast("long").alias("n_symbols"), duplicate_lines(body).cast("long").alias("n_dup_lines"))
    size = F.size("_w")
    at = F.sequence(F.lit(1), size - F.lit(window - 1))
    hashes = F.when(size >= window, F.transform(at, lambda i: F.xxhash64(*[F.element_at(F.col("_w"), i + F.lit(k)) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    second = first.select(*keep, "word_chars", "n_symbols", "n_dup_lines", size.cast("long").alias("n_words"), hashes.alias("_h"))
    placed = F.sort_array(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    third = second.select("*", F.when(repeats, placed).alias("_s")).drop("_h")
    beside = lambda i, step: F.get(F.col("_s"), i + F.lit(step))["h"]
    twice = F.filter(F.col("_s"), lambda x, i: F.coalesce(x["h"] == beside(i, 1), F.lit(False)) | F.coalesce(x["h"] == beside(i, -1), F.lit(False)))
    fourth = third.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_p")).drop("_s")
    gaps = F.transform(F.col("_p"), lambda p, i: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(window))).cast("long"))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return fourth.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).alias("n_repeat_words"))


#: A document breaks a rule where its expression holds. The first two are the base rules.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 0 AND 20 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("too_few_words", "repetitive")
#: A host's rate is too high above this many times the mean (where that is above FLOOR), and above MOST in any case.
TIMES, FLOOR, MOST, DEVIATIONS = 2.0, 0.1, 0.6, 2.0


def host_verdicts(measured: DataFrame, host: str, rules: dict[str, str], times: float = TIMES, floor: float = FLOOR, most: float = MOST) -> DataFrame:
    """One row per host: n, by rule the posterior mean rate_ and its lower bound low_, and host_kept.

    The prior of a rule is the beta distribution whose mean is that of the hosts' raw
    rates, and whose variance is theirs less what samples of the hosts' sizes have by
    chance; where nothing is left, it weighs as much as all documents together.
    """
    failed = {r: F.sum(F.expr(f"CASE WHEN {e} THEN 1 ELSE 0 END")).alias(r) for r, e in rules.items()}
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *failed.values())
    moments = hosts.agg(F.sum("n").alias("_all"), F.avg(1 / F.col("n")).alias("_inv"), *[f(F.col(r) / F.col("n")).alias(f"_{k}_{r}") for r in rules for k, f in (("m", F.avg), ("v", F.var_pop))])
    rates, lows, bad = [], [], F.lit(False)
    for r in rules:
        m = F.col(f"_m_{r}")
        spread = F.col(f"_v_{r}") - m * (1 - m) * F.col("_inv")
        weight = F.when(spread > 0, F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)), F.col("_all"))).otherwise(F.col("_all"))
        rates.append(((F.col(r) + m * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
        lows.append((F.col(f"rate_{r}") - DEVIATIONS * F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("n") + weight + 1))).alias(f"low_{r}"))
        bad = bad | (F.col(f"low_{r}") > F.least(F.greatest(times * m, F.lit(floor)), F.lit(most)))
    # One row of moments: a broadcast of a single row, whatever the corpus.
    joined = hosts.join(F.broadcast(moments), how="cross").select("*", *rates).select("*", *lows)
    return joined.select("_host", "n", *[f"{k}_{r}" for r in rules for k in ("rate", "low")], (~bad).alias("host_kept"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: dict[str, str] | None = None, base: Sequence[str] = BASE, times: float = TIMES, floor: float = FLOOR, most: float = MOST) -> DataFrame:
    """One row per document: key, host, the measures, base_failed, host_kept and kept.

    A document is kept if it breaks no base rule and its host is kept.
    """
    rules = RULES if rules is None else rules
    measured = scratch.save(measure(docs.select(F.col(key), F.col(host), F.col(text)), [key, host], text), "quality")
    verdicts = host_verdicts(measured, host, rules, times, floor, most).select("_host", *[f"rate_{r}" for r in rules], "host_kept")
    failed = F.expr(" OR ".join(f"({rules[r]})" for r in base))
    out = measured.join(verdicts, measured[host].eqNullSafe(verdicts["_host"]), "left").drop("_host")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
