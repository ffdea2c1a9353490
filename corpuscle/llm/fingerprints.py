"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range. What
is kept of a text does not depend on its length, so fingerprints of very unequal texts
can be compared: the kept hashes of a passage are among those of any text that holds it,
and their share estimates containment. A text of which no hash is below the threshold
keeps its least one, so that no text with a word has an empty fingerprint. ``merge``
gives the fingerprint of two texts together from theirs alone: hashes below the threshold
are united, and a least one above it stays only where there is none.

Only built-in column functions run. A fingerprint is a string: the kept hashes in order,
in hexadecimal, by spaces; equal texts have equal ones.

Defined cases: a null text is empty; a text without words has an empty fingerprint, like
itself alone (likeness 1 to another empty one, 0 to any other); fewer words than a
shingle make one shingle; repeated rows are rows of their own; rows of one key follow
each other by a hash of their texts; an empty table gives an empty result; a null key
sorts first.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes are cut to 48 bits; kept are those below 2**48 / SCALE.
BITS, SCALE = 48, 4


def hashes(text: Column, words: int = 5) -> Column:
    """The distinct hashes of a text's shingles, without order.

    One expression finds every shingle: at each word's start it looks ahead over
    ``words`` words, which are hashed as they stand, white space replaced before.
    """
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    shingle = rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{words - 1}}})(?: |$))"
    found = F.regexp_extract_all(flat, F.lit(shingle), 1)
    whole = F.btrim(flat)
    every = F.when(F.size(found) > 0, found).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.transform(every, lambda s: F.shiftrightunsigned(F.xxhash64(s), 64 - BITS))


def sketch(hashed: Column, scale: int = SCALE) -> Column:
    """The kept hashes in order: all below the threshold, or the least one if there is none."""
    kept = F.filter(hashed, lambda h: h < (1 << BITS) // scale)
    least = F.when(F.size(hashed) > 0, F.array(F.array_min(hashed))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(least)))


def encode(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lower(F.hex(h))), " ")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return sketch(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text, and its sketch."""
    first = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    return first.select("*", hashes(F.col("text")).alias("_h")).select(*keep, "text", sketch(F.col("_h")).alias("sketch"))


def bounds(docs: DataFrame, key: str, n: int) -> list:
    """Keys that cut the table into about n ranges of as many rows; a key with many rows comes several times."""
    cuts = docs.agg(F.expr(f"percentile_approx({key}, array({', '.join(str(i / n) for i in range(1, n))}), {100 * n})")).first()[0] if n > 1 else None
    return sorted(cuts or [])


def place_of(key: Column, cuts: list) -> Column:
    """How many of the cuts, which are in order, are below the key; -1 for null. Found by halving, so the plan grows with the cuts alone, as one array."""
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    if not steps:
        return F.when(key.isNull(), -1).otherwise(0)
    known = F.array(*map(F.lit, cuts))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) < key, at + step).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document with the next one in order of the key (after the last, the first): key, text, sketch, next_text, next_sketch.

    The order is found within ranges of the key, cut at approximate quantiles, so that no
    task sees it whole; a key that fills several ranges is cut by its rows' hashes. The
    last of a range takes the first of the next.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(docs, key, ranges)
    often = Counter(cuts)
    heavy = {k: n for k, n in often.items() if n > 1}
    named = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).withColumn("_row", F.xxhash64("text")).withColumn("_range", place_of(F.col(key), sorted(often)).cast("long"))
    if heavy:
        # Rows of these keys, at most one for each two ranges, are dealt to parts by the upper bits of their hashes.
        share = F.element_at(F.create_map(*[F.lit(x) for k, n in heavy.items() for x in (k, n)]), F.col(key))
        part = F.coalesce(F.floor((F.shiftrightunsigned("_row", 40).bitwiseXOR(F.lit(1 << 23))) * share / (1 << 24)), F.lit(0))
        named = named.withColumn("_range", F.col("_range") * (max(heavy.values()) + 1) + part)
    made = fingerprint(named, "text", (key, "_row", "_range"))
    order = [F.col(key).asc_nulls_first(), F.col("_row")]
    laid = made.withColumn("_next", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("_range").orderBy(*order)))
    # One row for each range: its first document, by key and hash, and then that document itself.
    least = named.groupBy("_range").agg(F.min(F.struct(F.col(key).alias("k"), "_row")).alias("_first"))
    known = least.orderBy("_range").collect()
    follow = [(r["_first"]["k"], r["_first"]["_row"], known[i - 1]["_range"]) for i, r in enumerate(known)]
    starts = spark.createDataFrame(follow, f"_key {docs.schema[key].dataType.simpleString()}, _hash long, _before long")
    first = named.select(key, "text", "_row").join(F.broadcast(starts), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_hash")))
    first = first.groupBy(F.col("_before").alias("_range")).agg(F.first("text").alias("text"))
    first = fingerprint(first, "text", ("_range",)).select("_range", F.struct("text", "sketch").alias("_first"))
    # The window has dealt and sorted its rows by range; this join adds no exchange of them.
    both = laid.join(first, "_range", "left").withColumn("_next", F.coalesce("_next", "_first"))
    return both.select(key, "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against itself with its last quarter replaced by the start of the next one, and against the next one."""
    pairs = neighbours(docs, key, text)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    changed = pairs.select(key, n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("_edited"))
    hashed = changed.select("*", hashes(F.col("_edited")).alias("_h"))
    sketched = hashed.select(key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("_h")).alias("_sketch"))
    return sketched.select(
        key, "n_chars", "edited_sha256", encode(F.col("sketch")).alias("fingerprint"), encode(F.col("_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
