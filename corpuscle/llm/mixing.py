"""Mix sources to target weights with a low-discrepancy schedule.

Slots of the mix are numbered t = 0, 1, 2, ...; the van der Corput point of t
(its bits mirrored behind the binary point) falls into one source's share of the
cumulative weights, so every prefix of the mix holds each source close to its
weight. A source's documents are shuffled by a hash, laid end to end and cut into
blocks of equally many words; its k-th slot takes its k-th block, wrapping around
when the blocks run out. The join of slots and blocks gives the words taken.

A source whose share is too small for the schedule, or whose blocks are not all full,
meets fewer points than it has blocks to give. It gets the slots it lacks besides,
spread evenly over the mix, so that every source is taken up to its target, whatever
the size of a block. Slots of several sources may then have one number.

Nothing gathers a source into one task: positions and ranks are prefix sums in two
levels, first over hash-range chunks of a source (or runs of slots), then within
a chunk, so a source with a third of all rows is spread over all chunks. Only
built-in column functions are used.

Defined cases: a null text has size 0 and is never taken; the null source is a
source of its own, last in order; equal hashes are ordered by id and text length;
repeated rows are each placed and each get a row; an empty table gives an empty
result; a source of size 0 has target 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

CYCLE = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; excess is shared again by weight."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        by = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / by >= cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / by
            break
        for i in full:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


def sources(sized: DataFrame, source: str, share: float, cap: float, cycle: Sequence[float]) -> DataFrame:
    """One row per source: _s (its number), source_size and target. Their number, not their rows, meets the driver."""
    spark = sized.sparkSession
    found = sized.groupBy(source).agg(F.sum("size").alias("z")).collect()
    # Python orders strings by code point; the null source goes last.
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in found]
    target = fill_targets(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share * sum(sizes), cap)
    rows = [(i, r[0], sizes[i], float(target[i])) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, f"_s int, _source {sized.schema[source].dataType.simpleString()}, source_size long, target double")


def running(df: DataFrame, value: str, within: Sequence[str], chunk: str, order: Sequence[str], out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` in the order (chunk, order), by ``within``, in two levels."""
    keys = [*within, chunk]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_v")).select(*keys, F.coalesce(F.sum("_v").over(outer), F.lit(0)).alias("_base"))
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, keys).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base")


def van_der_corput(t: Column, bits: int) -> Column:
    """The bits of t mirrored, as a long in [0, 2**bits)."""
    return F.conv(F.reverse(F.lpad(F.bin(t), bits, "0")), 2, 10).cast("long")


def n_slots(total: float, block: int) -> int:
    n = -(-int(total) // block)
    return n + n // 64 + 64


def needed(size: int, target: float, block: int) -> int:
    """Slots that a source needs to reach its target: every pass ends with a block of its own."""
    passes, rest = divmod(math.floor(target), size) if size else (0, 0)
    return passes * -(-size // block) + -(-rest // block)


def schedule(spark: SparkSession, table: DataFrame, block: int, bits: int, run: int = 1 << 14) -> DataFrame:
    """The mix: slot, _s and rank (the slot's number among its source's, from 0).

    Cumulative weights are scaled to 2**bits; each interval is dealt to bins of the
    unit interval, so that slots meet their source in an equality join on the bin.
    Every source has the slots that it needs at least.
    """
    rows = table.orderBy("_s").collect()
    total = sum(r["target"] for r in rows)
    if total <= 0:
        return spark.createDataFrame([], "slot long, _s int, rank long")
    # A few more slots than the mix needs, as each source is cut at its target.
    n, whole, width = n_slots(total, block), 1 << bits, 1 << max(0, bits - 12)
    shares, low = [], 0.0
    for r in rows:
        high = low + r["target"] / total
        a, b = round(low * whole), round(high * whole)
        shares += [(k, r["_s"], max(a, k * width), min(b, (k + 1) * width)) for k in range(a // width, (b - 1) // width + 1)] if b > a else []
        low = high
    bins = spark.createDataFrame(shares, "_bin long, _s int, _a long, _b long")
    slots = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id"), bits).alias("_u")).withColumn("_bin", F.floor(F.col("_u") / width).cast("long"))
    dealt = slots.join(bins, "_bin").where("_u >= _a AND _u < _b").select("slot", "_s")
    # What a source lacks; the golden ratio keeps different sources apart from each other.
    needs = spark.createDataFrame([(r["_s"], needed(r["source_size"], r["target"], block), (r["_s"] * 0.6180339887498949) % 1) for r in rows], "_s int, _need long, _phase double")
    lacks = needs.join(dealt.groupBy("_s").agg(F.count(F.lit(1)).alias("_has")), "_s", "left").withColumn("_lack", F.col("_need") - F.coalesce("_has", F.lit(0))).where("_lack > 0")
    added = lacks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lack") - 1)))
    added = added.select(F.floor((F.col("_i") + F.col("_phase")) / F.col("_lack") * -(-int(total) // block)).cast("long").alias("slot"), "_s")
    dealt = dealt.union(added).select("slot", "_s", F.floor(F.col("slot") / run).cast("long").alias("_run"), F.lit(1).cast("long").alias("_one"))
    return running(dealt, "_one", ["_s"], "_run", ["slot"], "rank").select("slot", "_s", "rank")


def blocks(sized: DataFrame, key: str, block: int, seed: int, chunks: int) -> DataFrame:
    """Where each document lies in its source's shuffled stream: _at, its first word's place."""
    hashed = sized.withColumn("_k", F.xxhash64(F.lit(seed), F.col(key), F.col("_row")))
    chunked = hashed.withColumn("_chunk", F.pmod(F.shiftrightunsigned("_k", 17), F.lit(chunks)))
    return running(chunked, "size", ["_s"], "_chunk", ["_k", key, "_row"], "_at").drop("_chunk", "_k")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, cycle: Sequence[float] = CYCLE, slots: int = 2_000_000, least_block: int = 16, seed: int = 20) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, and ``pieces``.

    ``pieces`` lists what the mix takes of the document, in schedule order: slot, start
    (its first word, from 0) and n (words). ``slots`` bounds the length of the schedule:
    a block has as many words as make the whole mix fit, and ``least_block`` at least.
    Slots that single sources lack come on top, a few for each source.
    The last block that a source gives is cut at its target.
    """
    spark = docs.sparkSession
    # Rows of one key are told apart by their text, so that both repeated and clashing rows are placed.
    sized = scratch.save(docs.select(F.col(key), F.col(source), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("_row")), "sizes")
    table = sources(sized, source, share, cap, cycle)
    rows = table.collect()
    total = sum(r["target"] for r in rows)
    block = max(least_block, -(-int(total) // slots))
    bits = max(13, n_slots(total, block).bit_length())
    known = sized.join(F.broadcast(table) if len(rows) <= 100_000 else table, sized[source].eqNullSafe(table["_source"])).drop("_source")
    # Repeated rows are placed once and the copies counted, so that their order never matters.
    placed = blocks(known.groupBy(key, source, "_row", "_s", "source_size", "target", F.col("size").alias("_one")).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).withColumn("_text", F.col("_row")).withColumn("_row", F.xxhash64("_row", "_copy")).withColumnRenamed("_one", "size"), key, block, seed, 256)
    placed = scratch.save(placed.drop("_copies"), "placed")
    last = F.floor((F.col("_at") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_at") / block), last)))
    start = F.greatest(F.col("_block") * block, F.col("_at"))
    cut = cut.select(key, source, "_row", "_copy", "_s", "source_size", "target", "_at", "_block", start.alias("_from"), (F.least((F.col("_block") + 1) * block, F.col("_at") + F.col("size"))).alias("_to"))
    # A slot's rank names a pass over the source and a block within it.
    given = schedule(spark, table, block, bits).join(F.broadcast(table.select("_s", "source_size")) if len(rows) <= 100_000 else table.select("_s", "source_size"), "_s")
    n_blocks = F.ceil(F.col("source_size") / block)
    given = given.select("slot", "_s", F.floor(F.col("rank") / n_blocks).alias("_pass"), (F.col("rank") % n_blocks).alias("_block"))
    # What the target leaves of this pass, in words from the source's start.
    room = F.floor(F.col("target")).cast("long") - F.col("_pass") * F.col("source_size")
    taken = cut.join(given, ["_s", "_block"]).withColumn("_end", F.least(F.col("_to"), room)).where("_end > _from")
    piece = F.struct("slot", (F.col("_from") - F.col("_at")).alias("start"), (F.col("_end") - F.col("_from")).alias("n"))
    mine = taken.groupBy(key, source, "_row", "_copy").agg(F.sum(F.col("_end") - F.col("_from")).alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    mine = mine.select(F.struct(key, source, "_row", "_copy").alias("_id"), "taken", "pieces")
    out = placed.withColumn("_id", F.struct(key, source, "_row", "_copy")).join(mine, "_id", "left")
    return out.select(key, source, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("pieces", F.array().cast("array<struct<slot:bigint,start:bigint,n:bigint>>")).alias("pieces"), F.col("_text").alias("text_hash"), F.col("_copy").alias("copy"))


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str | None = "n_chars", **how) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each as often as it is taken whole, then what is taken of its start.

    Blocks follow a source's shuffled documents in order, so of every pass over a
    document its first words are taken. Equal rows share what they take.
    """
    mixed = mix(docs, key, text, source, **how).groupBy(key, source, "text_hash", "size").agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias("_taken"))
    mixed = mixed.where("_taken > 0").select(F.struct(key, source, "text_hash").alias("_id"), F.col("size").alias("_size"), "_taken")
    whole = docs.select(F.struct(F.col(key), F.col(source), F.xxhash64(text).alias("text_hash")).alias("_id"), F.struct(*docs.columns).alias("_doc"))
    old = F.col("_doc")[text]
    times = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    takes = F.concat(F.array_repeat(F.col("_size"), times), F.filter(F.array(F.col("_taken") % F.col("_size")), lambda n: n > 0))
    rows = whole.join(mixed, "_id").select("_doc", "_size", F.explode(takes).alias("_n"))
    words = F.array_remove(F.split(old, r"[\x20\x09-\x0D]+"), "")
    cut = F.when(F.col("_n") < F.col("_size"), F.array_join(F.slice(words, 1, F.col("_n").cast("int")), " ")).otherwise(old)
    made = rows.select("_doc", cut.alias("_text"))
    new = {text: F.col("_text")}
    if chars:
        new[chars] = F.length("_text").cast(docs.schema[chars].dataType)
    return made.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
