"""MinHash near-duplicate grouping with SuperMinHash signatures.

1. Every text becomes a set of word-shingle hashes and a SuperMinHash signature: each
   element draws a random permutation of the signature's places along with a random
   fraction; a place keeps the least rank plus fraction that any element has there.
   Ranks are drawn one after the other, and a text stops at the rank below which all
   its places are filled, which for a long text is the first.
2. Texts with equal sets are one class; its smallest doc_id stands for it from here.
3. Signatures are cut into bands; classes that agree in a band share a bucket.
4. Buckets never give all their pairs. Every member is compared with one pivot, and the
   links make groups; buckets that are one group are done, as their other pairs can't
   change the result. Of the others, those with ``pivots`` members or fewer compare what
   is still apart; larger ones a few members, and then, in blocks of bounded size,
   all that is outside their largest group. No bucket is capped or sampled.
5. Candidate pairs pass a test on signatures (six standard deviations below the
   threshold) and are then confirmed on the full sets.
6. Links are joined by union-find: within each task first, which leaves a forest of at
   most one link per document and task, then across tasks by alternately linking to the
   least neighbour (large star, small star) until nothing changes.

A pair at the threshold shares no band with a probability below 1e-6 (4 of 128 places in
32 bands); pairs above it, and pairs that are linked through a third text, less.

Defined cases: null and blank texts have empty sets, are their own component and kept;
rows of one doc_id are one node of the links, each with its own row and set size; a
null doc_id has a null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .shingles import U, Words, bounded_batches, mix, portions, signed

PLACES, BANDS = 128, 32


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures of several sets at once, as (sets, places) of 64-bit values: rank above, fraction below.

    All sets that still have an unfilled place at or above the current rank go on to the next one.
    """
    sets = len(bounds) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    best = np.full(sets * places, np.iinfo(np.uint64).max, U)
    order: np.ndarray | None = None
    live = np.arange(len(hashes))
    for rank in range(places):
        if not len(live):
            break
        x = mix(hashes[live] + U((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # The lower half picks one of the places not yet drawn, the upper bits are the fraction.
        pick = rank + (((x & U(0xFFFFFFFF)) * U(places - rank)) >> U(32)).astype(np.int64)
        if rank == 0:
            place = pick
        else:
            at = np.arange(len(live))
            place = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, rank]
        value = (U(rank) << U(56)) | (mix(x) >> U(8))
        np.minimum.at(best, owner[live] * places + place, value)
        worst = best.reshape(sets, places).max(axis=1) >> U(56)
        stays = worst[owner[live]] > rank
        if rank == 0:
            live = live[stays]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(live), 1))
            first = pick[stays]
            order[np.arange(len(live)), first] = 0
            order[:, 0] = first
        elif not stays.all():
            live, order = live[stays], order[stays]
    return best.reshape(sets, places)


def _sketch(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in portions(texts):
                words = Words(texts[low:high], lower=True)
                hashes, bounds = words.shingles(k)
                n, c1, c2, kept, sizes = [], [], [], [], []
                for i in range(high - low):
                    own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    n.append(len(own))
                    c1.append(int(own.sum(dtype=U)))
                    c2.append(int(mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=U)))
                    kept.append(own)
                    sizes.append(len(own))
                own = np.concatenate(kept) if kept else np.zeros(0, U)
                sig = np.empty((high - low, PLACES), U)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                # Small steps keep the permutations of many short texts within bounds.
                a = 0
                while a < high - low:
                    b = a + 1
                    while b < high - low and edges[b + 1] - edges[a] <= 200_000:
                        b += 1
                    sig[a:b] = super_minhash(own[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
                    a = b
                rows = PLACES // bands
                parts = sig.reshape(high - low, bands, rows)
                key = np.zeros((high - low, bands), U)
                for r in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r] + np.arange(bands, dtype=U))
                short = (mix(sig) >> U(56)).astype(np.uint8)
                empty = np.array(sizes) == 0
                lists = [None if e else signed(row).tolist() for e, row in zip(empty, key, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(np.array(c1, U).view(np.int64)), pa.array(np.array(c2, U).view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["id", "n_shingles", "c1", "c2", "bands", "sig"],
                )

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sig_a", "sig_b"))
                keep = pa.array((a == b).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return run


def _confirm(k: int, percent: int):
    def sets(texts: list[bytes | None]) -> dict[bytes | None, np.ndarray]:
        out, todo = {}, list(dict.fromkeys(texts))
        for low, high in portions(todo):
            hashes, bounds = Words(todo[low:high], lower=True).shingles(k)
            for i in range(high - low):
                out[todo[low + i]] = np.unique(hashes[bounds[i] : bounds[i + 1]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
                known = sets(left + right)
                keep = []
                for x, y in zip(left, right, strict=True):
                    p, q = known[x], known[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links, batch by batch: (u, v), v the least of its tree."""
    for batch in batches:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while up.get(root, root) != root:
                root = up[root]
            while up.get(x, x) != root:
                up[x], x = root, up[x]
            return root

        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            up[max(p, q)] = min(p, q)
            up.setdefault(min(p, q), min(p, q))
        u = [x for x in up if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([find(x) for x in u], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of long ids to (id, comp): the least id that each linked id reaches, itself included."""
    edges = scratch.save(links.mapInArrow(_forest, "u long, v long").distinct(), "forest")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80, pivots: int = 32) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    Links texts whose shingle sets (``k`` words) have at least ``percent`` hundredths
    of their union in common. ``pivots`` is the size up to which a bucket compares its
    members by pairs, and beyond which in blocks; the result is the same.
    """
    bounded_batches(docs.sparkSession)
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = scratch.save(body.mapInArrow(_sketch(k, BANDS), "id long, n_shingles long, c1 long, c2 long, bands array<long>, sig binary"), "sketch")
    whole = sketched.where("n_shingles > 0 AND id IS NOT NULL")
    same = ["c1", "c2", "n_shingles"]
    classes = whole.groupBy(*same).agg(F.min("id").alias("rep"), F.max("id").alias("_top"))
    copies = whole.join(classes.where("rep < _top"), same).select("id", *same, "rep").distinct()
    copies = scratch.save(copies, "copies")
    # Of each class one row stays. A doc_id may have other texts besides a copy, so rows are told apart by their set too.
    text_of = ["id", *same]
    reps = whole.join(copies.where("id <> rep").select(*text_of).distinct(), text_of, "left_anti").dropDuplicates(text_of).select("id", "n_shingles", "bands", "sig")
    links = _links(body, reps, k, percent, pivots)
    edges = links.unionByName(copies.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    found = components(edges)
    out = sketched.select("id", "n_shingles").join(found, "id", "left").withColumn("component_id", F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _compare(s: dict, members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links between the chosen (bucket, pivot) and their buckets' members of other groups, confirmed."""
    named = members.select("bucket", F.col("id").alias("pivot"), F.col("comp").alias("_pc"), F.col("n").alias("_pn")).join(chosen, ["bucket", "pivot"])
    # Two sets have the smaller one in common at most.
    near = (100 * F.least("n", "_pn") >= s["percent"] * F.greatest("n", "_pn")) & (F.col("comp") != F.col("_pc"))
    pairs = members.join(named, "bucket").where(near).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    a, b = (s["sigs"].select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    likely = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(s["least"]), "a long, b long")
    likely = scratch.save(likely, "likely")
    a, b = (s["texts"].select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    fresh = likely.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(s["k"], s["percent"]), "a long, b long")
    return scratch.save(fresh.select(F.col("b").alias("u"), F.col("a").alias("v")), "links")


def _still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their groups as the links have them, of buckets that hold two groups or more."""
    left = members.drop("comp").join(components(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    left = scratch.save(left, "left")
    several = left.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("bucket")
    return scratch.save(left.join(several, "bucket"), "members")


def _block(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        outer, comp, ids = (table.column(c).to_numpy() for c in ("outer", "comp", "id"))
        sets = []
        for low, high in portions(texts):
            hashes, bounds = Words(texts[low:high], lower=True).shingles(k)
            sets += [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(high - low)]
        size = np.array([len(x) for x in sets])
        names, places = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        inner = np.flatnonzero(~outer)
        if not len(inner) or not outer.any():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        # The inner sets' elements end to end: an outer set counts those that it has, set by set.
        elements = np.concatenate([places[starts[i] : starts[i] + size[i]] for i in inner])
        edges = np.cumsum(size[inner]) - size[inner]
        u, v = [], []
        for i in np.flatnonzero(outer):
            mark = np.zeros(len(names), np.int32)
            mark[places[starts[i] : starts[i] + size[i]]] = 1
            both = np.add.reduceat(mark[elements], edges)
            hit = inner[(100 * both >= percent * (size[i] + size[inner] - both)) & (comp[inner] != comp[i])]
            u += np.maximum(ids[hit], ids[i]).tolist()
            v += np.minimum(ids[hit], ids[i]).tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _in_blocks(s: dict, members: DataFrame, block: int = 1 << 18) -> DataFrame:
    """All links of members outside their bucket's largest group, found in blocks of bounded size.

    A block holds about ``block`` shingles of these, and as many of the bucket's members,
    however long the texts are; it counts common shingles exactly and gives links alone, so
    no pair but a link is ever a row.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.sum("n").alias("_n"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    known = members.join(main, "bucket")
    outs, ins = F.ceil((F.col("_all") - F.col("_most")) / block).cast("int"), F.ceil(F.col("_all") / block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    row = ["bucket", "id", "comp"]
    a = known.where("comp <> _main").withColumns({"_o": F.pmod(F.xxhash64("id"), outs).cast("int"), "_i": every(ins)}).select(*row, "_o", "_i", F.lit(True).alias("outer"))
    b = known.withColumns({"_i": F.pmod(F.xxhash64("id", F.lit(1)), ins).cast("int"), "_o": every(outs)}).select(*row, "_o", "_i", F.lit(False).alias("outer"))
    rows = a.unionByName(b).join(s["texts"].select("id", "text"), "id")
    found = rows.groupBy("bucket", "_o", "_i").applyInArrow(_block(s["k"], s["percent"]), "u long, v long")
    return scratch.save(found.distinct(), "links")


def _links(body: DataFrame, reps: DataFrame, k: int, percent: int, pivots: int) -> DataFrame:
    every = reps.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("n"))
    shared = every.groupBy("bucket").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("bucket")
    members = scratch.save(every.join(shared, "bucket").withColumn("comp", F.col("id")), "members")
    wanted = members.select("id").distinct()
    deviation = (percent / 100 * (1 - percent / 100) / PLACES) ** 0.5
    s = {
        "k": k, "percent": percent, "least": percent / 100 - 6 * deviation,
        "sigs": scratch.save(reps.select("id", "sig").join(wanted, "id", "left_semi"), "sigs"),
        "texts": scratch.save(body.join(wanted, "id", "left_semi"), "texts"),
    }
    # One pivot a bucket: tight groups become one.
    chosen = scratch.save(members.groupBy("bucket").agg(F.min("id").alias("pivot")), "pivots")
    links = _compare(s, members, chosen)
    members = _still_open(members, links)
    # Small buckets compare all that is left; large ones a few members, by hash. Each task passes on the first few of
    # a bucket alone, so none is gathered to be ranked.
    crowded = members.groupBy("bucket").agg((F.count(F.lit(1)) > pivots).alias("big"))
    members = scratch.save(members.join(crowded, "bucket"), "crowded")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("id"), "id")
    first = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= pivots)
    chosen = scratch.save(first.where("NOT big OR _r <= 4").select("bucket", F.col("id").alias("pivot")), "pivots")
    links = links.unionByName(_compare(s, members, chosen))
    members = _still_open(members.where("big"), links)
    # What is still apart from the largest group of a large bucket.
    return links.unionByName(_in_blocks(s, members))
