"""Context expansion: parents in place of matches, and neighbouring pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lanes import small

#: Fixed value: what a neighbouring page begins with.
NEIGHBOR_MARK = "[supplementary context — adjacent page of the same source]\n"


def swap_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (qid, rank, chunk_id, parent_id, text): a parent's text stands for its best hit, its other hits go.

    Hits without a known parent pass through.
    """
    known = hits.join(parents.select("parent_id", F.col("text").alias("_parent")), "parent_id", "left")
    own = Window.partitionBy("qid", "parent_id").orderBy("rank")
    kept = known.withColumn("_n", F.row_number().over(own)).where("_parent IS NULL OR _n = 1")
    return kept.select("qid", "rank", "chunk_id", "parent_id", F.coalesce("_parent", "text").alias("text"), F.col("_parent").isNotNull().alias("swapped"))


def neighbor_candidates(hits: DataFrame, chunks: DataFrame, probe: int = 16) -> DataFrame:
    """Chunks on the pages beside a book's hits: (qid, rank, hit, chunk_id, page, delta, ord)."""
    books = hits.where("lower(file_type) = 'pdf' AND page_start IS NOT NULL AND source_file IS NOT NULL")
    sides = books.select("qid", "rank", F.col("chunk_id").alias("hit"), "source_file", "page_start", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    # The range |p - q| = 1 is two equalities.
    at = sides.select("qid", "rank", "hit", "source_file", "side", (F.col("page_start") + F.col("side")).alias("page"))
    pages = chunks.select("chunk_id", "source_file", F.col("page_start").alias("page"))
    near = small(at).join(pages, ["source_file", "page"])
    order = Window.partitionBy("qid", "rank").orderBy("side", "chunk_id")
    return near.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= probe).select("qid", "rank", "hit", "chunk_id", "page", "ord")


def add_neighbors(hits: DataFrame, chunks: DataFrame, per_doc: int = 2, total: int = 4, chars: int = 2500) -> DataFrame:
    """(qid, pos, neighbor_of, chunk_id, text): pages beside hits, in order of the hits, none twice, within both caps.

    Caps are greedy: what an earlier hit takes no later one can. Candidates per query are
    few by construction (hits x ``probe``), so one query is one group.
    """
    have = hits.select("qid", "chunk_id")
    free = neighbor_candidates(hits, chunks).join(have, ["qid", "chunk_id"], "left_anti")

    def take(group: pd.DataFrame) -> pd.DataFrame:
        taken, seen, by = [], set(), {}
        for r in group.sort_values(["rank", "ord"]).itertuples():
            if len(taken) < total and by.get(r.rank, 0) < per_doc and r.chunk_id not in seen:
                seen.add(r.chunk_id)
                by[r.rank] = by.get(r.rank, 0) + 1
                taken.append((r.qid, len(taken) + 1, r.hit, r.chunk_id))
        return pd.DataFrame(taken, columns=["qid", "pos", "neighbor_of", "chunk_id"])

    kinds = dict(free.dtypes)
    chosen = small(free.groupBy("qid").applyInPandas(take, f"qid {kinds['qid']}, pos long, neighbor_of {kinds['hit']}, chunk_id {kinds['chunk_id']}"))
    return chosen.join(chunks.select("chunk_id", F.concat(F.lit(NEIGHBOR_MARK), F.substring("text", 1, chars)).alias("text")), "chunk_id").select("qid", "pos", "neighbor_of", "chunk_id", "text")

