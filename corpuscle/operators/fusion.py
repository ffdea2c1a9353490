"""Reciprocal rank fusion of lanes, boosts and rerankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60


def fuse(lanes: DataFrame, k: int = RRF_K, digits: int = 6) -> DataFrame:
    """Lanes (qid, lane, lane_ord, rank0, chunk_id) to (qid, chunk_id, score, first_seen, ranks).

    A lane gives 1 / (k + rank), ranks from 0. ``first_seen`` orders equal scores: the first
    lane that has a chunk, and its rank there.
    """
    seen = F.min(F.struct("lane_ord", "rank0"))
    fused = lanes.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank0"))), digits).alias("score"), seen.alias("_s"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane", "rank0")))).alias("ranks"))
    return fused.select("qid", "chunk_id", "score", (F.col("_s.lane_ord") * 1000 + F.col("_s.rank0")).alias("first_seen"), "ranks")


def order_of(*order: Column) -> Column:
    """Ranks from 1 within a query."""
    return F.row_number().over(Window.partitionBy("qid").orderBy(*order))


def ranked(fused: DataFrame, limit: int | None = None) -> DataFrame:
    out = fused.withColumn("rank", order_of(F.col("score").desc(), F.col("first_seen")))
    return out.where(F.col("rank") <= limit) if limit else out


def boost(fused: DataFrame, chunks: DataFrame, queries: DataFrame, tag_factor: float = 1.15, code_factor: float = 1.2, digits: int = 6) -> DataFrame:
    """Raise chunks a tag of which stands in the question, and chunks with code if it asks for code.

    ``queries`` is (qid, question, wants_code); a tag counts from three letters on, as part of
    any word, and not if it is ``unknown`` or ``general``. Order before decides ties.
    """
    said = F.lower(F.col("question"))
    fits = F.exists(F.transform("tags", lambda t: F.lower(t)), lambda t: (F.length(t) >= 3) & ~t.isin("unknown", "general") & F.contains(said, t))
    meta = chunks.select("chunk_id", "tags", "has_code")
    raised = F.col("score") * F.when(fits, tag_factor).otherwise(1.0) * F.when(F.col("wants_code") & F.col("has_code"), code_factor).otherwise(1.0)
    before = fused.withColumn("_before", order_of(F.col("score").desc(), F.col("first_seen")))
    return before.join(meta, "chunk_id").join(queries, "qid").select("qid", "chunk_id", F.round(raised, digits).alias("score"), F.col("_before").alias("first_seen"))


def lexical_hits(terms: Column, words: Column) -> Column:
    """A text's words that are query terms, in order of name, so that a term's number is the length of its run."""
    return F.array_sort(F.filter(words, lambda w: F.array_contains(terms, w)))


def lexical_score(hits: Column, n_words: Column) -> Column:
    """Coverage of the query terms by a text's words, damped by repeats and length. ``hits`` must be a column that is there already."""
    # The first of a run weighs by its term, the next three by half of that.
    same = lambda i, back: F.coalesce(F.get(hits, i - back) == F.get(hits, i), F.lit(False))
    part = lambda w, i: F.least(F.length(w), F.lit(8)) / 8.0 * F.when(~same(i, 1), 1.0).when(~same(i, 4), 0.5).otherwise(0.0)
    total = F.aggregate(F.transform(hits, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(n_words > 0, total / (1 + n_words / 500.0)).otherwise(0.0)


def lexical_terms(question: Column) -> Column:
    """A question's distinct terms of three letters or more."""
    return F.filter(F.array_distinct(T.lexical_tokens(question)), lambda t: F.length(t) > 2)


def rerank(docs: DataFrame, mode: str, k: int, scorer: object = None, instruction: str = "", digits: int = 6) -> DataFrame:
    """The k best (qid, rank before, question, text) by mode; equal scores keep their order.

    ``lexical`` scores within the plan, ``none`` keeps the order, ``cross_encoder`` and ``http``
    take ``scorer``, a pandas UDF of (query, text), which is given ``instruction`` before the
    question; a scorer that leaves a document without a score fails the query rather than
    dropping it.
    """
    if mode == "none":
        return docs.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    if mode == "lexical":
        # Columns of their own: within the score's lambdas they would be made anew for each word.
        docs = docs.withColumns({"_terms": lexical_terms(F.col("question")), "_words": T.lexical_tokens(F.col("text"))})
        docs = docs.withColumns({"_hits": lexical_hits(F.col("_terms"), F.col("_words")), "_n": F.size("_words")})
        value = F.round(lexical_score(F.col("_hits"), F.col("_n")), digits)
    elif mode in ("cross_encoder", "http"):
        if scorer is None:
            raise ValueError(f"mode {mode!r} needs a scorer")
        asked = F.concat(F.lit(scoring_query("", instruction, mode)), F.col("question"))
        given = scorer(asked, F.col("text"))
        value = F.when(given.isNull(), F.raise_error(F.lit("the scorer left a document without a score"))).otherwise(given)
    else:
        raise ValueError(f"unknown rerank mode {mode!r}")
    scored = docs.withColumn("rerank_score", value).withColumnRenamed("rank", "_before")
    return scored.withColumn("rank", order_of(F.col("rerank_score").desc(), F.col("_before"))).where(F.col("rank") <= k).drop("_before", "_terms", "_words", "_hits", "_n")


def scoring_query(question: str, instruction: str, mode: str) -> str:
    """The question as a scorer sees it; modes without a model ignore an instruction."""
    return f"{instruction}\n{question}" if instruction and mode in ("cross_encoder", "http") else question
