"""Evaluation and comparison of retrieval: null means not scored, never 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")


def first_hits(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, rank, domain) and (qid, want) to (qid, first_hit_rank, reciprocal_rank, hit); null where nothing is wanted."""
    named = F.nullif(F.lower("want"), F.lit(""))
    met = wanted.select("qid", named.alias("want")).join(ranked, "qid", "left")
    first = met.groupBy("qid", "want").agg(F.min(F.when(F.lower("domain") == F.col("want"), F.col("rank"))).alias("first_hit_rank"))
    scored = F.col("want").isNotNull()
    return first.select("qid", "first_hit_rank", F.when(scored, F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))).alias("reciprocal_rank"), F.when(scored, F.col("first_hit_rank").isNotNull()).alias("hit"))


def recall_at_k(found: DataFrame, expected: DataFrame, fold: bool = False) -> DataFrame:
    """(qid, source_file) and (qid, fragment) to (qid, recall): which expected fragments stand in a retrieved path."""
    if fold:
        found, expected = found.withColumn("source_file", T.nfkc(F.col("source_file"))), expected.withColumn("fragment", T.nfkc(F.col("fragment")))
    paths = found.select("qid", T.normalize_path(F.col("source_file")).alias("_p")).distinct()
    parts = expected.select("qid", T.normalize_path(F.col("fragment")).alias("_f")).distinct()
    met = parts.join(paths, "qid", "left").groupBy("qid", "_f").agg(F.coalesce(F.max(F.contains("_p", "_f").cast("int")), F.lit(0)).alias("_hit"))
    return met.groupBy("qid").agg(F.avg("_hit").alias("recall"))


def scope_verdict(fired: Column, truth: Column, explicit: Column) -> tuple[Column, Column, Column]:
    """(fired, correct, recalled) of fired domains against true ones; recall counts only an explicit label."""
    fires = F.size(fired) > 0
    some = F.arrays_overlap(fired, truth)
    correct = F.when(fires & (F.size(truth) > 0), some)
    return fires, correct, F.when(F.size(explicit) > 0, F.coalesce(fires & F.arrays_overlap(fired, explicit), F.lit(False)))


def citation_validity(answer: Column, n_docs: Column) -> tuple[Column, Column]:
    """(rate of marks that name a document, the numbers that name none)."""
    used = T.citations(answer)
    valid = F.size(F.filter(used, lambda n: (n >= 1) & (n <= n_docs)))
    dangling = F.array_sort(F.array_distinct(F.filter(used, lambda n: (n < 1) | (n > n_docs))))
    return F.when(F.size(used) > 0, valid / F.size(used)), dangling


def groundedness(answers: DataFrame, docs: DataFrame, n: int = 2, fold: bool = False) -> DataFrame:
    """(qid, answer) and (qid, rank, text) to one row per answer: score, n_sentences_scored, n_sentences_uncited, worst_overlap, worst_sentence.

    A sentence with marks scores the largest share of its n-grams that a cited document has.
    ``fold`` brings both into normal form first, for text that may hold compatibility characters.
    """
    if fold:
        answers, docs = answers.withColumn("answer", T.nfkc(F.col("answer"))), docs.withColumn("text", T.nfkc(F.col("text")))
    each = answers.select("qid", F.posexplode_outer(T.sentences(F.col("answer"))).alias("at", "sentence"))
    size = docs.groupBy("qid").agg(F.max("rank").alias("_n"))
    cited = each.join(size, "qid", "left").select("qid", "at", "sentence", F.array_distinct(F.filter(T.citations(F.col("sentence")), lambda c: (c >= 1) & (c <= F.coalesce("_n", F.lit(0))))).alias("cited"))
    bare = F.regexp_replace("sentence", r"\[\d+\]", " ")
    # Words are a column of their own: within the n-grams' lambda they would be cut anew for each.
    own = cited.withColumn("_w", T.content_tokens(bare)).withColumn("_g", T.ngrams(F.col("_w"), n))
    pairs = own.where(F.size("_g") > 0).select("qid", "at", "_g", F.explode("cited").alias("rank"))
    grams = docs.select("qid", "rank", T.content_tokens(F.col("text")).alias("_w")).select("qid", "rank", T.ngrams(F.col("_w"), n).alias("_d"))
    overlap = pairs.join(grams, ["qid", "rank"]).groupBy("qid", "at").agg(F.max(F.size(F.array_intersect("_g", "_d")) / F.size("_g")).alias("overlap"))
    scored = cited.join(overlap, ["qid", "at"], "left")
    low = F.when(F.col("overlap").isNotNull(), F.struct("overlap", "at"))
    return scored.groupBy("qid").agg(F.avg("overlap").alias("score"), F.count("overlap").alias("n_sentences_scored"), F.count_if((F.size("cited") == 0) & F.col("sentence").isNotNull()).alias("n_sentences_uncited"), F.min("overlap").alias("worst_overlap"), F.min_by("sentence", low).alias("worst_sentence"))


def keyword_recall(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords))


def mean_scored(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Of each metric (numbers or booleans) the mean of what is scored, and how many are."""
    out = []
    for m in metrics:
        value = F.col(m).cast("double")
        out += [F.round(F.avg(value), digits).alias(m), F.count(m).alias(f"{m}_n")]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def calibration(rows: DataFrame, bucket: str, score: str) -> DataFrame:
    """One row per confidence: n, n_scored, mean, and the gap of HIGH over LOW."""
    label = F.upper(F.coalesce(F.nullif(F.col(bucket), F.lit("")), F.lit("UNKNOWN")))
    each = rows.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("n_scored"), F.round(F.avg(score), 3).alias("mean"))
    # One row over at most as many as there are labels.
    gap = each.agg(F.round(F.max(F.when(F.col("bucket") == "HIGH", F.col("mean"))) - F.max(F.when(F.col("bucket") == "LOW", F.col("mean"))), 3).alias("gap"))
    return each.crossJoin(F.broadcast(gap))


def judge_merge(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (i, gradable) with the scores (i, ord, correct, grounded) of a judge, the last of each i, within 0 and 1.

    A gradable row without a score fails the query: a partial file is no result.
    """
    last = scores.groupBy("i").agg(F.max_by(F.struct("correct", "grounded"), "ord").alias("_s"))
    met = rows.join(last, "i", "left")
    missing = F.when(F.col("gradable") & F.col("_s").isNull(), F.raise_error(F.format_string("no score for question %s", F.col("i").cast("string")))).otherwise(F.lit(True))
    return met.where(missing).select(*rows.columns, T.clamp_score(F.col("_s.correct")).alias("correct"), T.clamp_score(F.col("_s.grounded")).alias("grounded"))


def membership(branches: DataFrame) -> DataFrame:
    """Branch results (qid, branch, branch_ord, rank, chunk_id) to one row per chunk: in how many branches, which, rank spread."""
    n = branches.groupBy("qid").agg(F.count_distinct("branch").alias("_all"))
    each = branches.groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("n_branches"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch_ord", "branch"))), lambda b: b["branch"]), ",").alias("branches"), (F.max("rank") - F.min("rank")).alias("spread"))
    return each.join(n, "qid").select("qid", "chunk_id", "n_branches", "branches", F.when(F.col("n_branches") > 1, F.col("spread")).alias("spread"), (F.col("n_branches") == F.col("_all")).alias("is_common"), (F.col("n_branches") == 1).alias("is_unique"))


def pairwise(branches: DataFrame) -> DataFrame:
    """Each two branches of a query at the depth of the shorter: overlap, its rate, Jaccard."""
    depth = branches.groupBy("qid", "branch", "branch_ord").agg(F.count(F.lit(1)).alias("_d"))
    a = depth.select("qid", F.col("branch").alias("left"), F.col("branch_ord").alias("_a"), F.col("_d").alias("_da"))
    b = depth.select("qid", F.col("branch").alias("right"), F.col("branch_ord").alias("_b"), F.col("_d").alias("_db"))
    both = a.join(b, "qid").where("_a < _b").withColumn("depth", F.least("_da", "_db"))
    ids = branches.select("qid", "branch", "rank", "chunk_id")
    left = both.join(ids.withColumnRenamed("branch", "left"), ["qid", "left"]).where("rank <= depth")
    right = ids.select("qid", F.col("branch").alias("right"), F.col("rank").alias("_r"), "chunk_id")
    met = left.join(right, ["qid", "right", "chunk_id"], "left").groupBy("qid", "left", "right", "depth").agg(F.count_if(F.col("_r") <= F.col("depth")).alias("overlap"))
    return met.select("qid", "left", "right", "depth", "overlap", F.round(F.col("overlap") / F.col("depth"), 4).alias("overlap_rate"), F.round(F.col("overlap") / (2 * F.col("depth") - F.col("overlap")), 4).alias("jaccard"))


def judge_bundle(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, qid, question, answer) with the chunks that the answer cites: one row per gradable answer."""
    used = answers.select("i", "qid", "question", "answer", F.explode_outer(F.array_distinct(T.citations(F.col("answer")))).alias("n"))
    cited = used.join(docs.select("qid", F.col("rank").alias("n"), "chunk_id", "text"), ["qid", "n"], "left")
    chunk = F.when(F.col("chunk_id").isNotNull(), F.struct("n", "chunk_id", "text"))
    return cited.groupBy("i", "qid", "question", "answer").agg(F.array_sort(F.collect_list(chunk)).alias("cited_chunks"))


def read_scores(lines: DataFrame) -> DataFrame:
    """Lines (n, value) of a judge's file as (i, ord, correct, grounded); a line that is no object with ``i`` fails and is named."""
    value = F.regexp_replace("value", "^﻿", "")
    read = F.from_json(value, "i int, correct string, grounded string")
    wrong = F.raise_error(F.format_string("line %s of the scores is no score", F.col("n").cast("string")))
    parsed = lines.where(F.length(F.btrim("value")) > 0).select("n", read.alias("s"))
    return parsed.where(F.when(F.col("s.i").isNull(), wrong).otherwise(F.lit(True))).select("s.i", F.col("n").alias("ord"), "s.correct", "s.grounded")


#: The metrics of a report by tier.
TIERS = {"retrieval": ("hit", "reciprocal_rank", "recall"), "answer": ("keyword_recall", "citation_validity", "groundedness"), "judge": ("correct", "grounded")}


def report(rows: DataFrame) -> DataFrame:
    """One row: every metric that ``rows`` has, as its mean and how many rows are scored, and the number of questions and answers."""
    metrics = [m for tier in TIERS.values() for m in tier if m in rows.columns]
    answered = [F.count_if("answered").alias("n_answered")] if "answered" in rows.columns else []
    means = [c for m in metrics for c in (F.round(F.avg(F.col(m).cast("double")), 6).alias(m), F.count(m).alias(f"{m}_n"))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *answered, *means)


def scorecard(row: dict) -> str:
    """A report as a markdown table; what is not scored says so."""
    lines = ["| metric | mean | scored |", "|-|-|-|"]
    for m in (m for tier in TIERS.values() for m in tier if m in row):
        mean = "not scored" if row[m] is None else f"{row[m]:.3f}"
        lines.append(f"| {m} | {mean} | {row[f'{m}_n']} of {row['n']} |")
    return "\n".join(lines)
