"""A training-data pipeline of five stages over ``documents``.

Toxic documents go, one document of each near-duplicate group stays, passages that a
smaller doc_id has are cut out, sources are mixed to their target weights, and what is
left is packed into sequences. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next stage's docs; all but the last
return the columns of ``documents``, and further ones that docs has. Each gives an empty
table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import minhash_dedup, mixing, packing, scratch, substring_dedup, toxicity
from corpuscle.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    """Tables that earlier stages left in the shared folder go, unless ``docs`` itself reads them."""

    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, "pipeline", docs.inputFiles())
        with scratch.scope("pipeline"):
            return run(spark, docs, sf_dir)

    return inner


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go. It never learns held-out labels.

    A null or empty text has the bias's score alone; each row of a repeated doc_id is judged
    by its own text; without labels of both kinds every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
    return toxicity.score(whole, model, keep=("whole",)).where("predicted = 0").select("whole.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest doc_id stays.

    All rows of that doc_id stay, even equal ones; null and blank texts and a null doc_id
    are in no group and stay.
    """
    gone = minhash_dedup.group(docs, k=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a smaller doc_id has go; documents of which nothing is left go too.

    A text that loses nothing stays as it is, null and blank ones too; a null doc_id neither
    loses words nor takes any from others; rows of one doc_id take none from each other.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    named = docs.select("doc_id", "text", F.struct("n_chars", *rest).alias("rest"))
    cut = substring_dedup.dedup(named, give_text=True, keep=("rest",)).where("n_removed = 0 OR n_removed < n_words")
    old = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))}
    return cut.select(*[old.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and of the last pass as far, as the mix of sources takes them.

    Null and blank texts have nothing to take and go; a null source is a source of its own;
    equal rows share what they take.
    """
    return mixing.apply(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, neighbours on the Hilbert curve together.

    Every row is a document of its own, told apart by ``row``; a null text has the end token alone.
    """
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: a trained classifier and a tokenizer decide. tests/llm/test_pipeline.py holds each stage against a restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        with scratch.scope("pipeline"):
            docs = scratch.save(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
