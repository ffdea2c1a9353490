"""Index tables: postings, document and term statistics, generated questions; built, appended and resumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus, lanes


def union_chunks(*files: DataFrame) -> DataFrame:
    """Chunk files in their order, each chunk_id in its first occurrence; a file given twice counts once."""
    seen: list[DataFrame] = []
    for f in files:
        if not any(f.sameSemantics(s) for s in seen):
            seen.append(f)
    ordered = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(seen)]
    out = ordered[0]
    for f in ordered[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return corpus.first_wins(out, "chunk_id", "_file", "ord").drop("_file")


def write(chunks: DataFrame, root: str) -> None:
    """The inverted index as Parquet: postings in ranges of terms, so that a query's terms prune files and row groups."""
    postings = lanes.postings(chunks)
    postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{root}/postings")
    spark = chunks.sparkSession
    saved = spark.read.parquet(f"{root}/postings")
    lanes.term_stats(saved).write.mode("overwrite").parquet(f"{root}/term_stats")
    lanes.corpus_stats(chunks).withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/corpus_stats")


def search(spark: SparkSession, root: str, queries: DataFrame, digits: int = 6) -> DataFrame:
    """As ``lanes.bm25``, from index tables."""
    asked = queries.select("qid", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    send = F.broadcast if asked.limit(lanes.MOST_BROADCAST + 1).count() <= lanes.MOST_BROADCAST else lanes.keep
    stats = spark.read.parquet(f"{root}/corpus_stats").select("n", "avgdl")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(spark.read.parquet(f"{root}/term_stats"), "term").crossJoin(F.broadcast(stats)).select("qid", "term", "avgdl", (F.col("qtf") * idf).alias("w"))
    part = F.col("w") * F.col("tf") / (F.col("tf") + lanes.K1 * (1 - lanes.B + lanes.B * F.col("dl") / F.col("avgdl")))
    met = spark.read.parquet(f"{root}/postings").join(send(weighted), "term")
    return met.groupBy("qid", "chunk_id").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")


def pending_questions(chunks: DataFrame, questions: DataFrame, include: str = "", file_types: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Chunks in scope that have no generated question yet, the first ``most`` by id if that is given."""
    scope = chunks
    if include:
        scope = scope.where(F.contains(F.lower("source_file"), F.lit(include.lower())))
    if file_types:
        scope = scope.where(F.col("file_type").isin(*file_types))
    done = questions.where(F.col("question_id").endswith("::q0")).select(F.col("doc_id").alias("chunk_id")).distinct()
    left = scope.join(done, "chunk_id", "left_anti")
    return left.orderBy("chunk_id").limit(most) if most else left


def generate_questions(pending: DataFrame, complete: Callable[[str], str], n: int = 3) -> DataFrame:
    """(question_id, doc_id, source_file, question) from a language model's answers, n a chunk at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["chunk_id"], "source_file": b["source_file"], "raw": [complete(t) for t in b["text"]]})

    kind = dict(pending.dtypes)["chunk_id"]
    said = pending.select("chunk_id", "source_file", "text").mapInPandas(run, f"doc_id {kind}, source_file string, raw string")
    each = said.select("doc_id", "source_file", F.posexplode(T.questions_of(F.col("raw"), n)).alias("j", "question"))
    return each.select(F.concat(F.col("doc_id").cast("string"), F.lit("::q"), F.col("j").cast("string")).alias("question_id"), "doc_id", "source_file", "question")


def embed(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "text", batch: int = 100) -> DataFrame:
    """(key, embedding) by an encoder of lists of texts, ``batch`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": [list(map(float, v)) for v in encode(part[text].tolist())]})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def live_lane(spark: SparkSession, provider: Callable[[str], list[dict]], asked: list[tuple[int, str]], suffixes: tuple[str, ...] = ("md",), least: int = 40, k: int = 8) -> DataFrame:
    """Hits of a live search as a lane; a provider that fails gives none. Questions are as many as a call has."""
    rows = []
    for qid, question in asked:
        try:
            hits = provider(question)
        except Exception:  # a live lane is an addition; the others answer without it
            hits = []
        good = [h for h in hits if h["path"].rsplit(".", 1)[-1].lower() in suffixes and len(h.get("excerpt") or "") >= least]
        rows += [(qid, "live", lanes.ORDER["live"], i, f"omni::{h['path']}", None, h["excerpt"]) for i, h in enumerate(good[:k])]
    return spark.createDataFrame(rows, "qid long, lane string, lane_ord int, rank0 int, chunk_id string, score double, text string")


def read_pages(images: DataFrame, engine: Callable[[bytes], str]) -> DataFrame:
    """(book, page, image) to (book, page, text, error) by an OCR engine; the first lost connection ends a task's calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = ""
        for b in batches:
            texts, errors = [], []
            for image in b["image"]:
                text, error = None, broken
                if not broken:
                    try:
                        text = engine(image)
                    except ConnectionError as e:
                        broken = error = f"ConnectionError: {e}"
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error or None)
            yield pd.DataFrame({"book": b["book"], "page": b["page"], "text": texts, "error": errors})

    return images.select("book", "page", "image").mapInPandas(run, "book string, page int, text string, error string")


def inject_pages(pages: DataFrame, read: DataFrame, scanned: Column | None = None, least: int = 50) -> DataFrame:
    """Pages (book, page, text) with what OCR read in place of what has no text of its own."""
    thin = F.length(F.btrim(F.coalesce("text", F.lit("")))) < least if scanned is None else scanned
    new = read.select("book", "page", F.nullif(F.btrim("text"), F.lit("")).alias("_t"))
    return pages.join(new, ["book", "page"], "left").withColumn("text", F.when(thin, F.coalesce("_t", "text")).otherwise(F.col("text"))).drop("_t")
