"""The library's front: one object over chunk tables, batched over questions.

Every method returns a DataFrame and runs nothing itself, except where a small side is
counted before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluation, expansion, fusion, index, lanes
from ..sources import config

Complete = Callable[[str], str]
#: Words by which a question asks for code.
CODE_SIGNALS = ("code", "function", "script", "snippet", "implement", "syntax", "python", "sql", "geom_", "pandas")


@dataclass
class Engine:
    """chunks: chunk_id, text, source_file, course, domain, file_type, tags, has_code, page_start, parent_id, jsonl, ord.

    vectors: chunk_id, embedding. parents: parent_id, text. questions: question_id, doc_id,
    embedding (generated questions). scopes: what signals in a question narrow the search
    to. hypothesis: writes a hypothetical answer to a question; encode: texts to vectors.
    All but chunks may be missing. ``settings`` are knobs of ``sources.config``; with
    ``auto_preset`` among them, questions about code take the preset ``code``.
    """

    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame | None = None
    parents: DataFrame | None = None
    questions: DataFrame | None = None
    settings: Mapping[str, Any] = field(default_factory=dict)
    presets: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    scopes: Sequence[lanes.Scope] = ()
    hypothesis: Complete | None = None
    encode: Callable[[list[str]], list[list[float]]] | None = None

    def _groups(self, queries: DataFrame, call: Mapping[str, Any]) -> list[tuple[DataFrame, dict[str, Any]]]:
        """Queries with the knobs that hold for them: questions about code may have some of their own."""
        plain, code = (config.resolve(call, self.presets, self.settings, about) for about in (False, True))
        if plain == code:
            return [(queries, plain)]
        about = T.first_signal(F.col("question"), CODE_SIGNALS).isNotNull()
        # Questions are few; one count tells which of both plans are needed.
        n, n_code = queries.agg(F.count(F.lit(1)), F.count_if(about)).first()
        groups = [(queries.where(~about), plain)] * (n > n_code or n == 0) + [(queries.where(about), code)] * (n_code > 0)
        return groups

    def _expanded(self, queries: DataFrame, knobs: Mapping[str, Any]) -> DataFrame:
        """(qid, question, searched): with a hypothetical answer behind the question, if that is on and there is one."""
        if not knobs["hyde"] or self.hypothesis is None:
            return queries.withColumn("searched", F.col("question"))
        code = T.first_signal(F.col("question"), CODE_SIGNALS).isNotNull()
        asked = queries.withColumn("_plain", code)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return asked.mapInPandas(_supposed(self.hypothesis), f"{kinds}, searched string")

    def _known(self, live: DataFrame | None) -> DataFrame:
        """All chunks, and the texts that a live lane brings along."""
        if live is None or "text" not in live.columns:
            return self.chunks
        fresh = live.select(F.col("chunk_id").cast(self.chunks.schema["chunk_id"].dataType).alias("chunk_id"), "text").dropDuplicates(["chunk_id"])
        return lanes.together(self.chunks, fresh.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti").select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(self.chunks.schema[c].dataType).alias(c) for c in self.chunks.columns]))

    def _lanes(self, queries: DataFrame, query_vectors: DataFrame | None, live: DataFrame | None, k: Mapping[str, Any]) -> DataFrame:
        searched = queries.select("qid", F.col("searched").alias("question"))
        if self.encode is not None:
            query_vectors = index.embed(searched, self.encode, "qid", "question").withColumnRenamed("embedding", "qvec")
        elif query_vectors is not None:
            query_vectors = query_vectors.join(queries.select("qid"), "qid", "left_semi")
        meta = self.chunks.select("chunk_id", "domain", "source_file", "file_type")
        at = lanes.ORDER
        near = self.vectors is not None and query_vectors is not None
        found = [lanes.dense_top(self.vectors, query_vectors, k["dense_k"], "dense", at["dense"])] if near else []
        sparse = [lanes.Sparse(k["sparse_k"], "sparse", at["sparse"])]
        if k["boost_code"]:
            code = meta.where(lanes.code_filter()).select("chunk_id")
            if near:
                found.append(lanes.dense_top(self.vectors.join(code, "chunk_id", "left_semi"), query_vectors, lanes.narrow(k["dense_k"]), "dense_code", at["dense_code"]))
            sparse.append(lanes.Sparse(lanes.narrow(k["sparse_k"]), "sparse_code", at["sparse_code"], where=lanes.code_filter()))
        if self.scopes and k["scope_routing"]:
            # Signals are looked for in the question itself; a hypothetical answer would add its own.
            scopes = lanes.scopes_of(queries.select("qid", "question"), self.scopes)
            if near:
                found.append(lanes.dense_scoped_top(self.vectors, meta, query_vectors, scopes, lanes.narrow(k["dense_k"]), "dense_scope", at["dense_scope"]))
            sparse.append(lanes.Sparse(lanes.narrow(k["sparse_k"]), "sparse_scope", at["sparse_scope"], scopes=scopes))
        # All lanes by words read the texts together.
        found.append(lanes.bm25_lanes(self.chunks, searched, sparse))
        if live is not None and k["live"]:
            found.append(live.join(queries.select("qid"), "qid", "left_semi").select(*found[0].columns))
        if self.questions is not None and near and k["hype"]:
            hits = lanes.dense_top(self.questions.select(F.col("question_id").alias("chunk_id"), "embedding"), query_vectors, 15, "questions", at["questions"])
            found.append(lanes.question_hits(hits.withColumnRenamed("chunk_id", "question_id"), self.questions))
        return lanes.together(*found)

    def _retrieved(self, queries: DataFrame, query_vectors: DataFrame | None, live: DataFrame | None, k: Mapping[str, Any]) -> DataFrame:
        asked = self._expanded(queries, k)
        fused = fusion.fuse(lanes.small(self._lanes(asked, query_vectors, live, k)), k["rrf_k"])
        if k["boost"] or k["boost_code"]:
            fused = fusion.boost(fused, self._known(live), asked.select("qid", F.col("searched").alias("question"), F.lit(bool(k["boost_code"])).alias("wants_code")))
        return fusion.ranked(fused)

    def retrieve(self, queries: DataFrame, query_vectors: DataFrame | None = None, live: DataFrame | None = None, **call: Any) -> DataFrame:
        """(qid, question) to fused and boosted candidates: qid, chunk_id, score, first_seen, rank.

        Lanes: BM25 and dense over all chunks; both again over code files for questions whose
        preset raises code, and over a question's scope where it names one; generated
        questions; and ``live``, a lane that is given.
        """
        parts = [self._retrieved(q, query_vectors, live, k).select("qid", "chunk_id", "score", "first_seen", "rank") for q, k in self._groups(queries, call)]
        return lanes.together(*parts)

    def search(self, queries: DataFrame, query_vectors: DataFrame | None = None, scorer: Any = None, live: DataFrame | None = None, **call: Any) -> DataFrame:
        """The best top_k sources of each question, reranked, with parents in place and neighbouring pages behind them.

        Columns: qid, rank, chunk_id, text, score, rerank_score, swapped, neighbor_of.
        """
        return lanes.together(*(self._searched(q, query_vectors, scorer, live, k)[0] for q, k in self._groups(queries, call)))

    def search_with_echo(self, queries: DataFrame, query_vectors: DataFrame | None = None, scorer: Any = None, live: DataFrame | None = None, **call: Any) -> tuple[DataFrame, DataFrame]:
        """``search``, and what it did for each question: qid, preset, boost_code, hyde_used, scope, candidates, live_hits, swaps, siblings_dropped, neighbors."""
        made = [self._searched(q, query_vectors, scorer, live, k) for q, k in self._groups(queries, call)]
        return lanes.together(*(docs for docs, _ in made)), lanes.together(*(echo for _, echo in made))

    def _searched(self, queries: DataFrame, query_vectors: DataFrame | None, scorer: Any, live: DataFrame | None, k: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        # Candidates are few; the echo, the texts and the neighbours all meet the same rows.
        found = lanes.small(self._retrieved(queries, query_vectors, live, k).select("qid", "chunk_id", "score", "first_seen", "rank"))
        pool = found.join(self._known(live), "chunk_id").join(queries, "qid")
        best = fusion.rerank(pool, k["rerank_mode"], k["top_k"], scorer, k["rerank_instruction"])
        columns = ["qid", "rank", "chunk_id", "text", "score", "rerank_score"]
        out = best.select(*columns, F.lit(False).alias("swapped"))
        if self.parents is not None and k["parent_context"]:
            scores = best.select("qid", "chunk_id", "score", "rerank_score")
            out = expansion.swap_parents(best.select("qid", "rank", "chunk_id", "parent_id", "text"), self.parents).join(scores, ["qid", "chunk_id"]).select(*columns, "swapped")
        out = out.withColumn("neighbor_of", F.lit(None).cast(self.chunks.schema["chunk_id"].dataType))
        if k["neighbor_context"] and {"page_start", "source_file"} <= set(self.chunks.columns):
            hits = lanes.small(out.select("qid", "rank", "chunk_id")).join(self.chunks.select("chunk_id", "source_file", "file_type", "page_start"), "chunk_id")
            last = out.groupBy("qid").agg(F.max("rank").alias("_last"))
            beside = expansion.add_neighbors(hits, self.chunks).join(last, "qid")
            none = F.lit(None).cast("double")
            out = lanes.together(out, beside.select("qid", (F.col("_last") + F.col("pos")).cast("int").alias("rank"), "chunk_id", "text", none.alias("score"), none.alias("rerank_score"), F.lit(False).alias("swapped"), "neighbor_of"))
        said = out.groupBy("qid").agg(
            F.count_if(F.col("chunk_id").cast("string").startswith("omni::")).alias("live_hits"), F.count_if("swapped").alias("swaps"), F.count_if(F.col("neighbor_of").isNotNull()).alias("neighbors"), F.count_if(F.col("neighbor_of").isNull()).alias("_left"),
        )
        echo = queries.select("qid", "question").join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates")), "qid", "left").join(best.groupBy("qid").agg(F.count(F.lit(1)).alias("_best")), "qid", "left").join(said, "qid", "left")
        if self.scopes and k["scope_routing"]:
            echo = echo.join(lanes.scopes_of(queries, self.scopes).select("qid", F.col("labels").alias("scope")), "qid", "left")
        else:
            echo = echo.withColumn("scope", F.lit(None).cast("array<string>"))
        used = self._expanded(queries, k).select("qid", (F.col("searched") != F.col("question")).alias("hyde_used"))
        number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out, echo.join(used, "qid").select("qid", F.lit(k["preset"]).cast("string").alias("preset"), F.lit(bool(k["boost_code"])).alias("boost_code"), "hyde_used", F.coalesce("scope", F.array().cast("array<string>")).alias("scope"), *map(number, ("candidates", "live_hits", "swaps", "neighbors")), F.coalesce(F.col("_best") - F.col("_left"), F.lit(0)).alias("siblings_dropped"))

    def compare(self, queries: DataFrame, branches: Mapping[str, Mapping[str, Any]], query_vectors: DataFrame | None = None) -> DataFrame:
        """Results of two to six named settings side by side: qid, branch, branch_ord, rank, chunk_id. Equal settings are searched once."""
        if not 2 <= len(branches) <= 6:
            raise ValueError("compare takes two to six branches")
        made: dict[str, DataFrame] = {}
        out = None
        for i, (name, call) in enumerate(branches.items()):
            key = repr(sorted(config.resolve(call, self.presets, self.settings).items(), key=lambda p: p[0]))
            made.setdefault(key, self.search(queries, query_vectors, **call).where("neighbor_of IS NULL").select("qid", "rank", "chunk_id"))
            one = made[key].select("qid", F.lit(name).alias("branch"), F.lit(i).alias("branch_ord"), "rank", "chunk_id")
            out = one if out is None else out.unionByName(one)
        return out

    def answer(self, queries: DataFrame, found: DataFrame, complete: Complete) -> DataFrame:
        """One answer per question from its sources: qid, answer, confidence, citations valid, dangling. Without sources the answer says so, with LOW confidence."""
        block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]\n"), F.btrim("text"))
        context = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"), F.max("rank").alias("n_docs"))
        asked = queries.join(context, "qid", "left").select("qid", "question", "context", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        said = asked.mapInPandas(_completed(complete), f"qid {dict(asked.dtypes)['qid']}, n_docs int, raw string")
        text = T.strip_reasoning(F.col("raw"))
        rate, dangling = evaluation.citation_validity(F.col("answer"), F.col("n_docs"))
        return said.select("qid", "n_docs", text.alias("answer")).select("qid", "answer", F.when(F.col("n_docs") == 0, "LOW").otherwise(T.confidence(F.col("answer"))).alias("confidence"), rate.alias("citation_validity"), dangling.alias("dangling"))

    def stats(self) -> DataFrame:
        return corpus.stats(self.chunks)

    def manifest(self) -> DataFrame:
        return corpus.manifest(self.chunks)


def _completed(complete: Complete) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [complete(f"{c}\n\n{q}") if c else "No sources were found." for q, c in zip(b["question"], b["context"], strict=True)]
            yield pd.DataFrame({"qid": b["qid"], "n_docs": b["n_docs"], "raw": raw})

    return run


def _supposed(hypothesis: Complete) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(question: str, plain: bool) -> str:
        try:
            text = "" if plain else (hypothesis(question) or "").strip()
        except Exception:  # without a hypothetical answer the question is searched as it is
            text = ""
        return f"{question}\n\n{text}" if text else question

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="_plain").assign(searched=[one(q, p) for q, p in zip(b["question"], b["_plain"], strict=True)])

    return run
