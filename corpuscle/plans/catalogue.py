"""Registered queries over the test tables, and the same in SQL.

``documents`` plays the chunk table, ``embeddings`` the vectors, ``benchmark`` the
questions; columns that it lacks are derived in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluation, expansion, fusion, lanes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a chunk table."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("chunk_id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("domain"),
        F.when(d % 7 == 0, "unknown").otherwise(F.concat(F.lit("course "), (d % 5).cast("string"))).alias("course"),
        F.element_at(F.array(*map(F.lit, ("note", "pdf", "py", "ipynb"))), (d % 4 + 1).cast("int")).alias("file_type"),
        F.array(F.concat(F.lit("t"), (d % 3).cast("string")), F.col("lang")).alias("tags"), (d % 5 == 0).alias("has_code"),
        F.floor(d / 40).cast("int").alias("page_start"), F.concat(F.lit("part"), (d % 2).cast("string"), F.lit(".jsonl")).alias("jsonl"), d.alias("ord"),
    )


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, text, source AS source_file, lang AS domain,
  CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE 'course ' || (doc_id % 5) END AS course,
  (['note','pdf','py','ipynb'])[(doc_id % 4 + 1)::INT] AS file_type, ['t' || (doc_id % 3), lang] AS tags,
  doc_id % 5 = 0 AS has_code, CAST(floor(doc_id / 40) AS INT) AS page_start, 'part' || (doc_id % 2) || '.jsonl' AS jsonl, doc_id AS ord FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions have no vectors of their own; the vector of the same number stands in."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    return read(spark, sf_dir, "benchmark").select("item_id").join(v, "item_id").select(F.col("item_id").alias("qid"), "qvec")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


BM25 = """toks AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
cs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
asked AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM asked GROUP BY ALL),
post AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
bm AS (SELECT qid, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN dfs USING (term), cs GROUP BY ALL)"""
DENSE = """vec AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
qv AS (SELECT item_id AS qid, v AS q FROM benchmark JOIN vec ON item_id = chunk_id),
de AS (SELECT qid, chunk_id, round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) AS score FROM vec, qv)"""


def top_sql(source: str, k: int, lane: str, ord_: int) -> str:
    return f"(SELECT qid, '{lane}' AS lane, {ord_} AS lane_ord, rank0, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank0 FROM {source}) WHERE rank0 < {k})"


def main_lanes(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    dense = lanes.dense_top(vectors(spark, sf_dir), query_vectors(spark, sf_dir), k, "dense", 0)
    return lanes.small(lanes.together(dense, lanes.bm25_top(c, q, k, "sparse", 1)))


LANES = f"{BM25}, {DENSE}, lanes AS ({top_sql('de', 20, 'dense', 0)} UNION ALL {top_sql('bm', 20, 'sparse', 1)})"
FUSED = f"{LANES}, fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank0)), 6) AS score, min(lane_ord * 1000 + rank0) AS first_seen FROM lanes GROUP BY ALL)"
RANKED = f"{FUSED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen) AS rank FROM fused)"


@register("SELECT doc_id, substring(sha256(source || '::' || substring(text, 1, 500)), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"))


@register("SELECT chunk_id, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, substring(sha256(source || '::' || substring(text, 1, 500)), 1, 16) AS chunk_id FROM documents) GROUP BY ALL")
def dedup_first_wins(spark, sf_dir):
    ids = chunk_ids(spark, sf_dir)
    n = ids.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.first_wins(ids, "chunk_id", "doc_id").join(n, "chunk_id").select("chunk_id", "doc_id", "n")


@register("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def token_stats(spark, sf_dir):
    return lanes.postings(chunks(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@register("SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return lanes.corpus_stats(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@register(f"WITH {BM25} SELECT qid, rank0, chunk_id, score FROM {top_sql('bm', 20, 's', 0)}")
def bm25_topk(spark, sf_dir):
    return lanes.bm25_top(chunks(spark, sf_dir), questions(spark, sf_dir), 20, "s", 0).select("qid", "rank0", "chunk_id", "score")


@register(f"WITH {DENSE} SELECT qid, rank0, chunk_id, score FROM {top_sql('de', 20, 'd', 0)}")
def dense_topk(spark, sf_dir):
    return lanes.dense_top(vectors(spark, sf_dir), query_vectors(spark, sf_dir), 20, "d", 0).select("qid", "rank0", "chunk_id", "score")


@register(f"WITH {CHUNKS}, {DENSE}, f AS (SELECT de.* FROM de JOIN chunks USING (chunk_id) WHERE domain IN ('en','de') AND (contains(lower(source_file), 'src1') OR file_type = 'pdf')) SELECT qid, rank0, chunk_id, score FROM {top_sql('f', 10, 'd', 0)}")
def dense_filtered_topk(spark, sf_dir):
    meta = chunks(spark, sf_dir).select("chunk_id", "domain", "source_file", "file_type")
    kept = vectors(spark, sf_dir).join(meta, "chunk_id")
    found = lanes.dense_top(kept, query_vectors(spark, sf_dir), lanes.narrow(20), "d", 0, lanes.scope_filter(["EN", "de"], ["SRC1"], ["pdf"]))
    return found.select("qid", "rank0", "chunk_id", "score")


@register(f"WITH {FUSED} SELECT qid, chunk_id, score, first_seen FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion.fuse(main_lanes(spark, sf_dir)).select("qid", "chunk_id", "score", F.col("first_seen").cast("long").alias("first_seen"))


WANTS = "(qid % 2 = 0)"


@register(f"""WITH {CHUNKS}, {RANKED}, q AS (SELECT item_id AS qid, lower(text) AS said FROM benchmark),
b AS (SELECT r.qid, r.chunk_id, r.rank AS before, round(r.score * CASE WHEN len(list_filter(tags, lambda t: len(t) >= 3 AND lower(t) NOT IN ('unknown','general') AND contains(said, lower(t)))) > 0 THEN 1.15 ELSE 1 END
  * CASE WHEN r.qid % 2 = 0 AND has_code THEN 1.2 ELSE 1 END, 6) AS score FROM ranked r JOIN chunks USING (chunk_id) JOIN q USING (qid))
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM b""")
def metadata_boost(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("wants_code", F.col("qid") % 2 == 0)
    return fusion.ranked(fusion.boost(fusion.fuse(main_lanes(spark, sf_dir)), chunks(spark, sf_dir), q)).select("qid", "chunk_id", "score", "rank")


@register(f"WITH {CHUNKS}, {BM25}, f AS (SELECT bm.* FROM bm JOIN chunks USING (chunk_id) WHERE file_type IN ('ipynb','py','r','rmd')) SELECT qid, rank0, chunk_id, score FROM {top_sql('f', 10, 'c', 0)}")
def code_lane(spark, sf_dir):
    found = lanes.bm25_top(chunks(spark, sf_dir), questions(spark, sf_dir), lanes.narrow(20), "c", 3, lanes.code_filter())
    return found.select("qid", "rank0", "chunk_id", "score")


SIGNALS = (("domain", "ml", ("gradient", "neural net")), ("domain", "db", ("sql", "join_")), ("content", "book", ("textbook", "chapter")), ("content", "plot", ("geom_", "chart")))
ASKED = (("1", "Which SQL joins do the textbooks compare?"), ("2", "Show geom_point in a Chart"), ("3", "gradients of a neural net"), ("4", "encoder charter"), ("5", "join_left and sql"))


@register("""WITH q(qid, question) AS (VALUES ('1','Which SQL joins do the textbooks compare?'),('2','Show geom_point in a Chart'),('3','gradients of a neural net'),('4','encoder charter'),('5','join_left and sql')),
s(kind, name, ord, signal, pattern) AS (VALUES ('domain','ml',0,'gradient','\\bgradients?\\b'),('domain','ml',1,'neural net','\\bneural nets?\\b'),('domain','db',0,'sql','\\bsqls?\\b'),('domain','db',1,'join_','\\bjoin_'),
('content','book',0,'textbook','\\btextbooks?\\b'),('content','book',1,'chapter','\\bchapters?\\b'),('content','plot',0,'geom_','\\bgeom_'),('content','plot',1,'chart','\\bcharts?\\b'))
SELECT qid, kind, name, arg_min(signal, ord) AS signal FROM q, s WHERE regexp_matches(lower(question), pattern) GROUP BY ALL""")
def scope_routing(spark, sf_dir):
    rows = [(kind, name, i, s, T.signal_pattern(s)) for kind, name, signals in SIGNALS for i, s in enumerate(signals)]
    signals = spark.createDataFrame(rows, "kind string, name string, ord int, signal string, pattern string")
    return lanes.detect_scope(spark.createDataFrame(ASKED, "qid string, question string"), signals)


@register(f"""WITH {DENSE}, h AS {top_sql('de', 15, 'h', 0)}, o AS (SELECT qid, chunk_id % 97 AS doc_id, min(rank0) AS r FROM h GROUP BY ALL)
SELECT qid, doc_id AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY r, doc_id) - 1 AS rank0 FROM o""")
def hype_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    hits = lanes.dense_top(v, query_vectors(spark, sf_dir), 15, "h", 0).withColumnRenamed("chunk_id", "question_id")
    asked = v.select(F.col("chunk_id").alias("question_id"), (F.col("chunk_id") % 97).alias("doc_id"))
    return lanes.question_hits(hits, asked).select("qid", "chunk_id", "rank0")


def pool(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """Fused hits with their question and text."""
    ranked = fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir)), k)
    return ranked.join(chunks(spark, sf_dir), "chunk_id").join(questions(spark, sf_dir), "qid")


@register(f"""WITH {RANKED}, p AS (SELECT qid, rank, chunk_id, regexp_extract_all(lower(d.text), '[a-z0-9_]+') AS w, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9_]+'), lambda t: len(t) > 2)) AS q
  FROM ranked JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = qid),
u AS (SELECT qid, rank, chunk_id, len(w) AS n, unnest(q) AS term, w FROM p),
t AS (SELECT qid, rank, chunk_id, n, term, len(list_filter(w, lambda x: x = term)) AS c FROM u),
s AS (SELECT qid, rank AS before, chunk_id, round(sum(CASE WHEN c > 0 THEN least(len(term), 8) / 8.0::DOUBLE * (1 + 0.5::DOUBLE * least(c - 1, 3)) ELSE 0 END) / (1 + n / 500.0::DOUBLE), 6) AS rerank_score FROM t GROUP BY qid, rank, chunk_id, n),
z AS (SELECT p.qid, p.rank AS before, p.chunk_id, coalesce(rerank_score, 0) AS rerank_score FROM p LEFT JOIN s ON s.qid = p.qid AND s.chunk_id = p.chunk_id)
SELECT * FROM (SELECT qid, chunk_id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, before) AS rank FROM z) WHERE rank <= 7""")
def lexical_rerank(spark, sf_dir):
    return fusion.rerank(pool(spark, sf_dir), "lexical", 7).select("qid", "chunk_id", "rerank_score", "rank")


@register(f"WITH {RANKED} SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 7")
def rerank_none(spark, sf_dir):
    return fusion.rerank(fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir))), "none", 7).select("qid", "chunk_id", "rank")


@register(f"""WITH {RANKED}, {CHUNKS}, parents AS (SELECT source_file AS parent_id, count(*) AS n, min(chunk_id) AS first FROM chunks WHERE source_file <> 'src3' GROUP BY ALL),
h AS (SELECT r.qid, r.rank, r.chunk_id, c.source_file AS parent_id, p.n, p.first, row_number() OVER (PARTITION BY r.qid, c.source_file ORDER BY r.rank) AS k FROM ranked r JOIN chunks c USING (chunk_id) LEFT JOIN parents p ON p.parent_id = c.source_file)
SELECT qid, rank, chunk_id, parent_id, CASE WHEN n IS NOT NULL THEN parent_id || ':' || n || ':' || first ELSE 'chunk ' || chunk_id END AS text, n IS NOT NULL AS swapped FROM h WHERE n IS NULL OR k = 1""")
def parent_swap(spark, sf_dir):
    c = chunks(spark, sf_dir)
    parents = c.where("source_file <> 'src3'").groupBy(F.col("source_file").alias("parent_id")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))
    parents = parents.select("parent_id", F.concat_ws(":", "parent_id", "n", "first").alias("text"))
    hits = fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir))).join(c.select("chunk_id", F.col("source_file").alias("parent_id")), "chunk_id")
    return expansion.swap_parents(hits.select("qid", "rank", "chunk_id", "parent_id", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("text")), parents)


@register(f"""WITH {RANKED}, {CHUNKS}, hits AS (SELECT qid, rank, chunk_id, source_file, page_start FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 7 AND file_type = 'pdf'),
c AS (SELECT h.qid, h.rank, h.chunk_id AS hit, c.chunk_id, c.page_start AS page, c.page_start - h.page_start AS side FROM hits h JOIN chunks c ON c.source_file = h.source_file AND abs(c.page_start - h.page_start) = 1)
SELECT qid, rank, hit, chunk_id, page, ord FROM (SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY side, chunk_id) AS ord FROM c) WHERE ord <= 16""")
def neighbor_pages(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir)), 7).join(c.select("chunk_id", "source_file", "file_type", "page_start"), "chunk_id")
    return expansion.neighbor_candidates(hits, c)


@register()
def neighbor_expansion(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir)), 7).join(c.select("chunk_id", "source_file", "file_type", "page_start"), "chunk_id")
    return expansion.add_neighbors(hits, c)


@register(f"""WITH {RANKED} SELECT r.qid, r.rank, r.chunk_id, r.score, d.rank0 AS dense_rank, s.rank0 AS sparse_rank FROM ranked r
LEFT JOIN lanes d ON d.qid = r.qid AND d.chunk_id = r.chunk_id AND d.lane = 'dense' LEFT JOIN lanes s ON s.qid = r.qid AND s.chunk_id = r.chunk_id AND s.lane = 'sparse' WHERE r.rank <= 7""")
def hybrid_search(spark, sf_dir):
    """BM25 and dense top 20 of every question, fused, the best seven with their lane ranks."""
    out = fusion.ranked(fusion.fuse(main_lanes(spark, sf_dir)), 7)
    return out.select("qid", "rank", "chunk_id", "score", F.col("ranks")["dense"].alias("dense_rank"), F.col("ranks")["sparse"].alias("sparse_rank"))


SCOPES = (lanes.Scope("en", ("english corner",)), lanes.Scope("books", ("pdf page",), ("src1",), ("pdf",)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, some of them about code, a domain or a kind of content."""
    q = F.col("qid")
    code = F.when(q % 5 == 0, "show the python code for ").otherwise("")
    scope = F.when(q % 4 == 1, " in the english corner").when(q % 4 == 2, " as pdf pages").otherwise("")
    return questions(spark, sf_dir).select("qid", F.concat(code, "question", scope).alias("question"))


ENGINE = f"""{CHUNKS}, q AS (SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'show the python code for ' ELSE '' END || text || CASE item_id % 4 WHEN 1 THEN ' in the english corner' WHEN 2 THEN ' as pdf pages' ELSE '' END AS question FROM benchmark),
s AS (SELECT qid, regexp_matches(lower(question), '\\b(code|function|script|snippet|implement|syntax|python|sql|pandas)s?\\b|\\bgeom_') AS code, regexp_matches(lower(question), '\\benglish corners?\\b') AS en, regexp_matches(lower(question), '\\bpdf pages?\\b') AS books FROM q),
{BM25.replace("SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q")}, {DENSE},
sd AS (SELECT qid, chunk_id FROM s, chunks WHERE (en OR books) AND (NOT en OR domain = 'en') AND (NOT books OR contains(source_file, 'src1') OR file_type = 'pdf')),
cd AS (SELECT qid, chunk_id FROM s, chunks WHERE code AND file_type IN ('ipynb','py','r','rmd')),
d2 AS (SELECT de.* FROM de JOIN cd USING (qid, chunk_id)), b2 AS (SELECT bm.* FROM bm JOIN cd USING (qid, chunk_id)), d3 AS (SELECT de.* FROM de JOIN sd USING (qid, chunk_id)), b3 AS (SELECT bm.* FROM bm JOIN sd USING (qid, chunk_id)),
lanes AS ({top_sql('de', 20, 'dense', 0)} UNION ALL {top_sql('bm', 20, 'sparse', 1)} UNION ALL {top_sql('d2', 10, 'dense_code', 2)} UNION ALL {top_sql('b2', 10, 'sparse_code', 3)} UNION ALL {top_sql('d3', 10, 'dense_scope', 4)} UNION ALL {top_sql('b3', 10, 'sparse_scope', 5)}),
fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank0)), 6) AS score, min(lane_ord * 1000 + rank0) AS first_seen FROM lanes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seen) AS before FROM fused),
raised AS (SELECT r.qid, chunk_id, before, round(r.score * CASE WHEN len(list_filter(tags, lambda t: len(t) >= 3 AND lower(t) NOT IN ('unknown','general') AND contains(lower(question), lower(t)))) > 0 THEN 1.15 ELSE 1 END * CASE WHEN code AND has_code THEN 1.2 ELSE 1 END, 6) AS score FROM ranked r JOIN chunks USING (chunk_id) JOIN q USING (qid) JOIN s USING (qid)),
ended AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM raised)"""


def _engine(spark: SparkSession, sf_dir: str):
    from .engine import Engine

    return Engine(spark, chunks(spark, sf_dir), vectors(spark, sf_dir), scopes=SCOPES, presets={"code": {"boost_code": True}}, settings={"auto_preset": True, "rerank_mode": "none", "neighbor_context": False})


@register(f"WITH {ENGINE} SELECT qid, rank, chunk_id, score FROM ended WHERE rank <= 7")
def engine_search(spark, sf_dir):
    """The engine over questions with and without signals: all lanes, fused, boosted, the best seven."""
    return _engine(spark, sf_dir).search(_asked(spark, sf_dir), query_vectors(spark, sf_dir)).select("qid", "rank", "chunk_id", "score")


@register(f"""WITH {ENGINE} SELECT qid, CASE WHEN code THEN 'code' END AS preset, code AS boost_code, concat_ws(',', CASE WHEN books THEN 'content:books' END, CASE WHEN en THEN 'domain:en' END) AS scope, (SELECT count(*) FROM ended WHERE ended.qid = s.qid) AS candidates FROM s""")
def engine_echo(spark, sf_dir):
    _, echo = _engine(spark, sf_dir).search_with_echo(_asked(spark, sf_dir), query_vectors(spark, sf_dir))
    return echo.select("qid", "preset", "boost_code", F.array_join("scope", ",").alias("scope"), "candidates")


MANIFEST = f"""{CHUNKS}, each_file AS (SELECT source_file, jsonl, count(*) AS chunks, arg_max(course, ord) FILTER (WHERE lower(course) <> 'unknown') AS course, arg_max(domain, ord) FILTER (WHERE lower(domain) <> 'general') AS domain FROM chunks GROUP BY ALL),
ft AS (SELECT source_file, string_agg(file_type, ',' ORDER BY jsonl, o) AS file_types FROM (SELECT source_file, file_type, min(jsonl) AS jsonl, arg_min(o, jsonl) AS o FROM (SELECT source_file, jsonl, file_type, min(ord) AS o FROM chunks GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
tg AS (SELECT source_file, jsonl, tag, min(ord * 10 + i) AS o FROM (SELECT source_file, jsonl, ord, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM chunks) GROUP BY ALL),
tt AS (SELECT source_file, string_agg(tag, ',' ORDER BY jsonl, o) AS tags FROM (SELECT source_file, tag, min(jsonl) AS jsonl, arg_min(o, jsonl) AS o FROM tg GROUP BY ALL) GROUP BY ALL),
manifest AS (SELECT source_file, CAST(sum(chunks) AS BIGINT) AS chunks, arg_min(course, jsonl) FILTER (WHERE course IS NOT NULL) AS course, arg_min(domain, jsonl) AS domain, string_agg(jsonl, ',' ORDER BY jsonl) AS jsonls FROM each_file GROUP BY ALL)"""


@register(f"WITH {MANIFEST} SELECT source_file, chunks, course, domain, file_types, tags, jsonls FROM manifest JOIN ft USING (source_file) JOIN tt USING (source_file)")
def manifest(spark, sf_dir):
    m = corpus.manifest(chunks(spark, sf_dir))
    return m.select("source_file", "chunks", "course", "domain", *[F.array_join(c, ",").alias(c) for c in ("file_types", "tags", "jsonls")])


@register(f"""WITH {MANIFEST} SELECT 'total' AS facet, 'files' AS value, count(*) AS n FROM manifest UNION ALL SELECT 'total', 'chunks', CAST(sum(chunks) AS BIGINT) FROM manifest
UNION ALL SELECT 'domain', domain, CAST(sum(chunks) AS BIGINT) FROM manifest GROUP BY domain UNION ALL SELECT 'jsonl', j, CAST(sum(chunks) AS BIGINT) FROM (SELECT unnest(string_split(jsonls, ',')) AS j, chunks FROM manifest) GROUP BY j""")
def overview(spark, sf_dir):
    return corpus.overview(corpus.manifest(chunks(spark, sf_dir)))


@register(f"""WITH {MANIFEST} SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM manifest GROUP BY domain UNION ALL SELECT 'course', course, count(*) FROM manifest WHERE course IS NOT NULL GROUP BY course
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(string_split(tags, ',')) AS t FROM tt) GROUP BY t""")
def facets(spark, sf_dir):
    return corpus.facets(corpus.manifest(chunks(spark, sf_dir)))


@register(f"WITH {CHUNKS} SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM chunks GROUP BY domain UNION ALL SELECT 'file_type', file_type, count(*) FROM chunks GROUP BY file_type UNION ALL SELECT 'course', course, count(*) FROM chunks GROUP BY course")
def stats(spark, sf_dir):
    return corpus.stats(chunks(spark, sf_dir))


@register(f"WITH {MANIFEST}, f AS (SELECT source_file, chunks, domain FROM manifest JOIN tt USING (source_file) WHERE contains(source_file, 'src1') AND list_contains(string_split(tags, ','), 't1')) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY chunks DESC, source_file LIMIT 4 OFFSET 2")
def documents_page(spark, sf_dir):
    page = corpus.documents(corpus.manifest(chunks(spark, sf_dir)), q="SRC1", tag="#T1", limit=4, offset=2)
    return page.select("source_file", "chunks", "domain", "total")


@register(f"""WITH {CHUNKS}, r AS (SELECT chunk_id, source_file, CASE WHEN source_file IN ('src1','src7') THEN 'db' ELSE domain END AS domain, CASE WHEN source_file IN ('src1','src7') THEN 'SQL' ELSE course END AS course,
CASE WHEN source_file IN ('src1','src7') THEN list_concat(list_filter(tags, lambda t: t <> 't1'), ['sql']) ELSE tags END AS tags FROM chunks) SELECT chunk_id, source_file, domain, course, array_to_string(tags, ',') AS tags FROM r""")
def retag(spark, sf_dir):
    hit = spark.createDataFrame([("src1",), ("src7",), ("src7",)], "source_file string")
    out = corpus.retag(chunks(spark, sf_dir), hit, domain="DB", course="SQL", add=["sql"], remove=["T1"])
    return out.select("chunk_id", "source_file", "domain", "course", F.array_join("tags", ",").alias("tags"))


@register("SELECT doc_id AS chunk_id, source AS source_file FROM documents WHERE source NOT IN ('src2','src5')")
def delete_sources(spark, sf_dir):
    return corpus.delete_sources(chunks(spark, sf_dir), spark.createDataFrame([("src2",), ("src5",)], "source_file string")).select("chunk_id", "source_file")


@register("SELECT source AS source_file, count(*) AS n FROM documents WHERE contains(source, 'src1') GROUP BY source")
def delete_preview(spark, sf_dir):
    return corpus.delete_matching(chunks(spark, sf_dir), "SRC1")[1]


TAXONOMY = {"folders": [("src4", "Folder")], "codes": [("^src1[0-9]$", "Coded", 0)], "keywords": [("src1", "Key", 0)], "domains": [("Folder", "ml"), ("Coded", "db")]}


@register(f"""WITH {CHUNKS}, p AS (SELECT *, CASE WHEN source_file = 'src4' THEN 'Folder' WHEN regexp_matches(source_file, '^src1[0-9]$') THEN 'Coded' WHEN contains(source_file, 'src1') THEN 'Key' END AS c FROM chunks)
SELECT chunk_id, coalesce(c, course) AS course, CASE WHEN c = 'Folder' THEN 'ml' WHEN c = 'Coded' THEN 'db' WHEN c = 'Key' THEN 'general' ELSE domain END AS domain, c IS NOT NULL AS changed FROM p""")
def recalibrate(spark, sf_dir):
    c = chunks(spark, sf_dir)
    frame = lambda name, kinds: spark.createDataFrame(TAXONOMY[name], kinds)
    paths = c.select(F.col("source_file").alias("path")).distinct()
    found = corpus.resolve_taxonomy(paths, frame("folders", "folder string, course string"), frame("codes", "pattern string, course string, ord int"), frame("keywords", "keyword string, course string, ord int"), frame("domains", "course string, domain string"))
    return corpus.recalibrate(c, found).select("chunk_id", "course", "domain", "changed")


@register("SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings")
def index_upsert(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    old = v.where("vec_id % 3 <> 0 OR vec_id % 2 = 0").withColumn("version", F.lit("old"))
    return corpus.upsert(old, v.where("vec_id % 3 = 0").withColumn("version", F.lit("new")), "vec_id")


@register("""WITH n AS (SELECT doc_id, len(regexp_replace(text, '[^A-ɏ]', '', 'g')) AS l, len(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS c, len(regexp_replace(text, '[^԰-֏]', '', 'g')) AS a FROM documents)
SELECT doc_id, CASE WHEN l + c + a = 0 THEN 'empty' WHEN l >= c AND l >= a AND l / (l + c + a) >= 0.6 THEN 'latin' ELSE 'other' END AS script FROM n""")
def script_detect(spark, sf_dir):
    script = T.detect_script(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", script.alias("s")).select("doc_id", F.when(F.col("s").isin("latin", "empty"), F.col("s")).otherwise("other").alias("script"))


@register("SELECT * FROM (VALUES ('1-3,5', 9, '0,1,2,4'), ('7', 9, '6'), ('3, 1-2 ,3', 9, '0,1,2'), ('1-9999', 3, '0,1,2'), ('0', 9, NULL), ('5-3', 9, NULL), ('a-b', 9, NULL), ('1-2-3', 9, NULL), ('-4', 9, NULL)) t(spec, pages, numbers)")
def page_spec(spark, sf_dir):
    rows = [("1-3,5", 9), ("7", 9), ("3, 1-2 ,3", 9), ("1-9999", 3), ("0", 9), ("5-3", 9), ("a-b", 9), ("1-2-3", 9), ("-4", 9)]
    return spark.createDataFrame(rows, "spec string, pages int").select("spec", "pages", F.array_join(T.page_spec(F.col("spec"), F.col("pages")), ",").alias("numbers"))


@register("""WITH p AS (SELECT DISTINCT source AS book, doc_id AS page FROM documents WHERE n_chars < 1500), g AS (SELECT book, page, page - row_number() OVER (PARTITION BY book ORDER BY page) AS g FROM p),
r AS (SELECT book, min(page) AS a, max(page) AS b FROM g GROUP BY book, g) SELECT book, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY book""")
def page_ranges(spark, sf_dir):
    return corpus.page_ranges(read(spark, sf_dir, "documents").where("n_chars < 1500").select(F.col("source").alias("book"), F.col("doc_id").alias("page")))


@register("""WITH t(page, title, level) AS (VALUES (10,'One',1),(40,'Two',1),(40,'Two and a half',2),(90,'Deep',3),(120,'Three',2)), p AS (SELECT source AS book, doc_id AS page FROM documents)
SELECT book, p.page, (SELECT title FROM t WHERE level <= 2 AND t.page <= p.page ORDER BY t.page DESC, title DESC LIMIT 1) AS chapter FROM p""")
def chapter_asof(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    toc = spark.createDataFrame([(10, "One", 1), (40, "Two", 1), (40, "Two and a half", 2), (90, "Deep", 3), (120, "Three", 2)], "page long, title string, level int")
    return corpus.chapters_asof(pages, pages.select("book").distinct().crossJoin(F.broadcast(toc)))


@register("""WITH r AS (SELECT source AS book, count(*) AS page_count, count(*) FILTER (WHERE n_chars < 50) AS n_needs_ocr, count(*) FILTER (WHERE n_chars >= 50 AND n_chars < 200) AS n_sparse FROM documents GROUP BY source)
SELECT *, round(100.0::DOUBLE * n_needs_ocr / page_count, 1) AS pct_needs_ocr, CASE WHEN n_needs_ocr = 0 THEN 'born_digital' WHEN n_needs_ocr = page_count THEN 'fully_scanned' ELSE 'mixed' END AS kind FROM r""")
def ocr_scan_report(spark, sf_dir):
    return corpus.ocr_report(read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.length(F.btrim("text")).alias("chars")))


@register("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN source || ' (2024-01-0' || (doc_id % 9 + 1) || ')' WHEN doc_id % 3 = 0 THEN source ELSE 'file.' || doc_id END AS label FROM documents")
def source_label(spark, sf_dir):
    d = F.col("doc_id")
    course = F.when((d % 7 == 0) | (d % 3 == 0), F.col("source"))
    date = F.when(d % 7 == 0, F.concat(F.lit("2024-01-0"), (d % 9 + 1).cast("string")))
    path = F.concat(F.lit("a/b\\c/file."), d.cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select("doc_id", T.retrieval_label(course, date, path, d.cast("string")).alias("label"))


@register("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN '' ELSE '[' || concat_ws(' | ', CASE WHEN doc_id % 3 > 0 THEN 'Course: ' || source END, CASE WHEN doc_id % 5 = 1 THEN 'Date: 2024-05-06' END, CASE WHEN doc_id % 5 > 0 THEN 'Section: Intro > ' || lang END) || ']' || chr(10) END AS header FROM documents""")
def context_header(spark, sf_dir):
    d = F.col("doc_id")
    headings = F.when(d % 5 > 0, F.array(F.lit("Intro"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "documents").select("doc_id", T.context_header(F.when(d % 3 > 0, F.col("source")).otherwise("unknown"), F.when(d % 5 == 1, "2024-05-06"), headings).alias("header"))


@register(f"""WITH {DENSE}, r AS (SELECT qid, rank0 + 1 AS rank, label FROM {top_sql('de', 20, 'd', 0)} JOIN vec USING (chunk_id)), w AS (SELECT item_id AS qid, CASE WHEN item_id % 9 = 0 THEN '' ELSE (item_id % 4)::VARCHAR END AS want FROM benchmark),
f AS (SELECT w.qid, nullif(want, '') AS want, min(rank) FILTER (WHERE label::VARCHAR = want) AS first_hit_rank FROM w LEFT JOIN r USING (qid) GROUP BY ALL)
SELECT qid, first_hit_rank, CASE WHEN want IS NOT NULL THEN round(coalesce(1.0::DOUBLE / first_hit_rank, 0), 6) END AS reciprocal_rank, CASE WHEN want IS NOT NULL THEN first_hit_rank IS NOT NULL END AS hit FROM f""")
def eval_hit_mrr(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ranked = lanes.dense_top(v, query_vectors(spark, sf_dir), 20, "d", 0).join(v.select("chunk_id", F.col("label").cast("string").alias("domain")), "chunk_id").select("qid", (F.col("rank0") + 1).alias("rank"), "domain")
    wanted = questions(spark, sf_dir).select("qid", F.when(F.col("qid") % 9 == 0, "").otherwise((F.col("qid") % 4).cast("string")).alias("want"))
    return evaluation.first_hits(ranked, wanted).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@register(f"""WITH {BM25}, f AS (SELECT DISTINCT qid, source FROM {top_sql('bm', 5, 's', 0)} JOIN documents ON doc_id = chunk_id), e AS (SELECT item_id AS qid, unnest(['src' || (item_id % 20), 'c1' || (item_id % 3)]) AS frag FROM benchmark)
SELECT qid, round(avg(hit), 6) AS recall FROM (SELECT e.qid, frag, coalesce(max(contains(source, frag)::INT), 0) AS hit FROM e LEFT JOIN f USING (qid) GROUP BY ALL) GROUP BY qid""")
def eval_recall(spark, sf_dir):
    found = lanes.small(lanes.bm25_top(chunks(spark, sf_dir), questions(spark, sf_dir), 5, "s", 0)).join(chunks(spark, sf_dir).select("chunk_id", "source_file"), "chunk_id")
    q = F.col("qid")
    expected = questions(spark, sf_dir).select("qid", F.explode(F.array(F.concat(F.lit("SRC"), (q % 20).cast("string")), F.concat(F.lit("C1"), (q % 3).cast("string")))).alias("fragment"))
    return evaluation.recall_at_k(found, expected).withColumn("recall", F.round("recall", 6))


@register("SELECT * FROM (VALUES (1,true,true,true),(2,true,false,false),(3,false,NULL,false),(4,true,true,NULL),(5,false,NULL,NULL)) t(i, fired, correct, recalled)")
def eval_scope_pr(spark, sf_dir):
    rows = [(1, ["ml"], ["ml"], ["ml"]), (2, ["db"], ["ml"], ["ml"]), (3, [], ["ml"], ["ml"]), (4, ["ml"], ["ml"], []), (5, [], [], [])]
    fired, correct, recalled = evaluation.scope_verdict(F.col("f"), F.col("t"), F.col("e"))
    return spark.createDataFrame(rows, "i int, f array<string>, t array<string>, e array<string>").select("i", fired.alias("fired"), correct.alias("correct"), recalled.alias("recalled"))


@register("""WITH a(i, answer, n) AS (VALUES (1,'Yes [1] and [9].',3),(2,'no marks',3),(3,'[2][2] [0] [4]',3),(4,NULL,3)), u AS (SELECT i, n, list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(\\d+)\\]', 1), lambda x: x::INT) AS c FROM a)
SELECT i, CASE WHEN len(c) > 0 THEN round(len(list_filter(c, lambda x: x >= 1 AND x <= n)) / len(c), 6) END AS rate, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x < 1 OR x > n))), ',') AS dangling FROM u""")
def citation_validity(spark, sf_dir):
    rows = spark.createDataFrame([(1, "Yes [1] and [9].", 3), (2, "no marks", 3), (3, "[2][2] [0] [4]", 3), (4, None, 3)], "i int, answer string, n int")
    rate, dangling = evaluation.citation_validity(F.col("answer"), F.col("n"))
    return rows.select("i", F.round(rate, 6).alias("rate"), F.array_join(dangling, ",").alias("dangling"))


@register()
def groundedness(spark, sf_dir):
    """Answers made of a sentence of a document and one of another, citing both."""
    top = lanes.small(lanes.bm25_top(chunks(spark, sf_dir), questions(spark, sf_dir), 3, "s", 0)).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select("qid", (F.col("rank0") + 1).alias("rank"), "text")
    answers = questions(spark, sf_dir).select("qid", F.concat("question", F.lit(". [1]\nUnrelated claim here [2]. Uncited.")).alias("answer"))
    return evaluation.groundedness(answers, top)


@register("""WITH r AS (SELECT upper(coalesce(nullif(list_extract(['high','medium','low',''], (doc_id % 4 + 1)::INT), ''), 'UNKNOWN')) AS bucket, quality FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT bucket, count(*) AS n, count(quality) AS n_scored, round(avg(quality), 3) AS mean FROM r GROUP BY bucket) SELECT *, (SELECT round(max(mean) FILTER (WHERE bucket = 'HIGH') - max(mean) FILTER (WHERE bucket = 'LOW'), 3) FROM e) AS gap FROM e""")
def calibration_buckets(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", label.alias("confidence")).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.calibration(rows, "confidence", "quality")


@register("SELECT lang, round(avg(quality), 6) AS quality, count(quality) AS quality_n, round(avg(toxic), 6) AS toxic, count(toxic) AS toxic_n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def mean_scored(spark, sf_dir):
    return evaluation.mean_scored(read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic"], ["lang"])


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_lanes(spark, sf_dir)
    both = found.where("rank0 < 10").select("qid", F.col("lane").alias("branch"), F.col("lane_ord").alias("branch_ord"), (F.col("rank0") + 1).alias("rank"), "chunk_id")
    fused = fusion.ranked(fusion.fuse(found), 7).select("qid", F.lit("rrf").alias("branch"), F.lit(2).alias("branch_ord"), "rank", "chunk_id")
    return lanes.together(both, fused)


BRANCHES = f"{RANKED}, br AS (SELECT qid, lane AS branch, lane_ord AS branch_ord, rank0 + 1 AS rank, chunk_id FROM lanes WHERE rank0 < 10 UNION ALL SELECT qid, 'rrf', 2, rank, chunk_id FROM ranked WHERE rank <= 7)"


@register(f"""WITH {BRANCHES}, e AS (SELECT qid, chunk_id, count(*) AS n_branches, string_agg(branch, ',' ORDER BY branch_ord) AS branches, max(rank) - min(rank) AS s FROM br GROUP BY ALL), a AS (SELECT qid, count(DISTINCT branch) AS k FROM br GROUP BY ALL)
SELECT qid, chunk_id, n_branches, branches, CASE WHEN n_branches > 1 THEN s END AS spread, n_branches = k AS is_common, n_branches = 1 AS is_unique FROM e JOIN a USING (qid)""")
def compare_membership(spark, sf_dir):
    return evaluation.membership(branches(spark, sf_dir))


@register(f"""WITH {BRANCHES}, d AS (SELECT qid, branch, branch_ord, count(*) AS d FROM br GROUP BY ALL), p AS (SELECT a.qid, a.branch AS l, b.branch AS r, least(a.d, b.d) AS depth FROM d a JOIN d b ON a.qid = b.qid AND a.branch_ord < b.branch_ord),
o AS (SELECT p.qid, l, r, depth, count(y.chunk_id) AS overlap FROM p JOIN br x ON x.qid = p.qid AND x.branch = l AND x.rank <= depth LEFT JOIN br y ON y.qid = p.qid AND y.branch = r AND y.rank <= depth AND y.chunk_id = x.chunk_id GROUP BY ALL)
SELECT qid, l AS "left", r AS "right", depth, overlap, round(overlap / depth, 4) AS overlap_rate, round(overlap / (2 * depth - overlap), 4) AS jaccard FROM o""")
def compare_summary(spark, sf_dir):
    return evaluation.pairwise(branches(spark, sf_dir))


@register("SELECT * FROM (VALUES (1, true, 1.0, 1.0), (2, true, 0.5, NULL), (3, true, 0.0, 0.0), (4, false, NULL, NULL)) t(i, gradable, correct, grounded)")
def judge_merge(spark, sf_dir):
    rows = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "i int, gradable boolean")
    scores = spark.createDataFrame([(1, 0, "0.2", "0"), (1, 1, "7", "1"), (2, 0, "0.5", "x"), (3, 0, "-3", "0")], "i int, ord int, correct string, grounded string")
    return evaluation.judge_merge(rows, scores)


FIXED_SQL = """WITH RECURSIVE t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents),
w AS (SELECT doc_id, text, length(text)::BIGINT AS n, 0::BIGINT AS i, 0 AS part FROM t WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, greatest(stop - 150, i + 1), part + 1 FROM (SELECT *, {stop} AS stop FROM w) WHERE stop < n),
c AS (SELECT doc_id, part, trim(substring(text, (i + 1)::INT, ({stop} - i)::INT), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS part, length(piece) AS n, sha256(piece) AS digest FROM c WHERE piece <> ''""".replace(
    "{stop}", "(CASE WHEN i + 3000 >= n THEN n ELSE i + coalesce(nullif(1800 + length(regexp_replace(substring(text, (i + 1801)::INT, 1200), '[^ ' || chr(10) || ']*$', '')) - 1, 1799), 3000) END)"
)


def _chunked(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    from ..sources import chunking

    cut = read(spark, sf_dir, "documents").select("doc_id", chunking.split_column(F.col("text"), strategy=strategy).alias("p"))
    each = cut.select("doc_id", F.posexplode("p").alias("at", "piece"))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("part"), F.length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("digest"))


@register(FIXED_SQL)
def fixed_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir, "fixed")


@register()
def heading_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir, "heading")


@register()
def document_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir, "document")


NOTES = (
    ("Course A/intro.md", "---\ntags: [alpha]\ncourse: Statistics\n---\nBefore any heading, see [[Other note|that one]].\n\n# Means\nThe mean is a sum over a count. #mean\n\n## Median\nHalf lie below it.\n```\n#no tag\n```\n"),
    ("daily/2024-03-04.md", "# RL L1\nA policy maps states to actions.\n# Todo\nnothing of note here\n# NLP L2\n## Attention\nQueries, keys and values.\n"),
    ("code/tool.py", "import os\n\n\ndef one():\n    return 1\n\n\nclass Two:\n    pass\n"),
)


@register()
def markdown_sections(spark, sf_dir):
    from ..sources import notes

    options = notes.Options(least=10, course_rules=(("^RL\\b", "RL"), ("^NLP\\b", "NLP"), ("^Todo", notes.SKIP)))
    return notes.parse_files(spark.createDataFrame(NOTES, "path string, content string"), options)


@register("SELECT * FROM (VALUES (1, 'a,b/c', 'Note,Other'), (2, '', ''), (3, 'x', 'L')) t(i, tags, links)")
def tags_wikilinks(spark, sf_dir):
    rows = [(1, "#b/c and #a\n```\n#no\n```\n[[Note|shown]] [[Other]] a#no #1no"), (2, "plain"), (3, "#x #x\n![[L]]")]
    return spark.createDataFrame(rows, "i int, text string").select("i", F.array_join(T.hashtags(F.col("text")), ",").alias("tags"), F.array_join(T.wikilinks(F.col("text")), ",").alias("links"))


@register("""SELECT page_id, regexp_replace(substring(regexp_extract(regexp_replace(url, '^https?://(www\\.)?', ''), '^([^/]*)', 1) || '__' || coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), ''), 'page'), 1, 120), '[^A-Za-z0-9_.\\- ()\\[\\]]', '_', 'g') AS slug FROM pages""")
def url_slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.url_slug(F.col("url")).alias("slug"))


@register("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS x FROM t)
SELECT page_id, length(y) AS n, sha256(y) AS digest FROM (SELECT page_id, trim(regexp_replace(x, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS y FROM u)""")
def web_pages_text(spark, sf_dir):
    text = T.html_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", text.alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.sha2("x", 256).alias("digest"))


@register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def job_state_latest(spark, sf_dir):
    from ..streaming import ingest

    return ingest.latest_states(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@register("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_ring(spark, sf_dir):
    from ..streaming import ingest

    return ingest.recent(read(spark, sf_dir, "events"), "ts", 500, "event_id").select("event_id", "user_id")


@register("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'parent:p' || (doc_id % 10) WHEN doc_id % 4 = 1 THEN 'live:' || substring(sha256(source || chr(0) || text), 1, 20) ELSE doc_id::VARCHAR END AS evidence_id,
CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 79)) || '…' END AS preview FROM documents""")
def evidence(spark, sf_dir):
    d = F.col("doc_id")
    parent = F.when(d % 4 == 0, F.concat(F.lit("p"), (d % 10).cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", T.evidence_id(d.cast("string"), parent, d % 4 == 1, F.col("source"), F.col("text")).alias("evidence_id"), T.preview(F.col("text"), 80).alias("preview"))


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '.pdf › Chapter ' || (doc_id % 9) || CASE WHEN doc_id % 3 > 0 THEN ', p.' || (doc_id % 3) ELSE '' END WHEN 1 THEN source || ' (live vault)' WHEN 2 THEN 'Course › ' || lang ELSE source || '.pdf' END AS label FROM documents""")
def citation_label(spark, sf_dir):
    d = F.col("doc_id")
    name = F.concat("source", F.lit(".pdf"))
    label = T.citation_label(F.when(d % 4 == 0, "PDF").otherwise("note"), name, F.when(d % 4 == 0, F.concat(F.lit("Chapter "), (d % 9).cast("string"))), F.when(d % 4 == 0, d % 3), F.when(d % 4 == 2, "Course").otherwise("unknown"), F.when(d % 4 == 2, F.col("lang")), d % 4 == 1)
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@register("""SELECT * FROM (VALUES (1,'HIGH',false,'A fact [1].'),(2,'UNKNOWN',true,'The notes don''t cover it'),(3,'LOW',false,'done CONFIDENCE: low'),(4,'UNKNOWN',false,'cut off')) t(i, confidence, punted, answer)""")
def answer_parsing(spark, sf_dir):
    rows = [(1, "<think>x\ny</think> A fact [1].", "CONFIDENCE: HIGH"), (2, "The notes don't cover it", ""), (3, "done CONFIDENCE: low", "done CONFIDENCE: low"), (4, "a <think> cut off", "")]
    df = spark.createDataFrame(rows, "i int, answer string, tail string")
    return df.select("i", T.confidence(F.col("tail")).alias("confidence"), T.punted(F.col("answer")).alias("punted"), T.strip_reasoning(F.col("answer")).alias("answer"))


@register("""WITH p AS (SELECT doc_id, text, list_filter(['the','licensed','la','zzz'], lambda k: contains(lower(text), k)) AS hit FROM documents)
SELECT doc_id, round(len(hit) / 4, 6) AS keyword_recall, contains(text, '```') OR regexp_matches(text, '\\n {4,}\\S|\\bdef \\w+\\(|\\bclass \\w+') AS has_code FROM p""")
def keyword_recall(spark, sf_dir):
    words = F.array(*map(F.lit, ("the", "Licensed", "la", "zzz")))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(evaluation.keyword_recall(F.col("text"), words), 6).alias("keyword_recall"), T.has_code(F.col("text")).alias("has_code"))


@register("""WITH h AS (SELECT item_id AS qid, text AS answer FROM benchmark) SELECT qid, 'Answer the question' || chr(10) || answer AS query, len(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS terms FROM h""")
def scoring_queries(spark, sf_dir):
    q = questions(spark, sf_dir)
    template = fusion.scoring_query("%s", "Answer the question", "http")
    return q.select("qid", F.format_string(template, "question").alias("query"), F.size(T.tokens(F.col("question"))).alias("terms"))


@register()
def judge_bundle(spark, sf_dir):
    top = lanes.small(lanes.bm25_top(chunks(spark, sf_dir), questions(spark, sf_dir), 3, "s", 0)).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select("qid", (F.col("rank0") + 1).alias("rank"), "chunk_id", "text")
    answers = questions(spark, sf_dir).select(F.col("qid").alias("i"), "qid", "question", F.lit("Yes [1], [3] and [9].").alias("answer"))
    return evaluation.judge_bundle(answers, top).select("i", "qid", "question", "answer", F.to_json("cited_chunks").alias("cited_chunks"))


@register("""WITH f AS (SELECT source AS path, CASE WHEN doc_id % 3 = 0 THEN 'report' ELSE 'book' END || doc_id || '.pdf' AS name, doc_id FROM documents),
r AS (SELECT CASE WHEN NOT contains(path || '/' || name, 'src1') THEN 'not_included' WHEN contains(name, 'report') THEN 'excluded' WHEN doc_id % 10 = 1 THEN 'skip_list' WHEN NOT contains(name, '7') THEN 'no_book' ELSE 'kept' END AS drop_reason FROM f)
SELECT drop_reason, count(*) AS n FROM r GROUP BY ALL""")
def pdf_discovery(spark, sf_dir):
    from ..sources import files

    d = F.col("doc_id")
    name = F.concat(F.when(d % 3 == 0, "report").otherwise("book"), d.cast("string"), F.lit(".pdf"))
    listed = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), name).alias("path"))
    skip = listed.where("doc_id % 10 = 1").select(F.upper("path").alias("path"))
    found = files.pdf_drops(listed, ["SRC1"], ["report"], skip, ["7"])
    return files.drop_counts(found)


@register("""WITH d AS (SELECT doc_id AS chunk_id, source, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS f FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, source, 2 FROM documents)
SELECT chunk_id, source AS source_file, min(f) AS file FROM d GROUP BY ALL""")
def union_scan(spark, sf_dir):
    from ..operators import index

    c = chunks(spark, sf_dir).select("chunk_id", "source_file", "ord")
    part = lambda n, where: c.where(where).withColumn("file", F.lit(n))
    first, second = part(0, "chunk_id % 3 < 2 AND chunk_id % 2 = 0"), part(1, "chunk_id % 3 < 2 AND chunk_id % 2 = 1")
    return index.union_chunks(first, second, first, part(2, "true")).select("chunk_id", "source_file", "file")


@register("SELECT doc_id AS chunk_id FROM documents WHERE contains(source, 'src1') AND doc_id % 4 IN (0, 1) AND doc_id % 5 <> 0")
def hype_pending(spark, sf_dir):
    from ..operators import index

    c = chunks(spark, sf_dir)
    done = c.where("chunk_id % 5 = 0").select(F.concat(F.col("chunk_id").cast("string"), F.lit("::q0")).alias("question_id"), F.col("chunk_id").alias("doc_id"))
    return index.pending_questions(c, done, "SRC1", ("note", "pdf")).select("chunk_id")


@register(f"""WITH {DENSE}, r AS (SELECT qid, min(rank0 + 1) FILTER (WHERE label = qid % 4) AS f FROM {top_sql('de', 20, 'd', 0)} JOIN vec USING (chunk_id) GROUP BY qid),
e AS (SELECT item_id AS qid, r.f FROM benchmark LEFT JOIN r ON qid = item_id)
SELECT count(*) AS n, round(avg((f IS NOT NULL)::INT), 6) AS hit, count(*) AS hit_n, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS reciprocal_rank, count(*) AS reciprocal_rank_n FROM e""")
def eval_report(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ranked = lanes.dense_top(v, query_vectors(spark, sf_dir), 20, "d", 0).join(v.select("chunk_id", F.col("label").cast("string").alias("domain")), "chunk_id").select("qid", (F.col("rank0") + 1).alias("rank"), "domain")
    wanted = questions(spark, sf_dir).select("qid", (F.col("qid") % 4).cast("string").alias("want"))
    return evaluation.report(evaluation.first_hits(ranked, wanted))
