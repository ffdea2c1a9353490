"""What BM25 queries exchange: neither postings nor texts, whatever the size of the tables; and that nothing is lost by that."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import expansion, lanes
from corpuscle.plans import catalogue

RANKED = ["bm25_topk", "code_lane", "rrf_fusion", "metadata_boost", "lexical_rerank", "rerank_none", "parent_swap", "neighbor_pages", "neighbor_expansion", "hybrid_search", "eval_recall", "groundedness", "judge_bundle", "compare_membership", "compare_summary"]


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def measured(spark):
    """Tables above 256 KB are not broadcast unasked, as where the queries are measured."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanged(df):
    """Keys by which a plan exchanges rows of chunks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if re.match(r"chunk_id|term|source_file#\d+, page", k)}


@pytest.mark.parametrize("name", [*RANKED, "engine_search", "engine_echo"])
def test_no_exchange_of_chunks(spark, sf, large, name):
    assert exchanged(catalogue.QUERIES[name](spark, sf)) == set()


def chunks(spark, rows):
    kinds = "chunk_id long, text string, domain string, source_file string, file_type string"
    return spark.createDataFrame([(i, t, "ml" if i % 2 else "db", f"src{i % 3}", "py" if i % 4 == 0 else "note") for i, t in rows], kinds)


ASKED = [(1, "Alpha beta gamma"), (2, "alpha alpha delta"), (3, ""), (4, None), (5, "nowhere"), (6, "İstanbul Kelvin beta")]
TEXTS = [(i, f"alpha beta {'gamma ' * (i % 7)} word{i % 5}") for i in range(60)] + [(i, "Alpha BETA alpha") for i in range(90, 60, -1)] + [(95, None), (96, ""), (97, "delta"), (98, "İSTANBUL Kelvin delta-beta")]


@pytest.mark.parametrize("rows", [TEXTS, [*TEXTS, (97, "alpha delta"), (3, "alpha beta gamma gamma gamma  word3")], [], [(1, None), (2, "  ")]], ids=["distinct", "shared ids", "no chunks", "no tokens"])
def test_lanes_are_those_of_the_exchange(spark, monkeypatch, rows):
    monkeypatch.setattr(lanes, "_SCORES", 40)  # blocks of a few chunks
    table, asked = chunks(spark, rows).repartition(3), spark.createDataFrame(ASKED, "qid long, question string")
    scopes = spark.createDataFrame([(1, ["db"], [], []), (2, ["ml"], ["src1"], []), (6, [], ["src2"], ["py"])], "qid long, domains array<string>, paths array<string>, file_types array<string>")
    wanted = [lanes.Sparse(5, "all", 0), lanes.Sparse(4, "code", 1, where=lanes.code_filter()), lanes.Sparse(3, "scope", 2, scopes=scopes)]
    scored = lanes.bm25(table, asked)
    meta = table.drop("text").dropDuplicates(["chunk_id"])
    within = scored.join(scopes, "qid").join(meta, "chunk_id").where(lanes.within_scope()).select("qid", "chunk_id", "score")
    want = lanes.together(lanes.top(scored, 5, "all", 0), lanes.top(scored.join(meta.where(lanes.code_filter()), "chunk_id", "left_semi"), 4, "code", 1), lanes.top(within, 3, "scope", 2))
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "lane", "lane_ord", "rank0", "chunk_id", F.round("score", 5)).collect())
    got = key(lanes.bm25_lanes(table, asked, wanted))
    assert got == key(want) and bool(got) == (len(rows) > 2)


def bm25_sql(table, asked):
    """Ranks by the SQL of bm25_topk over other tables."""
    con = duckdb.connect()
    for name, df, columns in (("documents", table, ("doc_id", "text")), ("benchmark", asked, ("item_id", "text"))):
        con.register(f"_{name}", df.toArrow().rename_columns(columns))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return sorted((q, r, c, round(s, 5)) for q, r, c, s in con.execute(f"SELECT qid, rank0, chunk_id, score FROM ({catalogue.SQL['bm25_topk']})").fetchall())


#: Ids of several texts, of copies (of one length, so one text to BM25), and of one text by three rows of which one is code.
SHARED = [(i % 23, f"alpha beta {'gamma ' * (i % 7)} word{i % 5}") for i in range(60)] + [(40, "delta alpha beta gamma word1 word2 word3 word4 word5 word6 word7")] * 9 + [(41, None), (41, ""), (42, "gamma")]


@pytest.fixture
def short_batches(spark):
    """Few rows to a batch, so that an id goes on in the next one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_shared_ids_exchange_no_postings(spark, large, short_batches):
    table, asked = chunks(spark, SHARED).repartition(3), spark.createDataFrame(ASKED, "qid long, question string")
    found = lanes.bm25_top(table, asked, 20, "s", 0)
    assert {k.split("#")[0] for k in exchanged(found)} == {"chunk_id"}  # one row of a chunk, not of a term
    got = sorted((r["qid"], r["rank0"], r["chunk_id"], round(r["score"], 5)) for r in found.collect())
    assert got == bm25_sql(table.select("chunk_id", "text"), asked) and got


def test_conditions_leave_the_statistics_of_shared_ids(spark, short_batches):
    rows = [(c, t, "ml", "a", "py" if i % 3 == 0 else "note") for i, (c, t) in enumerate(SHARED)]
    table = spark.createDataFrame(rows, "chunk_id long, text string, domain string, source_file string, file_type string").repartition(2)
    asked = spark.createDataFrame(ASKED, "qid long, question string")
    none = spark.createDataFrame([], "qid long, domains array<string>, paths array<string>, file_types array<string>")
    key = lambda df: sorted((r["qid"], r["lane"], r["rank0"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    got = lanes.bm25_lanes(table, asked, [lanes.Sparse(20, "code", 0, where=lanes.code_filter()), lanes.Sparse(20, "none", 1, scopes=none), lanes.Sparse(20, "all", 2)])
    want = [lanes.top(lanes.bm25(table, asked, where), 20, *lane) for where, *lane in ((lanes.code_filter(), "code", 0), (None, "all", 2))]
    assert key(got) == key(lanes.together(*want))
    # A question that asks for one term of code alone has the document frequency of all texts.
    one = spark.createDataFrame([(1, "a b", "x", "x", "py"), (1, "a c", "x", "x", "note"), (2, "d", "x", "x", "note")], table.schema)
    score = {r["chunk_id"]: r["score"] for r in lanes.bm25(one, spark.createDataFrame([(1, "a")], asked.schema), lanes.code_filter()).collect()}
    assert score == {1: pytest.approx(math.log(1 + 2.5 / 1.5) / (1 + 1.5 * (0.25 + 0.75 * 2 / (5 / 3))), abs=1e-6)}


@pytest.mark.parametrize("rows", [TEXTS, SHARED], ids=["distinct", "shared ids"])
def test_many_terms_exchange_no_postings(spark, monkeypatch, large, rows):
    monkeypatch.setattr(lanes, "MOST_BROADCAST", 4)
    table, asked = chunks(spark, rows).repartition(3), spark.createDataFrame(ASKED, "qid long, question string")
    found = lanes.bm25_top(table, asked, 20, "s", 0)
    assert not any(k.startswith("term") for k in exchanged(found))
    key = lambda df: sorted((r["qid"], r["rank0"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    got = key(found)
    assert got == key(lanes.top(lanes.bm25(table, asked), 20, "s", 0)) and got


def test_ids_of_text_order_ties(spark):
    table = spark.createDataFrame([(c, "alpha") for c in ("b", "é", "a", "z", "Z", "10", "9")], "chunk_id string, text string").repartition(2)
    asked = spark.createDataFrame([("q", "alpha")], "qid string, question string")
    assert [r["chunk_id"] for r in lanes.bm25_top(table, asked, 4, "s", 0).orderBy("rank0").collect()] == ["10", "9", "Z", "a"]


def test_dense_lanes_within_scopes(spark, sf):
    vectors, meta = catalogue.vectors(spark, sf).select("chunk_id", "embedding"), catalogue.chunks(spark, sf)
    asked = catalogue.query_vectors(spark, sf).where("qid < 9")
    scopes = lanes.scopes_of(catalogue._asked(spark, sf), catalogue.SCOPES)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = key(lanes.dense_scoped_top(vectors, meta, asked, scopes, 6, "d", 4))
    assert got == key(lanes.top(lanes.dense_scoped(vectors, meta, asked, scopes), 6, "d", 4)) and got


def test_neighbours_meet_the_texts_by_broadcast(spark, large):
    table = spark.range(200).select(F.col("id").alias("chunk_id"), F.lit("b").alias("source_file"), F.lit("pdf").alias("file_type"), F.col("id").cast("int").alias("page_start"), F.lit("text").alias("text"))
    hits = spark.createDataFrame([(1, 1, 4, "b", "pdf", 4)], "qid int, rank int, chunk_id long, source_file string, file_type string, page_start int")
    found = expansion.add_neighbors(hits, table)
    assert exchanged(found) == set() and [r["chunk_id"] for r in found.orderBy("pos").collect()] == [3, 5]


def shuffled(spark, run):
    """Rows that all jobs of ``run`` write to exchanges, those that it collects on its way among them."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["metadata_boost", "neighbor_pages"])
def test_rows_exchanged_grow_as_the_chunks_do(spark, sf, measured, tmp_path, name):
    con, rows = duckdb.connect(), {}
    for copies in (4, 8):
        d = tmp_path / str(copies)
        d.mkdir()
        for table, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
            con.execute(f"COPY (SELECT * REPLACE ({key} + i * 840 AS {key}) FROM '{sf}/{table}.parquet', range({copies}) r(i)) TO '{d}/{table}.parquet'")
        con.execute(f"COPY (FROM '{sf}/benchmark.parquet') TO '{d}/benchmark.parquet'")
        n = con.execute(f"SELECT count(*) FROM '{d}/documents.parquet'").fetchone()[0]
        rows[copies] = n, shuffled(spark, lambda d=d: catalogue.QUERIES[name](spark, str(d)).collect())
    (few, at_few), (many, at_many) = rows.values()
    # An id for each chunk; all else is by question and task.
    assert few <= at_few and at_many - at_few <= 2 * (many - few)
