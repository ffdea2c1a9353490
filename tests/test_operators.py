import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import corpus, evaluation, expansion, fusion
from corpuscle.plans import catalogue
from corpuscle.sources import config, files, notes

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.mark.parametrize("name", ["hybrid_search", "manifest", "facets", "retag", "page_ranges", "chapter_asof", "eval_recall", "compare_summary", "fixed_chunks", "stats"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in (r[c] for c in columns)) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in (r[i] for i in at)) for r in want.fetchall())


def test_fusion_ties_and_ranks(spark):
    lanes = spark.createDataFrame([(1, "a", 0, 0, "x"), (1, "a", 0, 1, "y"), (1, "b", 1, 0, "y"), (1, "b", 1, 1, "x"), (1, "b", 1, 2, "z")], "qid int, lane string, lane_ord int, rank0 int, chunk_id string")
    rows = fusion.ranked(fusion.fuse(lanes)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["x", "y", "z"]
    assert rows[0]["score"] == round(1 / 60 + 1 / 61, 6)


def test_lexical_rerank(spark):
    docs = spark.createDataFrame([(1, 1, "q", "gradient descent weights", "other words here"), (1, 2, "r", "gradient descent weights", "gradient descent moves weights"), (1, 3, "s", "gradient descent weights", "nothing")], "qid int, rank int, chunk_id string, question string, text string")
    assert [r["chunk_id"] for r in fusion.rerank(docs, "lexical", 2).orderBy("rank").collect()] == ["r", "q"]
    assert [r["chunk_id"] for r in fusion.rerank(docs, "none", 2).orderBy("rank").collect()] == ["q", "r"]
    with pytest.raises(ValueError):
        fusion.rerank(docs, "http", 2)


def test_neighbors_are_taken_once(spark):
    chunks = spark.createDataFrame([(i, "b", "pdf", i, f"page {i}") for i in range(10)], "chunk_id long, source_file string, file_type string, page_start int, text string")
    hits = spark.createDataFrame([(1, 1, 4, "b", "pdf", 4), (1, 2, 6, "b", "pdf", 6)], "qid int, rank int, chunk_id long, source_file string, file_type string, page_start int")
    assert [r["chunk_id"] for r in expansion.add_neighbors(hits, chunks).orderBy("pos").collect()] == [3, 5, 7]


def test_judge_merge(spark):
    rows = spark.createDataFrame([(1, True), (2, True)], "i int, gradable boolean")
    scores = spark.createDataFrame([(1, 0, "0.2", "0"), (1, 1, "7", "1"), (2, 0, "-3", "x")], "i int, ord int, correct string, grounded string")
    assert [(r["correct"], r["grounded"]) for r in evaluation.judge_merge(rows, scores).orderBy("i").collect()] == [(1.0, 1.0), (0.0, None)]
    with pytest.raises(Exception, match="no score"):
        evaluation.judge_merge(rows, spark.createDataFrame([(1, 0, "1", "1")], "i int, ord int, correct string, grounded string")).collect()


def test_calibration_gap(spark):
    rows = spark.createDataFrame([("high", 1.0), ("MEDIUM", 0.6), ("low", 0.2), (None, None)], "c string, s double")
    got = {r["bucket"]: (r["n"], r["n_scored"], r["mean"], r["gap"]) for r in evaluation.calibration(rows, "c", "s").collect()}
    assert got["HIGH"] == (1, 1, 1.0, 0.8) and got["UNKNOWN"] == (1, 0, None, 0.8)


def test_page_ranges(spark):
    for pages, want in (([1, 2, 3, 7, 9, 10], "1-3,7,9-10"), ([2, 4, 6], "2,4,6"), ([10, 11, 12, 14], "10-12,14")):
        df = spark.createDataFrame([("b", p) for p in pages], "book string, page int")
        assert corpus.page_ranges(df).first()["spec"] == want


def test_config():
    assert config.expand_env({"a": "${X:-d}", "b": ["${Y}"]}, {}) == {"a": "d", "b": ["${Y}"]}
    assert config.resolve({"top_k": 0, "rerank_instruction": ""}, {}, {"top_k": 9, "rerank_instruction": "x"}) | {} == config.KNOBS | {"top_k": 9, "rerank_instruction": "", "preset": None}
    with pytest.raises(ValueError):
        config.resolve({"preset": "none such"}, {}, {})
    assert config.resolve({}, {"code": {"top_k": 3}}, {"auto_preset": True}, True)["top_k"] == 3


def test_notes():
    o = notes.Options(least=5, course_rules=(("^RL", "RL"), ("^Todo", notes.SKIP)))
    rows = [c for c, _ in notes.parse_note("daily/2024-01-02.md", "# RL L3\n## Topic\nhello world text #tag\n# Todo\nskip this please\n# RL L4\nmore text", o)]
    assert [(r["course"], r["heading_path"], r["date"]) for r in rows] == [("RL", "RL L3 > Topic", "2024-01-02"), ("RL", "RL L4", "2024-01-02")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# T\n" + "long enough text " * 30)
    (tmp_path / "in" / "node_modules" / "b.md").write_text("x" * 100)
    (tmp_path / "in" / "c.ipynb").write_text("not json")
    found = files.scan(spark, str(tmp_path / "in"), [".md", ".ipynb"])
    assert [r["path"] for r in files.discover_notes(found).select("path").collect()] == ["a.md"]
    rows = notes.parse_files(found).orderBy("source_file").collect()
    assert [(r["source_file"], r["error"] is None) for r in rows] == [("a.md", True), ("c.ipynb", False)]
    chunks = notes.parse_files(files.discover_notes(found))
    files.write_jsonl(chunks, str(tmp_path / "out"))
    back = files.normalise_records(files.read_jsonl(spark, str(tmp_path / "out"))).collect()
    assert [r["source_file"] for r in back] == ["a.md"] and back[0]["chunk_id"] == rows[0]["doc_id"]


def test_stream_is_idempotent(spark, tmp_path):
    from corpuscle.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n" + "long enough text " * 30)
    table = str(tmp_path / "table")
    for i, checkpoint in enumerate(("one", "two")):
        parsed = lambda d: notes.parse_files(d).select("doc_id", "text", "source_file")
        ingest.ingest_available(ingest.watch(spark, str(tmp_path / "in")), parsed, table, str(tmp_path / checkpoint)).awaitTermination(120)
        assert spark.read.parquet(table).count() == 1, i


def test_index_tables_answer_like_the_scan(spark, sf, tmp_path):
    from corpuscle.operators import index, lanes

    chunks, asked = catalogue.chunks(spark, sf), catalogue.questions(spark, sf).limit(5)
    index.write(chunks, str(tmp_path))
    key = lambda df: {(r["qid"], r["chunk_id"]): r["score"] for r in df.collect()}
    assert key(index.search(spark, str(tmp_path), asked)) == pytest.approx(key(lanes.bm25(chunks, asked)), abs=2e-6)


def test_plugins(spark):
    from corpuscle.operators import index

    pending = spark.createDataFrame([(1, "a", "text")], "chunk_id long, source_file string, text string")
    got = index.generate_questions(pending, lambda t: "- What is the mean here?\nno\n• Why is that so often?\n", 1).collect()
    assert [(r["question_id"], r["question"]) for r in got] == [("1::q0", "What is the mean here?")]
    assert index.embed(pending, lambda texts: [[1.0, 2.0] for _ in texts]).first()["embedding"] == [1.0, 2.0]

    def dead(image):
        raise ConnectionError("no server")

    pages = spark.createDataFrame([("b", 1, bytearray(b"x")), ("b", 2, bytearray(b"y"))], "book string, page int, image binary")
    assert all(r["error"].startswith("ConnectionError") for r in index.read_pages(pages, dead).collect())
    lane = index.live_lane(spark, lambda q: [{"path": "n.md", "excerpt": "e" * 50}, {"path": "n.png", "excerpt": "e" * 50}], [(1, "q")])
    assert [r["chunk_id"] for r in lane.collect()] == ["omni::n.md"]


def test_scores_file(spark):
    lines = spark.createDataFrame([(1, '﻿{"i": 3, "correct": 1}'), (2, " "), (3, "{}")], "n int, value string")
    assert evaluation.read_scores(lines.where("n < 3")).first()["i"] == 3
    with pytest.raises(Exception, match="line 3"):
        evaluation.read_scores(lines).collect()
    row = evaluation.report(spark.createDataFrame([(True, None), (False, None)], "hit boolean, recall double")).first().asDict()
    assert "| hit | 0.500 | 2 of 2 |" in evaluation.scorecard(row) and "not scored" in evaluation.scorecard(row)


def test_engine(spark, sf):
    from corpuscle.plans.engine import Engine

    chunks = catalogue.chunks(spark, sf).withColumn("parent_id", F.when(F.col("chunk_id") % 2 == 0, F.col("source_file")))
    parents = chunks.where("parent_id IS NOT NULL").select("parent_id").distinct().withColumn("text", F.concat(F.lit("parent "), "parent_id"))
    engine = Engine(spark, chunks, catalogue.vectors(spark, sf).select("chunk_id", "embedding"), parents)
    asked, vectors = catalogue.questions(spark, sf).limit(3), catalogue.query_vectors(spark, sf)
    found = engine.search(asked, vectors, top_k=5)
    assert found.where("neighbor_of IS NULL").groupBy("qid").count().agg(F.max("count")).first()[0] <= 5
    answers = engine.answer(asked, found, lambda prompt: "<think>x</think>Yes [1] and [77]. CONFIDENCE: HIGH").collect()
    assert {(r["confidence"], tuple(r["dangling"])) for r in answers} == {("HIGH", (77,))}
    both = engine.compare(asked, {"a": {"rerank_mode": "none"}, "b": {"rerank_mode": "lexical"}}, vectors)
    assert evaluation.pairwise(both).count() == 3


def test_engine_steps(spark):
    """HyDE, code and scope lanes, a live lane and neighbours, and the echo of all of them."""
    from corpuscle.operators import lanes
    from corpuscle.plans.engine import Engine

    rows = [(str(i), f"word{i} common page {i}", "book.pdf" if i < 6 else "notes/x.md", "pdf" if i < 6 else ("py" if i == 8 else "note"), "ml" if i < 6 else "db", i) for i in range(10)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, source_file string, file_type string, domain string, page_start int").withColumns({"tags": F.array(F.lit("x")), "has_code": F.col("file_type") == "py", "parent_id": F.lit(None).cast("string")})
    asked = spark.createDataFrame([(1, "common word3"), (2, "python code common"), (3, "common about databases"), (4, "nothing here")], "qid long, question string")
    live = spark.createDataFrame([(1, "live", lanes.ORDER["live"], 0, "omni::n.md", None, "a fresh note on word3")], "qid long, lane string, lane_ord int, rank0 int, chunk_id string, score double, text string")

    def suppose(question):
        if "nothing" in question:
            return "word7"
        raise RuntimeError("no model")

    engine = Engine(spark, chunks, scopes=(lanes.Scope("db", ("database",)),), presets={"code": {"boost_code": True}}, settings={"auto_preset": True, "hyde": True, "top_k": 3}, hypothesis=suppose)
    docs, echo = engine.search_with_echo(asked, live=live, rerank_mode="none")
    told = {r["qid"]: r.asDict() for r in echo.collect()}
    assert {q: r["boost_code"] for q, r in told.items()} == {1: False, 2: True, 3: False, 4: False}
    assert told[2]["preset"] == "code" and [told[q]["hyde_used"] for q in (1, 2, 3, 4)] == [False, False, False, True]
    assert [told[q]["scope"] for q in (1, 3)] == [[], ["domain:db"]] and told[1]["live_hits"] == 1
    by = {}
    for r in docs.orderBy("rank").collect():
        by.setdefault(r["qid"], []).append(r)
    assert {r["chunk_id"] for r in by[1]} >= {"3", "omni::n.md", "2", "4"} and told[1]["neighbors"] == sum(r["neighbor_of"] is not None for r in by[1]) > 0
    assert by[2][0]["chunk_id"] == "8" and all(int(r["chunk_id"]) >= 6 for r in by[3] if r["neighbor_of"] is None)
    assert [r["chunk_id"] for r in by[4]][0] == "7"
    plain = engine.search(asked, rerank_mode="none", auto_preset=False, scope_routing=False, neighbor_context=False)
    assert plain.groupBy("qid").count().agg(F.max("count")).first()[0] == 3
