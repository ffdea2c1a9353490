"""Each stage against a plain restatement, over real rows and awkward ones with clashing columns; then the whole."""

import collections
import re

import pytest
from pyspark.sql import functions as F
from test_brute import similar_components

import corpus_pipeline
from corpuscle.llm import mixing, scratch, toxicity

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted int, score double, n_words long, n_removed string, kept string, _id long, _n long, _size string, id long, row long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"w{i}" for i in range(130)]
    near = [*base[:60], "other", *base[61:]]
    part = ["new", *base[:70], *(f"v{i}" for i in range(300))]
    odd = [(None, " ".join(base), "en", "src1"), (900, None, None, None), (901, "", "en", None), (902, " \n", "en", ""), (903, " ".join(base), "en", "src1"), (903, " ".join(base), "en", "src1"), (904, "  ".join(near), "en", "src1"), (905, "\n".join(part), "en", "src2"), (906, "long words " * 30000, "en", "src3"), (907, "z" * 50000, "xx", "日本"), (908, "one", "en", "src2"), (909, "one", "en", "src2")]
    rows = [(*r, len(r[1] or ""), 1, 2.0, 3, "x", "x", 4, 5, "x", 6, 7) for r in real + odd]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def run(name, spark, docs, sf):
    return scratch.save(STAGES[name](spark, docs, sf), f"test-{name}")


def texts(df):
    return collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["row"]) for r in df.collect())


def test_toxicity(spark, docs, sf):
    out = run("toxicity", spark, docs, sf)
    assert out.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    weights, bias = toxicity.train(docs.select("doc_id", "text"), labels)
    bad = {}
    for t in {r["text"] for r in docs.select("text").collect()}:
        [(f, n)] = toxicity.counted([t])
        bad[t] = 1 / (1 + 2.718281828459045 ** -(float((toxicity.values(n) * weights[f]).sum()) + bias)) >= 0.7
    assert texts(out) == collections.Counter({k: n for k, n in texts(docs).items() if not bad[k[1]]})


def test_near_dedup(spark, docs, sf):
    out = run("near_dedup", spark, docs, sf)
    assert out.columns == docs.columns
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    keep = {i for i, (_, c) in similar_components(rows, k=5).items() if i == c} | {None}
    assert 904 not in keep and {903, 905, 908} <= keep and 909 not in keep
    assert texts(out) == collections.Counter({k: n for k, n in texts(docs).items() if k[0] in keep})


def test_substring_dedup(spark, docs, sf):
    out = run("substring_dedup", spark, docs, sf)
    assert out.columns == docs.columns
    first, want = {}, collections.Counter()
    rows = docs.collect()
    for r in rows:
        w = words(r["text"])
        for k in range(len(w) - 49 if r["doc_id"] is not None else 0):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    for r in rows:
        w = words(r["text"])
        off = [False] * len(w)
        for k in range(len(w) - 49 if r["doc_id"] is not None else 0):
            if first[tuple(w[k : k + 50])] < r["doc_id"]:
                off[k : k + 50] = [True] * 50
        if not any(off):
            want[(r["doc_id"], r["text"], r["n_chars"])] += 1
        elif not all(off):
            want[(r["doc_id"], tuple(x for x, o in zip(w, off, strict=True) if not o), None)] += 1
    got = collections.Counter()
    for r in out.collect():
        whole = (r["doc_id"], r["text"], r["n_chars"])
        got[whole if whole in want else (r["doc_id"], tuple(words(r["text"])), None)] += 1
        assert r["n_chars"] == len(r["text"] or "")
    assert got == want and any(k[2] is None for k in want)


def test_mixing(spark, docs, sf):
    out = run("mixing", spark, docs, sf)
    assert out.columns == docs.columns
    known = {(r["doc_id"], r["source"], r["text"]): r for r in docs.collect()}
    taken, target = collections.Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["taken"]
        target[r["source"]] = r["target"]
    got = collections.Counter()
    by = collections.defaultdict(list)
    for i, s, t in known:
        by[i, s].append(words(t))
    for r in out.collect():
        w = words(r["text"])
        origin = next(x for x in by[r["doc_id"], r["source"]] if x[: len(w)] == w)
        assert w and r["n_chars"] == len(r["text"])
        got[r["doc_id"], r["source"], len(origin)] += len(w)
    assert all(abs(got[k] - taken[k]) <= 1 for k in taken)
    for s, t in target.items():
        assert abs(sum(n for k, n in got.items() if k[1] == s) - t) <= 0.02 * t + 2


def test_packing(spark, docs, sf):
    out = run("packing", spark, docs, sf).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["row"]].append(r)
    assert collections.Counter(p[0]["doc_id"] for p in by.values()) == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    place = 0
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 4096 + r["offset"] == place
        place += r["length"]


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, docs, sf, name):
    out = STAGES[name](spark, docs.limit(0), sf)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf), f"test-{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > 150 and sizes[1] <= sizes[0] and sizes[2] <= sizes[1]
    again = collections.Counter(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert sum(r[2] * n for r, n in again.items()) == docs.agg({"length": "sum"}).first()[0]
