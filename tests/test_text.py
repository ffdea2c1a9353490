from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import evaluation as E


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_page_spec(spark):
    cases = {("1-3,5", 9): [0, 1, 2, 4], ("7", 9): [6], ("3, 1-2 ,3", 9): [0, 1, 2], ("1-9999", 3): [0, 1, 2], ("0", 9): None, ("5-3", 9): None, ("a-b", 9): None, ("1-2-3", 9): None, ("-4", 9): None}
    for (spec, pages), want in cases.items():
        assert one(spark, T.page_spec(F.lit(spec), F.lit(pages)))[0] == want


def test_ngrams(spark):
    lists = {("adam",): ["adam"], (): [], ("a", "b", "c"): ["a b", "b c"]}
    for words, want in lists.items():
        column = F.array(*map(F.lit, words)).cast("array<string>")
        assert one(spark, T.ngrams(column, 2))[0] == want


def test_sentences(spark):
    assert len(one(spark, T.sentences(F.lit("Gradients vanish over long sequences. [1][2]\nUse clipping. [3]")))[0]) == 2


def test_scripts(spark):
    got = [one(spark, T.detect_script(F.lit(t)))[0] for t in ("plain text", "Привет мир", "Բարեւ", "", "abcde Привет")]
    assert got == ["latin", "cyrillic", "armenian", "empty", "mixed (cyrillic+latin)"]


def test_citations(spark):
    rate, dangling = E.citation_validity(F.lit("Yes [1] and [9]."), F.lit(3))
    assert tuple(one(spark, rate, dangling)) == (0.5, [9])
    rate, _ = E.citation_validity(F.lit("nothing"), F.lit(3))
    assert one(spark, rate)[0] is None


def test_signals(spark):
    for text, want in (("my codes", "code"), ("encoder", None), ("geom_point", "geom_")):
        assert one(spark, T.first_signal(F.lit(text), ["code", "geom_"]))[0] == want


def test_paths_and_ids(spark):
    assert one(spark, T.normalize_path(F.lit("A\\Lecture – 3.PDF ")))[0] == "a/lecture - 3.pdf"
    assert one(spark, T.evidence_id(F.lit("c"), F.lit("section-1"), F.lit(False), F.lit("o"), F.lit("t")))[0] == "parent:section-1"
    assert one(spark, T.clean_markdown(F.lit("![[a]] [[b|c]] [[d]]<!-- x\n-->\n\n\n\ne")))[0] == "[image: a] c d\n\ne"


def test_dates(spark):
    got = [one(spark, T.note_date(F.lit(t)))[0] for t in ("28.05.2026", "2026-05-28", "note")]
    assert got == ["2026-05-28", "2026-05-28", None]


def test_folding(spark):
    found = spark.createDataFrame([(1, "ﬁle/Ａ.pdf")], "qid int, source_file string")
    wanted = spark.createDataFrame([(1, "file/a"), (1, "other")], "qid int, fragment string")
    assert E.recall_at_k(found, wanted, fold=True).first()["recall"] == 0.5


def test_groundedness(spark):
    docs = spark.createDataFrame([(1, 1, "Gradient clipping limits exploding gradients."), (1, 2, "Nothing else.")], "qid int, rank int, text string")
    answers = spark.createDataFrame([(1, "Gradient clipping limits exploding gradients [1]. Bananas grow in tropical soil [2]. No mark.")], "qid int, answer string")
    r = E.groundedness(answers, docs).first()
    assert (r["n_sentences_scored"], r["n_sentences_uncited"], r["worst_overlap"]) == (2, 1, 0.0) and r["score"] == 0.5
