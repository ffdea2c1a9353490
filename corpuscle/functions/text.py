"""Text expressions: tokens, labels, identifiers, parsing of answers. All but ``nfkc`` run in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS: tuple[str, ...] = tuple(
    """
    a an the and or but if then than that this these those there here
    is are was were be been being am do does did doing done
    have has had having will would shall should can could may might must
    of in on at to for from by with without within into onto over under
    as it its it's we you they he she i our your their his her them us me
    not no nor so such both each few more most other some any own same
    about above below after before between during through against
    what which who whom whose when where why how
    """.split()
)
#: Hyphens, dashes and the minus sign, all read as "-".
DASHES = "‐‑‒–—―−"
#: Phrases by which an answer says that it found nothing.
PUNTS = ("don't cover", "dont cover", "not contain", "no relevant", "don't contain")


def tokens(text: Column) -> Column:
    """Index tokens: runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def lexical_tokens(text: Column) -> Column:
    """Tokens of the lexical reranker, in which an underscore is a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks: by Arrow batches in Python. ASCII text is in normal form already."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(text)


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def content_tokens(text: Column) -> Column:
    """Words without stopwords, repeats kept; for text that is in normal form (see ``nfkc``)."""
    words = F.regexp_extract_all(F.lower(fold_dashes(text)), F.lit("([a-z0-9]+(?:[-_'][a-z0-9]+)*)"), 1)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def normalize_path(path: Column) -> Column:
    """A path without regard to case, separators, dashes and spacing; for text in normal form."""
    flat = F.lower(F.replace(fold_dashes(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")))
    return F.btrim(F.regexp_replace(flat, r"(?U)\s+", " "))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams, joined by spaces; of fewer words than n, the one that all make; of none, none."""
    size = F.size(words)
    width = F.least(F.lit(n), F.greatest(size, F.lit(1)))
    made = F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(size > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def chunk_id(source_file: Column, text: Column) -> Column:
    """Content-addressed identity of a chunk: its file and the first 500 code points."""
    return F.substring(F.sha2(F.concat(source_file, F.lit("::"), F.substring(text, 1, 500)), 256), 1, 16)


def parent_id(source_file: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_file, F.lit("::P"), index.cast("string"), F.lit("::"), F.substring(text, 1, 200)), 256), 1, 16)


def evidence_id(chunk: Column, parent: Column, live: Column, origin: Column, text: Column) -> Column:
    """What a source is cited by: its parent if that stands in for it, a digest if it is live, else the chunk."""
    digest = F.substring(F.sha2(F.concat(origin, F.lit("\0"), text), 256), 1, 20)
    return F.when(parent.isNotNull(), F.concat(F.lit("parent:"), parent)).when(live, F.concat(F.lit("live:"), digest)).otherwise(chunk)


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…")))


def preview(text: Column, n: int) -> Column:
    """The stripped text, cut to n code points with an ellipsis as the last."""
    return clip(F.btrim(text), n)


def context_header(course: Column, date: Column, headings: Column) -> Column:
    """``[Course: … | Date: … | Section: A > B]`` and a line end; empty without parts."""
    known = F.when((course != "") & (course != "unknown"), F.concat(F.lit("Course: "), course))
    dated = F.when(date != "", F.concat(F.lit("Date: "), date))
    section = F.when(F.size(headings) > 0, F.concat(F.lit("Section: "), F.array_join(headings, " > ")))
    parts = F.concat_ws(" | ", known, dated, section)
    return F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]\n")))


def stem(path: Column) -> Column:
    """A file's name without folders and without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def retrieval_label(course: Column, date: Column, path: Column, chunk: Column) -> Column:
    known = F.nullif(course, F.lit(""))
    return F.when(known.isNotNull() & (date != ""), F.concat(known, F.lit(" ("), date, F.lit(")"))).otherwise(F.coalesce(known, F.nullif(stem(path), F.lit("")), chunk))


def citation_label(file_type: Column, filename: Column, chapter: Column, page: Column, course: Column, heading: Column, live: Column, fallback: str = "source") -> Column:
    """Books by file, chapter and page; notes by course and heading; live notes as such."""
    name = F.nullif(F.coalesce(filename, F.lit("")), F.lit(""))
    chapter = F.btrim(F.coalesce(chapter, F.lit("")))
    new = (chapter != "") & ~F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lower(chapter))
    book = F.concat(F.coalesce(clip(name, 55), F.lit(fallback)), F.when(new, F.concat(F.lit(" › "), clip(chapter, 45))).otherwise(""), F.when(page > 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise(""))
    course = F.btrim(F.coalesce(course, F.lit("")))
    course = F.when(F.lower(course) == "unknown", "").otherwise(course)
    heading = F.btrim(F.coalesce(heading, F.lit("")))
    second = F.when((heading != "") & (F.lower(heading) != F.lower(course)), clip(heading, 50))
    note = F.nullif(F.concat_ws(" › ", F.when(course != "", clip(course, 50)), second), F.lit(""))
    fresh = F.concat(clip(F.coalesce(stem(name), F.lit("note")), 50), F.lit(" (live vault)"))
    return F.when(live, fresh).when(F.lower(file_type) == "pdf", book).otherwise(F.coalesce(note, clip(name, 55), F.lit("note")))


def signal_pattern(signal: str) -> str:
    """A signal as a Java expression over lower-cased text: whole words, a plural s allowed; an edge that is no letter or digit is open."""
    signal = signal.strip().lower()
    body = re.sub(r"([^\w\s])", r"\\\1", signal)
    return ("(?U)\\b" if signal[0].isalnum() else "") + body + ("s?\\b" if signal[-1].isalnum() else "")


def first_signal(text: Column, signals: Sequence[str]) -> Column:
    """The first of the signals that the text holds, else null."""
    held = [F.when(F.rlike(F.lower(text), F.lit(signal_pattern(s))), F.lit(s)) for s in signals if s.strip()]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


#: Ranges of letters by script, as (first, last).
SCRIPTS: Mapping[str, tuple[str, str]] = {"latin": ("A", "ɏ"), "cyrillic": ("Ѐ", "ӿ"), "armenian": ("԰", "֏")}


def script_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(f"[{a}-{b}]")) for name, (a, b) in SCRIPTS.items()}


def detect_script(text: Column) -> Column:
    """The script of at least 60 % of the letters; ``mixed (a+b)`` of the two most frequent; ``empty`` without letters."""
    counts = script_counts(text)
    total = sum(counts.values(), F.lit(0))
    ranked = F.sort_array(F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts.items())]))
    mixed = F.concat(F.lit("mixed ("), ranked[0]["name"], F.lit("+"), ranked[1]["name"], F.lit(")"))
    return F.when(total == 0, "empty").when(-ranked[0]["n"] / total < 0.6, mixed).otherwise(ranked[0]["name"])


def skips_script(script: Column, skipped: Sequence[str]) -> Column:
    """Whether a script is to be skipped, alone or as part of a mixture."""
    part = F.exists(F.array(*map(F.lit, skipped)).cast("array<string>"), lambda s: F.contains(script, s))
    return script.isin(*skipped) | (F.startswith(script, F.lit("mixed")) & part) if skipped else F.lit(False)


def wikilinks(text: Column) -> Column:
    """Targets of [[target|shown]] links, in order, 20 at most."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), 1), 1, 20)


def hashtags(text: Column) -> Column:
    """Distinct #tags outside fenced code, in order of name."""
    fenced = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines")),
        lambda a, line: F.struct((a["inside"] != F.rlike(line, F.lit(r"^\s*```"))).alias("inside"), F.when(a["inside"] | F.rlike(line, F.lit(r"^\s*```")), a["lines"]).otherwise(F.concat(a["lines"], F.array(line))).alias("lines")),
    )["lines"]
    found = F.flatten(F.transform(fenced, lambda line: F.regexp_extract_all(line, F.lit(r"(?U)(?:^|\s)#([a-zA-Z][\w/-]*)"), 1)))
    return F.array_sort(F.array_distinct(found))


def clean_markdown(text: Column) -> Column:
    """Embeds become ``[image: x]``, links their shown text; comments and runs of blank lines go."""
    steps = (
        (r"!\[\[([^\]]*)\]\]|!\[([^\]]*)\]\([^)]*\)", "[image: $1$2]"),
        (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"),
        (r"\n\n\n+", "\n\n"),
        (r"(?s)<!--.*?-->", ""),
    )
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text, F.lit(" \t\r\n"))


#: What marks code and formulas in a text.
CODE = r"```|\n {4,}\S|\bdef \w+\(|\bclass \w+"
FORMULA = r"\$[^$\n]*[\\^_={}][^$\n]*\$|\\\[|\\begin\{|\\frac|\\sum|\\int"


def has_code(text: Column) -> Column:
    return F.rlike(text, F.lit(CODE))


def has_formula(text: Column) -> Column:
    return F.rlike(text, F.lit(FORMULA))


def note_date(filename: Column) -> Column:
    """An ISO date from day, month, year in a name, else from year, month, day, else null."""
    dmy, ymd = r"(\d{2})[-_.](\d{2})[-_.](\d{4})", r"(\d{4})[-_.](\d{2})[-_.](\d{2})"
    joined = lambda pattern, order: F.concat_ws("-", *[F.regexp_extract(filename, pattern, i) for i in order])
    return F.when(F.rlike(filename, F.lit(dmy)), joined(dmy, (3, 2, 1))).when(F.rlike(filename, F.lit(ymd)), joined(ymd, (1, 2, 3)))


#: Names of daily notes, and of folders that hold them unless others are given.
DAILY_NAMES = (r"^\d{2}[-_.]\d{2}[-_.]\d{4}$", r"^\d{4}[-_.]\d{2}[-_.]\d{2}$", r"^\w+\s+\d{1,2},?\s+\d{4}$", r"^\d{1,2}\s+\w+\s+\d{4}$")
DAILY_FOLDERS = ("daily notes", "daily", "dailies", "journal")


def is_daily_note(path: Column, folders: Sequence[str] = DAILY_FOLDERS) -> Column:
    parts = F.split(F.lower(path), r"[/\\]")
    return F.rlike(stem(path), F.lit("|".join(DAILY_NAMES))) | F.arrays_overlap(parts, F.array(*map(F.lit, folders)).cast("array<string>"))


def url_slug(url: Column) -> Column:
    """A URL as a safe file name: host and last part of the path, 120 code points at most."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    tail = F.nullif(F.regexp_extract(bare, r"([^/]*)$", 1), F.lit(""))
    host = F.regexp_extract(F.regexp_replace(url, r"^https?://(www\.)?", ""), r"^([^/]*)", 1)
    name = F.substring(F.concat(host, F.lit("__"), F.coalesce(tail, F.lit("page"))), 1, 120)
    return F.regexp_replace(name, r"(?U)[^\w.\- ()\[\]]", "_")


def html_text(html: Column) -> Column:
    """The visible text of a page: no scripts, styles or tags; common entities read; spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[ \t\r\n\f\x0B]+", " "))


def page_spec(spec: Column, pages: Column) -> Column:
    """``1-3,5`` as sorted 0-based page numbers below ``pages``; null where the specification is wrong."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.btrim(p)), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"^(\d{1,9})", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d{1,9})$", 1).cast("int")
    right = lambda p: F.rlike(p, F.lit(r"^\d{1,9}(\s*-\s*\d{1,9})?$")) & (low(p) >= 1) & (high(p) >= low(p))
    none = F.array().cast("array<int>")
    numbers = lambda p: F.when(low(p) <= pages, F.sequence(low(p) - 1, F.least(high(p), pages) - 1)).otherwise(none)
    return F.when((F.size(parts) > 0) & F.forall(parts, right), F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers)))))


def citations(answer: Column) -> Column:
    """The numbers of [n] marks, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))


def sentences(text: Column) -> Column:
    """Sentences; one of citation marks alone is joined to the one before it."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    only = lambda p: F.rlike(p, F.lit(r"^(?:\s*\[\d+\]\s*)+[.,;]?$"))
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, p: F.when((F.size(a) > 0) & only(p), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), p)))).otherwise(F.concat(a, F.array(p))),
    )


def confidence(answer: Column) -> Column:
    """The stated confidence, else UNKNOWN."""
    said = F.upper(F.regexp_extract(answer, r"(?i)CONFIDENCE:\s*(HIGH|MEDIUM|LOW)", 1))
    return F.when(said == "", "UNKNOWN").otherwise(said)


def strip_reasoning(answer: Column) -> Column:
    """Without reasoning blocks; of a block that never ends, what follows its mark is kept."""
    out = F.regexp_replace(answer, r"(?is)<think>.*?</think>", "")
    cut = F.rlike(out, F.lit("(?i)<think>")) & ~F.rlike(out, F.lit("(?i)</think>"))
    return F.btrim(F.when(cut, F.regexp_replace(out, r"(?is)^.*<think>", "")).otherwise(out), F.lit(" \t\r\n"))


def json_body(answer: Column) -> Column:
    """The outermost object within an answer, code fences or other words around it aside."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def questions_of(answer: Column, n: int) -> Column:
    """The first n lines of more than 10 characters with a question mark, without list marks."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.btrim(x, F.lit(" -•\t")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 10) & F.contains(x, F.lit("?"))), 1, n)


def punted(answer: Column, markers: Sequence[str] = PUNTS) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def clamp_score(value: Column) -> Column:
    """A score within 0 and 1; what is no number is null."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def meta_string(items: Column) -> Column:
    """A list as the vector store keeps it."""
    return F.array_join(items, ", ")
