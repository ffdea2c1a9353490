"""Corpus analytics and maintenance over chunk tables.

A chunk table has chunk_id, source_file, course, domain, file_type, tags (array), jsonl
(the file it came from) and ord (its place in reading order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in an explicit order; rows without a key all stay."""
    own = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


def in_order(values: DataFrame, keys: Sequence[str], most: int | None = None, out: str = "values") -> DataFrame:
    """(keys, value, place) to the distinct values of each key in order of their first place.

    Values are counted down to one row each before they are gathered, so an array is as
    long as a key has values, however many rows it has.
    """
    first = values.where("value <> ''").groupBy(*keys, "value").agg(F.min("place").alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"])
    return first.groupBy(*keys).agg((F.slice(listed, 1, most) if most else listed).alias(out))


def manifest(chunks: DataFrame) -> DataFrame:
    """One row per source_file: chunks, course, domain, file_types, tags, jsonls.

    Within a file the last known course and the last domain but ``general`` hold, across
    files the first; types and tags are listed in order of appearance (15 tags a file).
    """
    place, keys = F.col("ord"), ["source_file", "jsonl"]
    known = F.when((F.col("course") != "") & (F.lower("course") != "unknown"), F.col("course"))
    special = F.when((F.col("domain") != "") & (F.lower("domain") != "general"), F.col("domain"))
    each = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"), F.max_by(known, F.when(known.isNotNull(), place)).alias("course"),
        F.coalesce(F.max_by(special, F.when(special.isNotNull(), place)), F.min_by("domain", place)).alias("domain"),
    )
    types = in_order(chunks.select(*keys, F.col("file_type").alias("value"), place.alias("place")), keys)
    tags = in_order(chunks.select(*keys, "ord", F.posexplode("tags").alias("at", "value")).select(*keys, "value", F.struct("ord", "at").alias("place")), keys, 15)
    across = lambda lists, out: in_order(lists.select("source_file", "jsonl", F.posexplode("values").alias("at", "value")).select("source_file", "value", F.struct("jsonl", "at").alias("place")), ["source_file"], out=out)
    merged = each.groupBy("source_file").agg(F.sum("chunks").alias("chunks"), F.min_by("course", F.when(F.col("course").isNotNull(), F.col("jsonl"))).alias("course"), F.min_by("domain", F.when(F.col("domain") != "", F.col("jsonl"))).alias("domain"), F.array_sort(F.collect_set("jsonl")).alias("jsonls"))
    none = F.array().cast("array<string>")
    found = merged.join(across(types, "file_types"), "source_file", "left").join(across(tags, "tags"), "source_file", "left")
    return found.select("source_file", "chunks", "course", "domain", F.coalesce("file_types", none).alias("file_types"), F.coalesce("tags", none).alias("tags"), "jsonls")


def overview(found: DataFrame) -> DataFrame:
    """(facet, value, n) of a manifest: files, chunks, chunks by domain, chunks by file (a document counts in each of its files)."""
    total = found.agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"))
    totals = total.select(F.explode(F.array(F.struct(F.lit("total").alias("facet"), F.lit("files").alias("value"), F.col("files").alias("n")), F.struct(F.lit("total").alias("facet"), F.lit("chunks").alias("value"), F.col("chunks").alias("n")))).alias("r")).select("r.*")
    domains = found.groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")).alias("value")).agg(F.sum("chunks").alias("n")).select(F.lit("domain").alias("facet"), "value", "n")
    files = found.select(F.explode("jsonls").alias("value"), "chunks").groupBy("value").agg(F.sum("chunks").alias("n")).select(F.lit("jsonl").alias("facet"), "value", "n")
    return totals.unionByName(domains).unionByName(files)


def most_common(counted: DataFrame, k: int | None) -> DataFrame:
    """The k largest counts by (n descending, value)."""
    ordered = counted.orderBy(F.col("n").desc(), "value")
    return ordered.limit(k) if k else counted


def facets(found: DataFrame, courses: int = 40, tags: int = 60) -> DataFrame:
    """(facet, value, n): documents by domain, course and tag."""
    by = lambda frame, name, k: most_common(frame.groupBy("value").agg(F.count(F.lit(1)).alias("n")), k).select(F.lit(name).alias("facet"), "value", "n")
    domain = found.select(F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")).alias("value"))
    course = found.where("course <> ''").select(F.col("course").alias("value"))
    tag = found.select(F.explode("tags").alias("value"))
    return by(domain, "domain", None).unionByName(by(course, "course", courses)).unionByName(by(tag, "tag", tags))


def stats(chunks: DataFrame, courses: int = 20) -> DataFrame:
    """(facet, value, n): chunks by domain, file type and most frequent courses, in one pass of grouping sets."""
    named = chunks.select(F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")).alias("domain"), F.coalesce(F.nullif("file_type", F.lit("")), F.lit("?")).alias("file_type"), F.coalesce(F.nullif("course", F.lit("")), F.lit("unknown")).alias("course"))
    sets = named.groupingSets([[F.col("domain")], [F.col("file_type")], [F.col("course")]], F.col("domain"), F.col("file_type"), F.col("course")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    facet = F.when(F.col("_g") == 3, "domain").when(F.col("_g") == 5, "file_type").otherwise("course")
    rows = sets.select(facet.alias("facet"), F.coalesce("domain", "file_type", "course").alias("value"), "n")
    return rows.where("facet <> 'course'").unionByName(most_common(rows.where("facet = 'course'"), courses))


def documents(found: DataFrame, q: str = "", domain: str = "", course: str = "", jsonl: str = "", tag: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the manifest by (chunks descending, source_file), with the total of all that fit."""
    rows = found
    if q.strip():
        rows = rows.where(F.contains(F.lower("source_file"), F.lit(q.strip().lower())))
    if domain:
        rows = rows.where(F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")) == domain)
    if course:
        rows = rows.where(F.contains(F.lower(F.coalesce("course", F.lit(""))), F.lit(course.lower())))
    if jsonl:
        rows = rows.where(F.array_contains("jsonls", jsonl))
    wanted = tag.strip().lstrip("#").lower()
    if wanted:
        rows = rows.where(F.exists("tags", lambda t: F.lower(t) == wanted))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.col("chunks").desc(), "source_file").offset(max(0, offset)).limit(max(1, min(limit, 500)))
    return page.crossJoin(F.broadcast(total))


def retag(chunks: DataFrame, sources: DataFrame, domain: str | None = None, course: str | None = None, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """Chunks with new metadata where their source_file is one of ``sources``; tags go without regard to case, new ones follow."""
    hit = sources.select("source_file").distinct().withColumn("_hit", F.lit(True))
    out = chunks.join(hit, "source_file", "left")
    gone = [t.lower() for t in remove]
    kept = F.filter("tags", lambda t: ~F.lower(t).isin(*gone)) if gone else F.col("tags")
    tags = F.concat(kept, F.array_except(F.array(*map(F.lit, add)), kept)) if add else kept
    new = {"tags": F.when(F.col("_hit"), tags).otherwise(F.col("tags"))}
    if domain:
        new["domain"] = F.when(F.col("_hit"), F.lit(domain.lower())).otherwise(F.col("domain"))
    if course:
        new["course"] = F.when(F.col("_hit"), F.lit(course)).otherwise(F.col("course"))
    return out.withColumns(new).select(*chunks.columns)


def delete_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.join(sources.select("source_file").distinct(), "source_file", "left_anti").select(*chunks.columns)


def delete_matching(chunks: DataFrame, fragment: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, preview of what goes: source_file, n) for a part of the source's name."""
    hit = F.contains(F.lower(F.coalesce("source_file", F.lit(""))), F.lit(fragment.lower()))
    return chunks.where(~hit), chunks.where(hit).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of the same key; of several in ``new`` one, by its columns' order."""
    latest = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*").select(*table.columns)
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(latest)


def resolve_taxonomy(paths: DataFrame, folders: DataFrame, codes: DataFrame, keywords: DataFrame, domains: DataFrame) -> DataFrame:
    """(path) to (path, course, domain) by three stages of small tables.

    First the folder nearest the root that is named in ``folders`` (folder, course); then a
    part that fits a pattern of ``codes`` (pattern, course, ord); then the part nearest the
    leaf that holds a word of ``keywords`` (keyword, course, ord). ``domains`` is (course, domain).
    """
    parts = paths.select("path", F.posexplode(F.split("path", r"[/\\]")).alias("at", "part")).withColumn("part", F.lower("part"))
    one = parts.join(F.broadcast(folders), parts["part"] == F.lower(folders["folder"])).groupBy("path").agg(F.min_by("course", "at").alias("c1"))
    two = parts.join(F.broadcast(codes), F.rlike("part", F.col("pattern"))).groupBy("path").agg(F.min_by("course", F.struct("at", "ord")).alias("c2"))
    three = parts.join(F.broadcast(keywords), F.contains("part", F.lower("keyword"))).groupBy("path").agg(F.min_by("course", F.struct(-F.col("at"), "ord")).alias("c3"))
    found = paths.join(one, "path", "left").join(two, "path", "left").join(three, "path", "left").select("path", F.coalesce("c1", "c2", "c3", F.lit("unknown")).alias("course"))
    return found.join(F.broadcast(domains), "course", "left").select("path", "course", F.coalesce("domain", F.lit("general")).alias("domain"))


def recalibrate(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Chunks with course and domain of their source's path, and whether that changed them."""
    new = resolved.select(F.col("path").alias("source_file"), F.col("course").alias("_c"), F.col("domain").alias("_d"))
    joined = chunks.join(new, "source_file", "left")
    better = F.col("_c").isNotNull() & (F.col("_c") != "unknown")
    course, domain = F.when(better, F.col("_c")).otherwise(F.col("course")), F.when(better, F.col("_d")).otherwise(F.col("domain"))
    changed = ~(course.eqNullSafe(F.col("course")) & domain.eqNullSafe(F.col("domain")))
    return joined.withColumn("changed", changed).withColumns({"course": course, "domain": domain}).drop("_c", "_d")


def chapters_asof(pages: DataFrame, toc: DataFrame, most_level: int = 2) -> DataFrame:
    """(book, page) with the last chapter (book, page, title, level) that begins on it or before; on one page the last title holds."""
    kinds = pages.select("book", "page", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("title"))
    heads = toc.where(F.col("level") <= most_level).select("book", "page", F.lit(0).alias("_kind"), "title")
    before = Window.partitionBy("book").orderBy("page", "_kind", "title").rowsBetween(Window.unboundedPreceding, 0)
    both = heads.unionByName(kinds).withColumn("chapter", F.last("title", ignorenulls=True).over(before))
    return both.where("_kind = 1").select("book", "page", "chapter")


def page_ranges(pages: DataFrame) -> DataFrame:
    """(book, page) to (book, spec): runs of pages as ``1-3,7``."""
    islands = pages.distinct().withColumn("_g", F.col("page") - F.row_number().over(Window.partitionBy("book").orderBy("page")))
    runs = islands.groupBy("book", "_g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda r: r["t"]), ",").alias("spec"))


def ocr_report(pages: DataFrame, threshold: int = 50, sparse: int = 4) -> DataFrame:
    """(book, page, chars) to one row per book: how much of it has no text of its own."""
    need, thin = F.col("chars") < threshold, (F.col("chars") >= threshold) & (F.col("chars") < threshold * sparse)
    out = pages.groupBy("book").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(need).alias("n_needs_ocr"), F.count_if(thin).alias("n_sparse"))
    kind = F.when(F.col("n_needs_ocr") == 0, "born_digital").when(F.col("n_needs_ocr") == F.col("page_count"), "fully_scanned").otherwise("mixed")
    return out.withColumn("pct_needs_ocr", F.round(100.0 * F.col("n_needs_ocr") / F.col("page_count"), 1)).withColumn("kind", kind)
