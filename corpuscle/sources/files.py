"""Discovery of files and JSON-lines tables of chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never entered, and names of generated files.
SKIPPED_FOLDERS = (
    ".git .hg .svn .obsidian .trash .ipynb_checkpoints node_modules bower_components vendor site-packages venv .venv env .env __pycache__ "
    "dist build out target .next .nuxt .output _Backups .gradle .idea .vscode"
).split()
GENERATED = r"(?i)\.(min|bundle|generated|lock)\."


def scan(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path relative to the root, name, length, modified, content) of files by suffix, read where they lie.

    Filters on path and length that callers add reach the scan; content of files that
    they drop is never read.
    """
    glob = "*.{" + ",".join(sorted({c for s in suffixes for c in (s.lstrip(".").lower(), s.lstrip(".").upper())})) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*(?=/)", "")
    relative = F.substring(path, len(base) + 2, 1 << 20)
    return raw.select(relative.alias("path"), F.regexp_extract(relative, r"([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def discover_notes(files: DataFrame, skip: Sequence[str] = SKIPPED_FOLDERS, skip_roots: Sequence[str] = (), include: str = "", least: int = 50) -> DataFrame:
    """Markdown files outside skipped folders, of a least size, no drawings; sorted order is left to whoever needs it."""
    kept = files.where(F.lower("name").endswith(".md") & (F.col("length") >= least) & ~F.contains(F.lower("name"), F.lit("excalidraw")))
    return _within(kept, skip, skip_roots, include)


def discover_code(files: DataFrame, suffixes: Sequence[str], skip: Sequence[str] = SKIPPED_FOLDERS, skip_roots: Sequence[str] = (), include: str = "", most: int = 1_500_000) -> DataFrame:
    """Source files by suffix, none generated or too large; roots that are skipped by default are not when ``include`` names a path."""
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    kept = files.where(suffix.isin(*suffixes) & ~F.rlike("name", F.lit(GENERATED)) & (F.col("length") <= most))
    return _within(kept, skip, () if include else skip_roots, include)


def _within(files: DataFrame, skip: Sequence[str], skip_roots: Sequence[str], include: str) -> DataFrame:
    out = files
    if skip:
        out = out.where(~F.arrays_overlap(folders(F.col("path")), F.array(*map(F.lit, skip))))
    if skip_roots:
        out = out.where(~F.lower(F.split("path", "/")[0]).isin(*[r.lower() for r in skip_roots]))
    return out.where(F.contains(F.lower("path"), F.lit(include.lower()))) if include else out


def pdf_drops(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), skip_paths: DataFrame | None = None, book_words: Sequence[str] = ()) -> DataFrame:
    """PDF files with ``drop_reason``: the first rule, in order, that leaves a file out; null if none does."""
    low = F.lower("path")
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w)))
    files = files.withColumn("_path", low)
    listed = F.lit(False)
    if skip_paths is not None:
        files = files.join(skip_paths.select(F.lower("path").alias("_path")).distinct().withColumn("_listed", F.lit(True)), "_path", "left")
        listed = F.col("_listed").isNotNull()
    reason = F.when(~holds(include), "not_included") if include else F.when(F.lit(False), "not_included")
    reason = (reason.when(holds(exclude), "excluded") if exclude else reason).when(listed, "skip_list")
    reason = reason.when(~holds(book_words), "no_book") if book_words else reason
    return files.withColumn("drop_reason", reason).drop("_path", "_listed")


def drop_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


def search_names(files: DataFrame, q: str, suffixes: Sequence[str], limit: int = 50) -> DataFrame:
    """Files whose name holds q (two characters or more), with ``truncated`` where more than ``limit`` do."""
    limit = max(1, min(limit, 200))
    if len(q.strip()) < 2:
        return files.select("path", "name").limit(0).withColumn("truncated", F.lit(False))
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    found = files.where(F.contains(F.lower("name"), F.lit(q.strip().lower())) & suffix.isin(*suffixes)).select("path", "name").orderBy("path").limit(limit + 1)
    more = found.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return found.orderBy("path").limit(limit).crossJoin(F.broadcast(more))


def indexed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with the manifest's chunk count: by path without regard to case, else by the path without ``/_ingested/``."""
    known = manifest.select(F.lower(F.replace("source_file", F.lit("\\"), F.lit("/"))).alias("_p"), F.col("chunks").alias("_c"))
    key, other = F.lower("path"), F.replace(F.lower("path"), F.lit("/_ingested/"), F.lit("/"))
    one = files.withColumn("_p", key).join(known, "_p", "left").withColumnRenamed("_c", "_1").withColumn("_p", other)
    return one.join(known, "_p", "left").withColumn("chunks", F.coalesce("_1", "_c")).drop("_p", "_1", "_c").withColumn("indexed", F.col("chunks").isNotNull())


def duplicates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose stem is that of a document in the manifest."""
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    return files.withColumn("_s", stem("path")).join(manifest.select(stem("source_file").alias("_s")).distinct(), "_s", "left_semi").drop("_s")


RECORD = "doc_id string, id string, text string, content string, metadata string"
#: Metadata fields of a chunk, and the types in which they are kept.
META = {"source_file": "string", "filename": "string", "file_type": "string", "course_name": "string", "course": "string", "course_code": "string", "domain": "string", "heading": "string", "heading_path": "string", "parent_id": "string", "page_start": "int", "date": "string", "has_code": "boolean", "tags": "string", "id": "string"}


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], strict: bool = False) -> DataFrame:
    """Chunk records as they stand: lines end at ``\\n`` alone; bad lines are dropped, or fail the read if ``strict``."""
    reader = spark.read.schema(RECORD).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json([paths] if isinstance(paths, str) else list(paths)).select("*", F.col("_metadata.file_path").alias("file"))


def read_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """Raw lines, for rewrites that must leave what they cannot read as it is."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines if blank else lines.where(F.length(F.btrim("value")) > 0)


def normalise_records(records: DataFrame, ord_: str | None = None) -> DataFrame:
    """Records of any loader as chunks: whichever key has the text, the id, the course; tags from a list or a joined string.

    A record without an id is numbered by its place, ``chunk_%06d``, in the order of ``ord_``.
    """
    meta = F.from_json(F.coalesce("metadata", F.lit("{}")), ", ".join(f"{k} {t}" for k, t in META.items())).alias("m")
    place = F.col(ord_) if ord_ else F.monotonically_increasing_id()
    read = records.select("*", meta, place.alias("ord"))
    tags = F.coalesce(F.from_json("m.tags", "array<string>"), F.filter(F.transform(F.split("m.tags", ","), lambda t: F.btrim(t)), lambda t: t != ""), F.array().cast("array<string>"))
    course = F.coalesce(*[F.nullif(f"m.{c}", F.lit("")) for c in ("course_name", "course", "course_code")], F.lit(""))
    named = F.coalesce("doc_id", "id", "m.id", F.format_string("chunk_%06d", F.col("ord")))
    return read.select(
        named.alias("chunk_id"), F.coalesce("text", "content", F.lit("")).alias("text"), F.coalesce("m.source_file", "m.filename", F.lit("?")).alias("source_file"), course.alias("course"), F.coalesce("m.domain", F.lit("")).alias("domain"),
        F.coalesce("m.file_type", F.lit("")).alias("file_type"), tags.alias("tags"), F.col("m.has_code").alias("has_code"), F.col("m.page_start").alias("page_start"), F.col("m.parent_id").alias("parent_id"), F.regexp_extract("file", r"([^/]*)$", 1).alias("jsonl"), "ord",
    )


def write_jsonl(chunks: DataFrame, path: str, meta: Mapping[str, str] | None = None) -> None:
    """Chunks as records of doc_id, text and metadata; nulls are left out."""
    fields = meta or {c: c for c in chunks.columns if c not in ("doc_id", "chunk_id", "text", "error")}
    key = "doc_id" if "doc_id" in chunks.columns else "chunk_id"
    chunks.select(F.col(key).alias("doc_id"), "text", F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("metadata")).write.option("ignoreNullFields", True).option("lineSep", "\n").json(path)


def page_rows(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html) as markdown documents: path from the URL, text below a heading that names its source."""
    from ..functions import text as T

    slug = T.url_slug(F.col("url"))
    body = T.html_text(F.coalesce("html", F.lit("")))
    return pages.select(F.concat(slug, F.lit(".md")).alias("path"), F.concat(F.lit("# "), slug, F.lit("\n\n> Fetched from "), F.col("url"), F.lit("\n\n"), body).alias("content"))
