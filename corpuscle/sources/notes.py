"""Markdown notes, notebooks and source files as chunk rows, one file at a time within a batch.

Files are (path, content); what a file yields never depends on another, so parsing is one
``mapInPandas`` without an exchange. A file that cannot be read gives a row with ``error``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import text as T
from . import chunking

CHUNK_SCHEMA = "doc_id string, text string, source_file string, file_type string, heading string, heading_level int, heading_path string, chunk_part string, parent_id string, course string, domain string, date string, tags array<string>, wikilinks array<string>, language string, has_code boolean, error string"
PARENT_SCHEMA = "parent_id string, source_file string, heading string, heading_path string, text string"
PIECE = "\n\n\0piece\0\n\n"
#: Stands in a notebook for prose of a script that is not wanted.
PLACEHOLDER = "[text in a skipped script]"
#: The language of a source file by its suffix; Python, R and notebooks are read as notes.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".sql": "sql", ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".scala": "scala", ".lua": "lua",
    ".pl": "perl", ".pm": "perl", ".jl": "julia", ".ps1": "powershell",
}
SKIP = "__SKIP__"


@dataclass
class Options:
    """What ingestion is told: sizes, strategy, and rules for courses (pattern, course), matched in order on headings."""

    most: int = chunking.MAX_SIZE
    overlap: int = chunking.OVERLAP
    least: int = chunking.MIN_SIZE
    strategy: str = "heading"
    parent_most: int = 5000
    course_rules: tuple[tuple[str, str], ...] = ()
    course_domains: dict[str, str] = field(default_factory=dict)
    outputs: bool = True
    output_most: int = 2000
    domain: str = ""
    tags: tuple[str, ...] = ()
    skip_scripts: tuple[str, ...] = ()
    daily_folders: tuple[str, ...] = T.DAILY_FOLDERS

    def course_of(self, heading: str) -> str | None:
        return next((course for pattern, course in self.course_rules if re.search(pattern, heading, re.IGNORECASE)), None)


@dataclass
class Section:
    level: int
    title: str
    content: str
    stack: list[str] = field(default_factory=list)


def frontmatter(content: str) -> tuple[dict[str, Any], str]:
    """The YAML block between the first two ``---`` and what follows it."""
    found = re.match(r"(?s)---(.*?)---\n*(.*)", content)
    if not found:
        return {}, content
    import yaml

    try:
        values = yaml.safe_load(found[1])
    except yaml.YAMLError:
        values = None
    return values if isinstance(values, dict) else {}, found[2]


def sections(body: str) -> list[Section]:
    """Headings in order, each with the text up to the next; what stands before the first is a preamble."""
    out = [Section(0, "(preamble)", "")]
    for line in body.split("\n"):
        head = re.match(r"(#{1,6})\s+(.+)$", line)
        if head:
            out.append(Section(len(head[1]), head[2].strip(), ""))
        else:
            out[-1].content += line + "\n"
    for s in out:
        s.content = s.content.strip()
    if len(out) == 1:
        out[0].title = "(untitled)"
        return out
    return out if out[0].content else out[1:]


def section_end(all_: list[Section], i: int) -> int:
    """Where the section that i heads ends: at the next heading of its level or above."""
    if all_[i].level == 0:
        return i + 1
    return next((j for j in range(i + 1, len(all_)) if 0 < all_[j].level <= all_[i].level), len(all_))


def enclosing(all_: list[Section], i: int) -> Iterator[int]:
    """The headings around i, nearest first."""
    level = all_[i].level
    for j in range(i - 1, -1, -1):
        if 0 < all_[j].level < level:
            level = all_[j].level
            yield j


_EMBED = re.compile(r"!\[\[(?P<embed>[^\]]*)\]\]|!\[(?P<image>[^\]]*)\]\([^)]*\)|\[\[(?:[^\]|]+\|)?(?P<shown>[^\]]+)\]\]")


def clean(text: str) -> str:
    """As ``functions.text.clean_markdown``: one pass over embeds and links, then blank lines and comments."""
    shown = _EMBED.sub(lambda m: m["shown"] if m["shown"] is not None else f"[image: {m['embed'] if m['embed'] is not None else m['image']}]", text)
    return re.sub("(?s)<!--.*?-->", "", re.sub("\n\n\n+", "\n\n", shown)).strip()


def outside_fences(text: str) -> list[tuple[bool, str]]:
    """(whether it is prose, part) in order; parts of code begin and end with their fences."""
    marks = [m.span() for m in re.finditer(r"(?m)^[^\S\n]*```.*$", text)]
    edges = [0]
    for opening, closing in zip(marks[::2], [*marks[1::2], (0, len(text))], strict=False):
        edges += [opening[0], closing[1]]
    return [(i % 2 == 0, text[x:y]) for i, (x, y) in enumerate(pairwise([*edges, len(text)]))]


def clean_pages(text: str) -> str:
    """Image marks and notes of left-out pictures go; outside fenced code at most two empty lines follow each other. Code keeps every byte but its image marks."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"[image: \1]", text)
    text = re.sub(r"(?i)\*\*==>\s*picture.*?omitted\s*<==\*\*", "", text)
    return "".join(re.sub(r"\n(?:[^\S\n]*\n){3,}", "\n\n\n", part) if prose else part for prose, part in outside_fences(text)).strip()


def script_of(text: str) -> str:
    """As ``functions.text.detect_script``."""
    counts = {name: sum(a <= c <= b for c in text) for name, (a, b) in T.SCRIPTS.items()}
    total, order = sum(counts.values()), sorted(counts, key=lambda n: -counts[n])
    if not total:
        return "empty"
    return order[0] if counts[order[0]] / total >= 0.6 else f"mixed ({order[0]}+{order[1]})"


def skipped(text: str, o: Options) -> bool:
    """As ``functions.text.skips_script``, for the script of a text."""
    script = script_of(text) if o.skip_scripts else ""
    return script in o.skip_scripts or (script.startswith("mixed") and any(s in script for s in o.skip_scripts))


def header(stack: list[str], course: str, date: str) -> str:
    parts = [f"Course: {course}"] * bool(course and course != "unknown") + [f"Date: {date}"] * bool(date) + ["Section: " + " > ".join(stack)] * bool(stack)
    return f"[{' | '.join(parts)}]\n" if parts else ""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def parent_of(all_: list[Section], i: int, path: str, course: str, date: str, most: int) -> tuple[dict[str, str], int] | None:
    """The outermost section around i whose whole text fits, as a parent row, and that text's length."""
    best = None
    for j in (i, *enclosing(all_, i)):
        parts = [x for s in all_[j : section_end(all_, j)] for x in ("#" * s.level + " " + s.title if s.level else "", clean(s.content) if s.content else "") if x]
        text = "\n\n".join(parts)
        if len(text) > most:
            break
        best = j, text
    if best is None:
        return None
    j, text = best
    row = {"parent_id": digest(f"{path}::P{j}::{text[:200]}"), "source_file": path, "heading": all_[j].title, "heading_path": " > ".join(all_[j].stack), "text": header(all_[j].stack, course, date) + text}
    return row, len(text)


def is_daily(path: str, folders: tuple[str, ...] = T.DAILY_FOLDERS) -> bool:
    p = PurePosixPath(path.replace("\\", "/"))
    return any(re.match(n, p.stem) for n in T.DAILY_NAMES) or any(x.lower() in folders for x in p.parts)


_DATES = (re.compile(r"(?P<day>\d\d)[-_.](?P<month>\d\d)[-_.](?P<year>\d{4})"), re.compile(r"(?P<year>\d{4})[-_.](?P<month>\d\d)[-_.](?P<day>\d\d)"))


def date_of(path: str) -> str:
    """As ``functions.text.note_date``, with "" for null."""
    name = PurePosixPath(path.replace("\\", "/")).stem
    found = next(filter(None, (p.search(name) for p in _DATES)), None)
    return "{year}-{month}-{day}".format(**found.groupdict()) if found else ""


def hashtags(body: str) -> list[str]:
    """As ``functions.text.hashtags``."""
    prose = re.split(r"(?m)^\s*?```.*$", body)[::2]
    return sorted({tag for part in prose for tag in re.findall(r"(?m)(?:^|\s)#([a-zA-Z][\w/-]*)", part)})


def pieces_of(text: str, o: Options) -> list[tuple[str, str | None]]:
    """(piece, ``i/n``) of those long enough; n counts all pieces, so the last ones may be missing."""
    parts = chunking.split(text, o.most, o.overlap, o.strategy)
    return [(p, f"{i}/{len(parts)}" if len(parts) > 1 else None) for i, p in enumerate(parts, 1) if len(p.strip()) >= o.least]


def parse_note(path: str, content: str, o: Options) -> Iterator[tuple[dict[str, Any], dict[str, str] | None]]:
    """(chunk, its parent or None) of a markdown note.

    In a standard note the first course found holds for the rest; in a daily note every
    heading of a course (three levels deep at most) starts a segment, and a heading to be
    skipped ends it until the next. Skip rules name no course in a standard note.
    """
    front, body = frontmatter(content)
    daily = is_daily(path, o.daily_folders)
    tags = hashtags(body)
    if isinstance(front.get("tags"), list):
        tags = sorted({*tags, *map(str, front["tags"])})
    date = str(front["date"]) if "date" in front else date_of(path) if daily else ""
    course = str(front["course"]) if "course" in front else ""
    if not course and not daily:
        named = [o.course_of(part) for part in re.split(r"[/\\]", path)]
        course = next((c for c in named if c and c != SKIP), "")
    links = re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", body)[:20]
    all_, stack, skipping, emitted = sections(body), [], False, []
    for i, s in enumerate(all_):
        found = o.course_of(s.title) if s.level or not daily else None
        if daily and found == SKIP:
            stack, skipping, course = [s.title], True, ""
        elif daily and found and s.level <= 3:
            stack, skipping, course = [s.title], False, found
        elif s.level:
            # What is compared is the depth of the stack, not the levels in it.
            stack = [*stack[: s.level - 1], s.title]
        s.stack = list(stack)
        if skipping or len(s.content) < o.least:
            continue
        if not daily and course in ("", "unknown") and found and found != SKIP:
            course = found
        emitted.append((i, course))
    for i, course in emitted:
        s = all_[i]
        top = header(s.stack, course, date)
        parent = parent_of(all_, i, path, course, date, o.parent_most)
        for piece, part in pieces_of(clean(s.content), o):
            linked = parent if parent and parent[1] >= int(1.3 * len(piece)) else None
            text = top + piece
            domain = o.domain or o.course_domains.get(course, "general")
            row = {"doc_id": digest(f"{path}::{text[:500]}"), "text": text, "source_file": path, "file_type": "daily_note" if daily else "note", "heading": s.title, "heading_level": s.level, "heading_path": " > ".join(s.stack), "chunk_part": part, "parent_id": linked[0]["parent_id"] if linked else None}
            row |= {"course": course or "unknown", "domain": domain, "date": date or None, "tags": [*tags, *(t for t in o.tags if t not in tags)], "wikilinks": links, "has_code": "```" in text}
            yield row, linked[0] if linked else None


def fence(source: str, language: str, o: Options) -> str:
    """Source in a code fence; Python that is too long in several, cut at its definitions."""
    room = o.most - 20
    parts = chunking.python_segments(source, max(o.most - 200, 500), o.least) if language == "python" and len(source) > room else [source]
    return PIECE.join(f"```{language}\n{x}\n```" for x in parts)


def _joined(x: Any) -> str:
    return "".join(x) if isinstance(x, list) else x or ""


def _colourless(lines: list[str] | None) -> str:
    return re.sub(r"\x1b\[[\d;]*m", "", "\n".join(lines or []))


#: What each type of a cell's output says.
_SAYS: dict[str, Callable[[dict[str, Any]], str]] = {
    "stream": lambda out: _joined(out.get("text")),
    "execute_result": lambda out: _joined((out.get("data") or {}).get("text/plain")),
    "display_data": lambda out: _joined((out.get("data") or {}).get("text/plain")),
    "error": lambda out: _colourless(out.get("traceback")),
}


def cell_output(cell: dict[str, Any], o: Options) -> str:
    """What a code cell printed, returned or raised, without colours and cut to a length."""
    outputs = cell.get("outputs") or [] if o.outputs else []
    said = "\n".join(filter(str.strip, (_SAYS.get(out.get("output_type"), lambda _: "")(out) for out in outputs)))
    rest = "\n... [output truncated]" if len(said) > o.output_most else ""
    return f"\n_Output:_\n```\n{said[: o.output_most]}{rest}\n```\n" if said else ""


Rendered = tuple[str, str, str, bool]


def _notebook(content: str, suffix: str, o: Options) -> Rendered:
    book = json.loads(content)
    meta = book.get("metadata") or {}
    named = [(meta.get(k) or {}).get(n) for k, n in (("kernelspec", "language"), ("language_info", "name"))]
    language = next(filter(None, named), "python")
    shown = "python" if language.startswith("python") else language

    def cell_parts(kind: str, text: str, cell: dict[str, Any]) -> list[str]:
        if kind == "code":
            return [fence(text, shown, o), cell_output(cell, o)]
        # Too short a text says nothing of its script.
        return [PLACEHOLDER if len(text.strip()) >= 12 and skipped(text, o) else text]

    cells = [(c.get("cell_type"), _joined(c.get("source")).rstrip(), c) for c in book.get("cells") or []]
    cells = [c for c in cells if c[0] in ("code", "markdown", "raw") and c[1].strip()]
    code = any(kind == "code" for kind, *_ in cells)
    text = "\n\n".join(p for c in cells for p in cell_parts(*c) if p.strip())
    # Without code, and with next to nothing besides what was left out, a notebook is not worth a chunk.
    empty = not code and PLACEHOLDER in text and len(re.sub(r"[#>*`\-_=\s]+", "", text.replace(PLACEHOLDER, ""))) < 50
    return "" if empty else text, "ipynb", language, code


def _rmarkdown(content: str, suffix: str, o: Options) -> Rendered:
    text = re.sub(r"```\{r[^}]*\}", "```r", content.rstrip())
    return text, "rmd", "r", "```r" in text


def _python(content: str, suffix: str, o: Options) -> Rendered:
    cells = map(str.strip, re.split(r"(?m)^\s*#\s*%%.*$", content)) if re.search(r"(?m)^\s*#\s*%%", content) else [content.rstrip()]
    return "\n\n".join(fence(c, "python", o) for c in cells if c), "py", "python", bool(content.strip())


def _r(content: str, suffix: str, o: Options) -> Rendered:
    return fence(content.rstrip(), "r", o) if content.strip() else "", "r", "r", bool(content.strip())


def _code(content: str, suffix: str, o: Options) -> Rendered:
    language = LANGUAGES[suffix]
    segments = chunking.code_segments(content.rstrip(), max(o.most - 200, 500), o.least, language == "sql")
    return PIECE.join(f"```{language}\n{s}\n```" for s in segments), "code", language, bool(content.strip())


_READERS: dict[str, Callable[[str, str, Options], Rendered]] = {".ipynb": _notebook, ".rmd": _rmarkdown, ".py": _python, ".r": _r} | dict.fromkeys(LANGUAGES, _code)


def render(path: str, content: str, o: Options) -> Rendered:
    """A notebook or source file as (markdown, file_type, language, has_code)."""
    suffix = PurePosixPath(path).suffix.lower()
    return _READERS[suffix](content, suffix, o)


def parse_rendered(path: str, content: str, o: Options) -> Iterator[tuple[dict[str, Any], None]]:
    """Chunks of a notebook or source file; a piece that is whole by construction is divided only if too long."""
    markdown, kind, language, code = render(path, content, o)
    name = PurePosixPath(path.replace("\\", "/")).name
    course = next((c for c in map(o.course_of, re.split(r"[/\\]", path)) if c and c != SKIP), "unknown")
    top = header([name], course, "")
    parts = [x for piece in markdown.split(PIECE) for x in chunking.split(piece.strip(), o.most, o.overlap, o.strategy) if piece.strip()]
    for i, p in enumerate(parts, 1):
        if len(p.strip()) >= o.least:
            text = top + p
            yield {"doc_id": digest(f"{path}::{text[:500]}"), "text": text, "source_file": path, "file_type": kind, "heading": name, "heading_path": name, "chunk_part": f"{i}/{len(parts)}" if len(parts) > 1 else None, "course": course, "domain": o.domain or o.course_domains.get(course, "general"), "tags": list(o.tags), "language": language, "has_code": code}, None


def parser_for(path: str) -> Callable[[str, str, Options], Iterator[tuple[dict[str, Any], Any]]] | None:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".md":
        return parse_note
    return parse_rendered if suffix in _READERS else None


def _rows(schema: str, options: Options, want_parents: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict[str, Any]] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parse = parser_for(path)
                if parse is None:
                    continue
                text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
                try:
                    made = list(parse(path, text, options))
                except Exception as e:  # one bad file must not end the job
                    made = [] if want_parents else [({"source_file": path, "error": f"{type(e).__name__}: {e}"}, None)]
                rows += [parent for _, parent in made if parent] if want_parents else [chunk for chunk, _ in made]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})

    return run


def parse_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, content) to chunk rows, in ``CHUNK_SCHEMA``."""
    return files.select("path", "content").mapInPandas(_rows(CHUNK_SCHEMA, options or Options(), False), CHUNK_SCHEMA)


def parse_parents(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, content) to the parents that chunks refer to, each once."""
    return files.select("path", "content").mapInPandas(_rows(PARENT_SCHEMA, options or Options(), True), PARENT_SCHEMA).dropDuplicates(["parent_id"])
