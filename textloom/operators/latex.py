"""Structure of LaTeX sources: headings, equations, figures and tables with their places, and what surrounds them.

Places are found within a row, without a shuffle, by small functions over Arrow
batches that read a text once for each pattern; their work grows with the text,
however many spans it has. All that follows is expressions and joins.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .parallel import sliced

# Patterns of headings, environments, display equations and inline ones, and the custom class's name.
HEADING = r"\\{level}(?:\[([^\]]+)\])?\{{([^}}]+)\}}"
FIGURE_KINDS = ("figure", "table")
DISPLAY = {
    "dollars": r"\$\$[^$]+\$\$",
    "equation": r"(?s)\\begin\{equation\}.*?\\end\{equation\}",
    "align": r"(?s)\\begin\{align\}.*?\\end\{align\}",
    "eqnarray": r"(?s)\\begin\{eqnarray\}.*?\\end\{eqnarray\}",
    "gather": r"(?s)\\begin\{gather\}.*?\\end\{gather\}",
    "bracket": r"(?s)\\\[.*?\\\]",
}
INLINE = r"\$[^$]+\$"
SOURCE_EQUATIONS = (r"\\begin\{equation\}", r"\\begin\{align\}", r"\\begin\{eqnarray\}", r"\\begin\{gather\}", r"\\\[")
PARSED_EQUATIONS = (r"\$\$[^$]+\$\$", r"\\begin\{equation\}", r"\\begin\{align\}")
CUSTOM_CLASS = "AeroStructure"
LABEL = r"\\label\{([^}]+)\}"
SPAN = "array<struct<kind:string,start:int,stop:int,line:int,found:string,before:string,after:string>>"
#: Characters that are handed on from either side of a span.
AROUND = 100
#: What ends a sentence, and white space as a pattern's `\\s` has it.
SENTENCE_END = re.compile(r"[.!?]+\s+", re.ASCII)
BLANKS = " \t\n\x0b\f\r"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _found(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern in patterns.items() for m in pattern.finditer(text)]


def compiled(patterns: dict[str, str]) -> dict[str, re.Pattern]:
    return {kind: re.compile(p, re.ASCII) for kind, p in patterns.items()}


def span_rows(text: str, patterns: dict[str, re.Pattern]):
    """(kind, start, stop, line, found, before, after) of all matches."""
    found = _found(text, patterns)
    breaks = [m.start() for m in re.finditer("\n", text)] if found else []
    for kind, a, b in found:
        yield kind, a, b, bisect_left(breaks, a) + 1, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]


def _per_text(texts: pa.Array, rows_of, names: list[str], types: list[pa.DataType]) -> pa.Array:
    """A list of structs for each text, from rows as tuples; null for a null text. Texts are taken one at a time."""
    columns: list[list] = [[] for _ in names]
    ends = [0]
    for text in texts:
        for row in rows_of(text.as_py()) if text.is_valid else ():
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        ends.append(len(columns[0]))
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(texts.is_null()))


def all_spans(text: Column, patterns: dict[str, str]) -> Column:
    """All matches of some patterns: kind, place from `start` (0-based, in characters) up to `stop`, `line` (from 1), what was found, and the AROUND characters before and after it.

    One pass over the text for each pattern, and one over its line ends.
    """
    ready = compiled(patterns)
    names = ["kind", "start", "stop", "line", "found", "before", "after"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return F.arrow_udf(sliced(lambda texts: _per_text(texts, lambda t: span_rows(t, ready), names, types)), SPAN)(text)


def front_matter(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, title, author, document_class, file_size_bytes, line_count, has_custom_class; what isn't there is empty."""
    t = F.col(text)

    def command(pattern: str) -> Column:
        return _strip(F.regexp_extract(t, pattern, 1))

    kind = command(r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}")
    lines = F.when(t == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(t, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r", -1)))
    return docs.select(
        key, command(r"\\title\{([^}]+)\}").alias("title"), command(r"\\author\{([^}]+)\}").alias("author"), kind.alias("document_class"),
        F.octet_length(t).cast("long").alias("file_size_bytes"), lines.cast("long").alias("line_count"), F.contains(kind, F.lit(CUSTOM_CLASS)).alias("has_custom_class"),
    )


def sections(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, level, title, short_title, label (in the hundred characters after the heading), line."""
    patterns = {level: HEADING.format(level=level) for level in T.HEADINGS}
    rows = docs.select(key, F.explode(all_spans(F.col(text), patterns)).alias("s"))
    one = HEADING.format(level="[a-z]+")
    return rows.select(key, F.col("s.kind").alias("level"), _strip(F.regexp_extract("s.found", one, 2)).alias("title"), _first(F.col("s.found"), one).alias("short_title"), _first(F.col("s.after"), LABEL).alias("label"), F.col("s.line").cast("long").alias("line"))


def equations(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, kind, content, label, line, start, stop, context_before, context_after of all eight kinds.

    `$$x$$` is found as a display and as an inline equation; callers that want
    one of them filter by kind.
    """
    rows = docs.select(key, F.explode(all_spans(F.col(text), T.EQUATION_KINDS)).alias("s"))
    inside = F.coalesce(*(F.when(F.col("s.kind") == kind, F.regexp_extract("s.found", pattern, 1)) for kind, pattern in T.EQUATION_KINDS.items()))
    before, after = _strip(F.col("s.before")), _strip(F.col("s.after"))
    return rows.select(
        key, F.col("s.kind").alias("kind"), _strip(inside).alias("content"), _first(inside, LABEL).alias("label"), F.col("s.line").cast("long").alias("line"), F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"),
        F.when(F.char_length(before) > 50, F.substring(before, -50, 50)).otherwise(before).alias("context_before"), F.substring(after, 1, 50).alias("context_after"),
    )


def figures(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, kind (figure or table), caption (empty without one), label, content, line."""
    patterns = {kind: rf"(?s)\\begin\{{{kind}\}}(.+?)\\end\{{{kind}\}}" for kind in FIGURE_KINDS}
    rows = docs.select(key, F.explode(all_spans(F.col(text), patterns)).alias("s"))
    body = F.regexp_extract("s.found", r"(?s)^\\begin\{[a-z]+\}(.+)\\end\{[a-z]+\}$", 1)
    return rows.select(key, F.col("s.kind").alias("kind"), _strip(F.regexp_extract(body, r"\\caption\{([^}]+)\}", 1)).alias("caption"), _first(body, LABEL).alias("label"), _strip(body).alias("content"), F.col("s.line").cast("long").alias("line"))


def boundaries(text: Column) -> Column:
    """Spans of display equations, and of inline ones that don't begin within one of those, in order of their start.

    In that order an inline one begins within a display equation if the
    furthest end of those before it lies behind its start.
    """
    display, inline = compiled(DISPLAY), compiled({"inline": INLINE})

    def rows(text: str):
        spans = sorted([(a, 0, b) for _, a, b in _found(text, display)] + [(a, 1, b) for _, a, b in _found(text, inline)])
        kept, furthest = [], -1
        for a, within, b in spans:
            if not within:
                furthest = max(furthest, b)
            elif a < furthest:
                continue
            kept.append((a, b, "inline" if within else "display"))
        return [(kind, a, b, text[a:b]) for a, b, kind in sorted(kept)]

    names, types = ["kind", "start", "stop", "found"], [pa.string(), pa.int32(), pa.int32(), pa.string()]
    return F.arrow_udf(lambda texts: _per_text(texts, rows, names, types), "array<struct<kind:string,start:int,stop:int,found:string>>")(text)


def equation_contexts(text: Column, sentences: int = 2) -> Column:
    """Each display equation (start, stop) with the last sentences before it and the first after it, as `context`."""
    display = compiled(DISPLAY)

    def rows(text: str):
        spans = sorted((a, b) for _, a, b in _found(text, display))
        stops = [m.span() for m in SENTENCE_END.finditer(text)] if spans else []
        starts, ends = [s[0] for s in stops], [s[1] for s in stops]
        for a, b in spans:
            i, k = bisect_right(ends, a), bisect_left(starts, b)  # sentence ends before it, and the first after it
            before = [text[ends[j - 1] if j else 0 : starts[j]] for j in range(max(0, i - sentences + 1), i)] + [text[ends[i - 1] if i else 0 : a]]
            after = [text[ends[j - 1] if j > k else b : starts[j] if j < len(starts) else len(text)] for j in range(k, min(k + sentences, len(starts) + 1))]
            yield a, b, " ".join([*before, text[a:b], *after]).strip(BLANKS)

    names, types = ["start", "stop", "context"], [pa.int32(), pa.int32(), pa.string()]
    return F.arrow_udf(lambda texts: _per_text(texts, rows, names, types), "array<struct<start:int,stop:int,context:string>>")(text)


def split_equations(text: Column) -> Column:
    """How many display equations of a chunk have an odd number of `$$`; a chunk without any is valid."""
    return F.size(F.filter(boundaries(text), lambda s: (s["kind"] == "display") & (T.occurrences(s["found"], "$$") % 2 != 0))).cast("long")


def within(points: DataFrame, ranges: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Range join: each row of `points` (key, at) with the rows of `ranges` (key, start, stop) of the same key that hold it.

    Both sides meet by equal (key, at / width); a range is copied to the cells
    it covers. So long documents are spread over tasks, and no pair is made
    that isn't in one cell.
    """
    cells = ranges.where("stop > start").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col("at") / width)).join(cells, [key, "_cell"]).where("start <= at AND at < stop").drop("_cell")


# --- validation of parsers ------------------------------------------------------------


def validated(parsed: DataFrame, key: str = "id", source: str = "source", markdown: str = "markdown", captions: str | None = None, headings: str | None = None, least: float = 0.95) -> DataFrame:
    """Whether a parser's markdown keeps the source's equations, and what is wrong.

    Gives key, original, kept, preservation, syntax_valid, figures_ok,
    sections_ok, passed, issues and warnings. `captions` and `headings` name
    array columns; an empty or null element makes that check fail with a
    warning only. A null markdown is a parser that failed.
    """

    def count(text: str, patterns: tuple[str, ...]) -> Column:
        return sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0]))).cast("long")

    def whole(column: str | None) -> Column:
        return F.lit(True) if column is None else F.coalesce(F.forall(column, lambda x: x.isNotNull() & (x != "")), F.lit(True))

    balanced = F.forall(T.matches(F.col(markdown), r"\$\$([^$]+)\$\$", 1), lambda e: (T.occurrences(e, "{") == T.occurrences(e, "}")) & (T.occurrences(e, "[") == T.occurrences(e, "]")))
    out = parsed.withColumns({"original": count(source, SOURCE_EQUATIONS), "kept": F.coalesce(count(markdown, PARSED_EQUATIONS), F.lit(0).cast("long"))})
    rate = F.when(F.col(markdown).isNull(), 0.0).when(F.col("original") > 0, F.col("kept") / F.col("original")).otherwise(1.0)
    out = out.withColumns({"preservation": rate, "syntax_valid": F.coalesce(balanced, F.lit(False)), "figures_ok": whole(captions), "sections_ok": whole(headings)})
    low = F.format_string(f"Equation preservation rate %.1f%% below target {least:.1%}".replace("%%", "%%").replace(f"{least:.1%}", f"{least * 100:.1f}%%"), F.col("preservation") * 100)
    failed = F.when(F.col(markdown).isNull(), "Parser failed")
    issues = F.array_compact(F.array(failed, F.when(failed.isNull() & (F.col("preservation") < least), low), F.when(failed.isNull() & ~F.col("syntax_valid"), "Invalid LaTeX syntax detected in equations")))
    warnings = F.array_compact(F.array(F.when(~F.col("figures_ok"), "Figure-caption associations incomplete"), F.when(~F.col("sections_ok"), "Section hierarchy incomplete")))
    return out.withColumns({"issues": issues, "warnings": warnings, "passed": F.size(issues) == 0}).select(key, "original", "kept", "preservation", "syntax_valid", "figures_ok", "sections_ok", "passed", "issues", "warnings")


def validation_report(results: DataFrame) -> DataFrame:
    """One row over `validated` rows: total_files, passed, failed, pass_rate, avg_preservation."""
    n = F.count("*")
    passed = F.count_if("passed")
    return results.agg(n.alias("total_files"), passed.alias("passed"), (n - passed).alias("failed"), F.round(F.coalesce(F.try_divide(passed, n), F.lit(0.0)), 6).alias("pass_rate"), F.round(F.avg("preservation"), 6).alias("avg_preservation"))


# --- metadata of whole projects -------------------------------------------------------


def with_projects(chunks: DataFrame, files: DataFrame, projects: DataFrame, chapters: DataFrame, references: DataFrame) -> DataFrame:
    """Chunks (dir, file, ...) with the facts of the project they belong to.

    Of a folder that isn't a project only `is_project` = false is known. The
    other sides have a row per file or folder: counts and chapters are joined
    by equal keys, not gathered.
    """
    named = projects.where("is_project").select("dir", "is_project", F.element_at(F.split("dir", "/"), -1).alias("project_name"), F.col("has_class").alias("has_custom_class"))
    classes = files.where(F.endswith("file", F.lit(".cls"))).groupBy("dir").agg(F.min("file").alias("document_class"))
    total = chapters.where("number IS NOT NULL AND NOT is_appendix").groupBy("dir").agg(F.count("*").alias("total_chapters"))
    refs = references.groupBy("dir", F.col("src").alias("file")).agg(F.array_sort(F.collect_list("dst")).alias("references_chapters"))
    crossed = references.select("dir", F.lit(True).alias("has_cross_refs")).distinct()
    about = chapters.select("dir", "file", F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), "is_appendix")
    out = chunks.join(named, "dir", "left").join(classes, "dir", "left").join(total, "dir", "left").join(crossed, "dir", "left").join(refs, ["dir", "file"], "left").join(about, ["dir", "file"], "left")
    known = F.coalesce("is_project", F.lit(False))
    facts = {
        "project_name": F.col("project_name"), "chapter_number": F.col("chapter_number"), "chapter_title": F.col("chapter_title"), "is_appendix": F.coalesce("is_appendix", F.lit(False)), "has_custom_class": F.col("has_custom_class"),
        "document_class": F.col("document_class"), "has_cross_refs": F.coalesce("has_cross_refs", F.lit(False)), "references_chapters": F.coalesce("references_chapters", F.array().cast("array<string>")),
        "book_context": F.lit(True), "total_chapters": F.coalesce("total_chapters", F.lit(0)).cast("long"),
    }
    return out.select(*chunks.columns, known.alias("is_project"), *(F.when(known, v).alias(k) for k, v in facts.items()))
