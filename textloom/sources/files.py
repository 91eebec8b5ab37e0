"""Sources of text files: discovery by format, encodings, parsers and golden sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name patterns of each kind of file.
FORMATS = {
    "latex": "*.tex",
    "markdown": "*.{md,markdown,txt}",
    "documents": "*.{pdf,tex}",
    "office": "*.{pdf,docx,pptx,xlsx}",
    "web": "*.{html,htm}",
    "audio": "*.{mp3,wav,m4a,flac}",
}

GOLDEN = """test_cases array<struct<id string, category string, difficulty string, question string, expected_chunks array<string>,
    expected_equations array<string>, expected_figures array<string>, answer_keywords array<string>, ground_truth string, notes string>>"""

#: Parsers by name: functions of (content column) -> text column. PDF and audio models aren't available here; register one to use it.
PARSERS: dict[str, Callable[[Column], Column]] = {}


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they aren't valid UTF-8."""
    as_utf8 = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(content.cast("string")), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str, kind: str, recursive: bool = True) -> DataFrame:
    """path, name, size, modified, text of each file of a kind; unknown kinds are an error."""
    if kind not in FORMATS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(FORMATS)}")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", FORMATS[kind]).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def parse(files: DataFrame, name: str, text: str = "text", out: str = "content") -> DataFrame:
    """Apply a registered parser; a name that isn't registered is an error."""
    if name not in PARSERS:
        raise ValueError(f"no parser named {name!r}")
    return files.withColumn(out, PARSERS[name](F.col(text)))


def passages(docs: DataFrame, key: str, text: str = "text", least: int = 100) -> DataFrame:
    """key, position, passage: parts between blank lines with more than `least` characters."""
    rows = docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("position", "passage")).withColumn("passage", F.regexp_replace("passage", r"^\s+|\s+$", ""))
    return rows.where(F.char_length("passage") > least)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of JSON files with a `test_cases` array, a row each."""
    return spark.read.schema(GOLDEN).option("multiLine", "true").json(path).select(F.inline("test_cases"))


def discovered(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """path, name, kind, size of files of several kinds, without reading them."""
    out = None
    for kind in kinds:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", FORMATS[kind]).option("recursiveFileLookup", "true").load(path)
        part = rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.lit(kind).alias("kind"), F.col("length").alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


def whole(found: DataFrame) -> DataFrame:
    """path, name, kind, size, parts of `discovered` files; those that one write of Spark left in a folder as parts of its output are one file, named by that write."""
    path = F.regexp_replace("path", r"/part-\d+-([0-9a-f-]{36})[^/]*?((?:\.[A-Za-z]\w*)?)$", "/$1$2")
    return found.groupBy(path.alias("path"), F.substring_index(path, "/", -1).alias("name"), "kind").agg(F.sum("size").alias("size"), F.count("*").alias("parts"))


def metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add frontmatter (a map of its `key: value` lines, null without a block), line_count, word_count and file_size."""
    t = F.col(text)
    block = F.nullif(F.regexp_extract(t, r"(?s)^---\n(.*?)\n---\n", 1), F.lit(""))
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.split(x, r":\s*", 2)), lambda x: F.size(x) == 2)
    front = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(x[0]), F.regexp_replace(F.trim(x[1]), "^[\"']|[\"']$", ""))))
    return docs.withColumns({"frontmatter": front, "line_count": F.size(F.split(t, "\n", -1)), "word_count": F.size(F.array_remove(F.split(t, r"\s+"), "")), "file_size": F.octet_length(t)})


def export(docs: DataFrame, path: str, form: str, title: str = "title", text: str = "text") -> None:
    """Documents as files of lines below `path`: `json`, `markdown` or `html`, a line for each; other forms are an error."""
    if form == "json":
        docs.write.mode("overwrite").json(path)
        return
    escaped = F.col(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    forms = {"markdown": F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(text), F.lit("\n")), "html": F.concat(F.lit("<article><h1>"), F.col(title), F.lit("</h1><p>"), F.replace(escaped, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article>"))}
    if form not in forms:
        raise ValueError(f"unknown form {form!r}; known: {sorted([*forms, 'json'])}")
    docs.select(forms[form].alias("value")).write.mode("overwrite").text(path)


def write_report(summary: DataFrame, path: str, title: str) -> None:
    """A summary, a row for each thing summed up, as JSON rows and as tables in markdown and HTML, side by side below `path`."""
    names = summary.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    summary.write.mode("overwrite").json(f"{path}/json")
    forms = {
        "markdown": (f"# {title}\n\n| {' | '.join(names)} |\n|{'---|' * len(names)}", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), None),
        "html": (f"<h1>{title}</h1><table><tr><th>{'</th><th>'.join(names)}</th></tr>", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")), "</table>"),
    }
    for form, (head, line, tail) in forms.items():
        ends = summary.sparkSession.createDataFrame([(0, head)] + ([(2, tail)] if tail else []), "_o int, value string")
        ends.unionByName(summary.select(F.lit(1).alias("_o"), line.alias("value"))).orderBy("_o", "value").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/{form}")
