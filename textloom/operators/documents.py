"""Document-level operators: parsing, enrichment, repair, entities, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .parallel import spread

# The entity dictionaries and patterns.
COMPANIES = (
    "Google", "Microsoft", "Apple", "Amazon", "Meta", "Facebook", "Tesla", "OpenAI", "Anthropic", "Nvidia", "Intel", "AMD", "IBM", "Oracle", "Salesforce", "Adobe", "Netflix", "Uber",
    "Airbnb", "Spotify", "Twitter", "LinkedIn", "Snapchat", "TikTok", "ByteDance", "Baidu", "Alibaba", "Tencent", "Samsung", "Sony", "Huawei", "Xiaomi", "DeepMind",
)
TECHNOLOGIES = (
    "AI", "artificial intelligence", "machine learning", "ML", "deep learning", "neural network", "LLM", "large language model", "GPT", "transformer", "NLP", "natural language processing",
    "computer vision", "reinforcement learning", "generative AI", "foundation model", "multimodal", "chatbot", "API", "cloud computing", "edge computing", "quantum computing",
    "blockchain", "cryptocurrency", "IoT", "5G", "AR", "VR", "autonomous vehicles", "robotics", "automation",
)
PEOPLE = (
    "Elon Musk", "Jeff Bezos", "Tim Cook", "Satya Nadella", "Sundar Pichai", "Mark Zuckerberg", "Sam Altman", "Dario Amodei", "Daniela Amodei", "Jensen Huang",
    "Bill Gates", "Larry Page", "Sergey Brin", "Jack Dorsey", "Reed Hastings", "Marc Benioff", "Andy Jassy",
)
LOCATIONS = (
    "Silicon Valley", "San Francisco", "Seattle", "Austin", "New York", "Boston", "London", "Tel Aviv", "Singapore", "Beijing", "Shanghai", "Tokyo", "Seoul", "Bangalore",
    "Mountain View", "Cupertino", "Redmond", "Menlo Park",
)
COMPANY_PATTERNS = (r"(?i)\b(?:Google|Microsoft|Apple|Amazon|Meta|Facebook|Tesla|OpenAI)\b", r"(?i)\b\w+\s+(?:Inc|Corp|Corporation|Ltd|Limited|AG|SE)\b")
TECHNOLOGY_PATTERNS = (
    r"(?i)\b(?:AI|artificial intelligence|machine learning|ML|deep learning)\b",
    r"(?i)\b(?:neural network|transformer|GPT|LLM|NLP)\b",
    r"(?i)\b(?:cloud computing|API|blockchain|IoT|5G)\b",
)


def enrich(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Add equation count and flag, figure references, keywords, type, first LaTeX source and word count."""
    t = F.col(text)
    out = spread(chunks).withColumns({"equation_count": T.detected_equations(t), "figure_references": T.figure_references(t), "keywords": T.keywords(t)})
    return out.withColumns({
        "has_equations": F.col("equation_count") > 0,
        "chunk_type": T.chunk_type(F.col("equation_count"), F.col("figure_references")),
        "latex_source": T.first_latex(t),
        "token_count": F.size(F.array_remove(F.split(t, r"\s+"), "")).cast("long"),
    })


def clean_latex(rows: DataFrame, column: str, out: str = "cleaned", rounds: int = 3) -> DataFrame:
    """Repair LaTeX in `rounds` rounds; after one that changes nothing the others don't either."""
    rows, last = rows.withColumn(out, F.col(column)), None
    for i in range(rounds):
        step = T.clean_latex_step(F.col(out))
        step = step if last is None else F.when(F.col(last).eqNullSafe(F.col(out)), F.col(out)).otherwise(step)
        last, before = f"_before_{i}", last
        rows = rows.withColumns({last: F.col(out), out: step})
        rows = rows if before is None else rows.drop(before)
    return rows if last is None else rows.drop(last)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown headings: key, line (from 1), level, title."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "row"))
    head = lines.where(F.rlike("row", F.lit(r"^#{1,6}\s+.+$")))
    return head.select(key, (F.col("at") + 1).cast("long").alias("line"), F.char_length(F.regexp_extract("row", r"^(#{1,6})\s+", 1)).cast("long").alias("level"), F.regexp_extract("row", r"^#{1,6}\s+(.+)$", 1).alias("title"))


def section_of(headings: DataFrame, points: DataFrame, key: str, at: str, levels: int = 6) -> DataFrame:
    """As-of join: each point gets the headings in force at its line, outermost first, as `section_path`.

    A heading ends those of its own and deeper levels. Headings and points are
    one union, ordered by line within a document; no join is needed.
    """
    marks = headings.select(key, F.col("line").alias("_at"), "level", "title", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_point"))
    asks = points.select(key, F.col(at).cast("long").alias("_at"), F.lit(None).cast("long").alias("level"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("_kind"), F.to_json(F.struct(*points.columns)).alias("_point"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = marks.unionByName(asks)
    for n in range(1, levels + 1):  # a heading of level n or less sets level n, to itself or to nothing
        out = out.withColumn(f"_h{n}", F.last(F.when(F.col("level") == n, F.struct("title")).when(F.col("level") < n, F.struct(F.lit(None).cast("string").alias("title"))), True).over(w))
    path = F.filter(F.array(*(F.col(f"_h{n}.title") for n in range(1, levels + 1))), lambda x: x.isNotNull())
    schema = points.schema
    return out.where("_kind = 1").select(F.from_json("_point", schema).alias("p"), path.alias("section_path")).select("p.*", "section_path")


def dictionary_entities(text: Column) -> dict[str, Column]:
    """Entities of the four dictionaries: companies as whole words in any case, technologies anywhere in any case, the others verbatim."""

    def found(names: tuple[str, ...], test) -> Column:
        hits = F.array(*(F.when(test(n), F.lit(n)) for n in sorted(names)))  # names are constants and no lambda is asked, so the text is lowered once
        return F.array_except(hits, F.array(F.lit(None).cast("string")))

    def word(n: str) -> Column:
        return F.contains(low, F.lit(n.lower())) & F.rlike(low, F.lit(rf"\b{n.lower()}\b"))  # few texts have to be matched

    low = F.lower(text)
    return {
        "companies": found(COMPANIES, word),
        "technologies": found(TECHNOLOGIES, lambda n: F.contains(low, F.lit(n.lower()))),
        "people": found(PEOPLE, lambda n: F.contains(text, F.lit(n))),
        "locations": found(LOCATIONS, lambda n: F.contains(text, F.lit(n))),
    }


def pattern_entities(text: Column) -> dict[str, Column]:
    def found(patterns: tuple[str, ...]) -> Column:
        return T.sorted_set(F.concat(*(T.matches(text, "(?U)" + p) for p in patterns)))  # words and their ends in all scripts

    return {"companies": found(COMPANY_PATTERNS), "technologies": found(TECHNOLOGY_PATTERNS)}


def chapters(files: DataFrame) -> DataFrame:
    """Chapter facts of LaTeX files (dir, file, text): number, title, appendix and equation flags."""
    t = F.col("text")
    number = F.nullif(F.regexp_extract("file", r"Ch(\d+)_.*\.tex", 1), F.lit(""))
    marks = T.occurrences(t, "\\begin{equation}") + T.occurrences(t, "$")
    return files.select("dir", "file", number.cast("int").alias("number"), F.nullif(F.regexp_extract("text", r"\\chapter(?:\[[^\]]*\])?\{([^}]+)\}", 1), F.lit("")).alias("title"), F.contains(F.lower("file"), F.lit("app")).alias("is_appendix"), (marks > 10).alias("has_equations"))


def projects(files: DataFrame) -> DataFrame:
    """Folders that are LaTeX projects: three or more `.tex` files and a class file or cross-document commands in the first three."""
    tex = F.endswith("file", F.lit(".tex"))
    order = Window.partitionBy("dir", tex).orderBy("file")
    marked = files.withColumn("_first", tex & (F.row_number().over(order) <= 3)).withColumn("_links", F.rlike("text", F.lit(r"\\myexternaldocument|\\input")))
    out = marked.groupBy("dir").agg(F.count_if(tex).alias("n_tex"), F.bool_or(F.endswith("file", F.lit(".cls"))).alias("has_class"), F.bool_or(F.col("_first") & F.col("_links")).alias("has_links"))
    return out.withColumn("is_project", (F.col("n_tex") >= 3) & (F.col("has_class") | F.col("has_links")))


def cross_references(files: DataFrame) -> DataFrame:
    """Edges (dir, src, dst) from external-document commands."""
    return files.select("dir", F.col("file").alias("src"), F.explode(T.matches(F.col("text"), r"\\myexternaldocument\{([^}]+)\}", 1)).alias("dst"))


def with_parsers(rows: DataFrame, *parsed: str, least: int = 100, out: str = "content") -> DataFrame:
    """The first parser column of good quality (at least `least` characters without outer white space), else null."""
    good = [F.when(F.char_length(F.regexp_replace(c, r"^\s+|\s+$", "")) >= least, F.col(c)) for c in parsed]
    return rows.withColumn(out, F.coalesce(*good))


def enriched_formulas(rows: DataFrame, key: str, recognised: str, original: str) -> DataFrame:
    """key, latex, status: what a recogniser read, repaired if that makes it valid, else the original text.

    status is `recognised`, `repaired`, `fallback` (not valid even so) or
    `failed` (nothing was read).
    """
    out = clean_latex(rows, recognised, "_clean")
    missing = F.col(recognised).isNull() | (F.col(recognised) == "")
    status = F.when(missing, "failed").when(T.latex_error(F.col("_clean")).isNotNull(), "fallback").when(F.col("_clean") == F.col(recognised), "recognised").otherwise("repaired")
    out = out.withColumn("status", status)
    return out.select(key, F.when(F.col("status").isin("recognised", "repaired"), F.col("_clean")).otherwise(F.col(original)).alias("latex"), "status")
