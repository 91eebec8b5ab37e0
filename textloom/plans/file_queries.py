"""Queries that write files from the tables, read them back with the file sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import models as N
from ..operators import relational as R
from ..sources import files as L
from ..sources import office as O
from ..sources import stored as S
from ..streaming import jobs as J
from .common import table
from .ops_queries import CASES, CHUNKS_SQL
from .search_queries import _asked
from .text_queries import TOKENS_SQL, _broken

_docs = lambda s, d: table(s, d, "documents")


def _folder(s, d):
    """A text file in parts for each language, a line for each line of its documents; each task writes its own part, no document is moved."""
    path = S.new_path(s, "texts")
    _docs(s, d).select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    return path


def _files(s, d):
    """Text files of each language of at most a thousand documents, since a file is read whole; no document is moved to write them."""
    path = S.new_path(s, "texts")
    _docs(s, d).select("lang", F.col("text").alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    return path


def file_discovery(s, d):
    """The files of each language: how many, of what kind and size; parts of one file count as that file."""
    found = L.whole(L.discovered(s, _folder(s, d), ["latex", "markdown", "web"]))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), "kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def file_texts(s, d):
    """The lines of all files, read whole and decoded."""
    rows = L.read_files(s, _files(s, d), "markdown").select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line"))
    return rows.where("line <> ''").groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).cast("long").alias("chars"), F.countDistinct(F.md5("line")).alias("distinct_lines"))


def docx_documents(s, d):
    """Every document as a Word file, every ninth of them damaged, and what is read of it."""
    made = _docs(s, d).select("doc_id", O.as_docx(F.col("text")).alias("c"))
    made = made.withColumn("c", F.when(F.col("doc_id") % 9 == 4, F.substring("c", 1, 40)).otherwise(F.col("c")))
    read = made.select("doc_id", O.parsed(F.col("c"), "docx").alias("p"))
    return read.select("doc_id", F.md5("p.text").alias("digest"), F.col("p.error").isNotNull().alias("failed"))


def golden_scan(s, d):
    """Cases written as a JSON file and read with the schema of golden sets."""
    path = S.new_path(s, "golden")
    CASES.df(s, d).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "category", "question", "ground_truth")).alias("test_cases"))).alias("value")).write.text(path)
    return L.golden_cases(s, path).groupBy("category").agg(F.count("*").alias("n"), F.count("ground_truth").alias("with_truth"), F.sum(F.char_length("question")).cast("long").alias("chars"))


def exported_documents(s, d):
    """Documents as lines of JSON and of HTML, counted from the files."""
    path = S.new_path(s, "export")
    docs = _docs(s, d).select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    out = None
    for form in ("json", "html", "markdown"):
        L.export(docs, f"{path}/{form}", form)
        lines = s.read.text(f"{path}/{form}").where("value <> ''")
        part = lines.agg(F.lit(form).alias("form"), F.count("*").alias("lines"), F.sum(F.when(F.lit(form) == "json", 0).otherwise(F.char_length("value"))).cast("long").alias("chars"))
        out = part if out is None else out.unionByName(part)
    return out


def report_files(s, d):
    """A summary by language as a report, its rows read back from JSON and its lines from markdown."""
    path = S.new_path(s, "report")
    L.write_report(_docs(s, d).groupBy("lang").agg(F.count("*").alias("n")), path, "Languages")
    rows = s.read.schema("lang string, n long").json(f"{path}/json")
    lines = s.read.text(f"{path}/markdown").where("value LIKE '| %'").agg((F.count("*") - 1).alias("listed"))
    return rows.join(F.broadcast(lines))


def document_passages(s, d):
    """Passages of more than a hundred characters; every second line end is a blank line."""
    docs = _docs(s, d).select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return L.passages(docs, "doc_id").select("doc_id", F.col("position").cast("long").alias("position"), F.md5("passage").alias("digest"))


def formula_enrichment(s, d):
    """What a recogniser read of each formula, repaired where that helps, else the original."""
    rows = _broken(s, d).select("id", F.when(F.col("id") % 11 != 0, F.col("latex")).alias("read"), F.lit("x + y").alias("original"))
    return D.enriched_formulas(rows, "id", "read", "original").groupBy("status").agg(F.count("*").alias("n"))


def filtered_chunks(s, d):
    """The filter builder: chunks of type, page range and equations, a thousand at most by a checked limit."""
    chunks = C.fixed_windows(_docs(s, d)).select("doc_id", "chunk_index", F.concat(F.lit("chapter_"), (F.col("doc_id") % 7).cast("string")).alias("document_id"), F.contains("content", F.lit("$")).alias("has_equations"), (F.col("chunk_index") % 9).alias("page_number"))
    wanted = R.filters(document_id="chapter_3", has_equations=False, pages=(2, 5), columns=chunks.columns)
    return chunks.where(wanted).orderBy("doc_id", "chunk_index").limit(R.checked_limit(5000, most=1000)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


def truncated_embeddings(s, d):
    """Vectors cut to sixteen dimensions and of unit length again; an empty text has zeros."""
    docs = _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text"))
    out = N.embed(docs, "text", dims=16)
    return out.select("doc_id", F.size("vector").cast("long").alias("dims"), F.round(V.norm(F.col("vector")), 3).alias("norm"))


def generated_answers(s, d):
    """A generator that refuses every third prompt, and one that takes these."""
    first, second = (lambda x: [None if len(p) % 3 == 0 else f"A{len(p)}" for p in x]), (lambda x: [f"B{len(p)}" for p in x])
    return N.generate(_asked(s, d).withColumnRenamed("query", "prompt"), {"first": first, "second": second}).select("query_id", "answer", "provider", "success")


def stream_once(s, d):
    """Events that are sent twice pass a stream once."""
    path = S.new_path(s, "twice")
    events = table(s, d, "events")
    events.unionByName(events.where("event_id % 3 = 0")).write.parquet(f"{path}/in")
    J.finish(J.once(s.readStream.schema(events.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/checkpoint")
    return s.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def token_counts_exported(s, d):
    """Statistics of tokens over chunks, as text of a report."""
    chunks = C.fixed_windows(_docs(s, d)).select("doc_id", F.size(T.tokens(F.col("content"))).alias("n"))
    return chunks.agg(F.count("*").alias("chunks"), F.sum("n").cast("long").alias("tokens"), F.max("n").cast("long").alias("most"), F.min("n").cast("long").alias("fewest"))


QUERIES = {f.__name__: f for f in (file_discovery, file_texts, docx_documents, golden_scan, exported_documents, report_files, document_passages, formula_enrichment, filtered_chunks, truncated_embeddings, generated_answers, stream_once, token_counts_exported)}

_XML = r"[^\t\n\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
ORACLES = {
    "file_discovery": "SELECT lang, 'markdown' AS kind, 1::BIGINT AS files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang",
    "file_texts": "WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(DISTINCT line) AS distinct_lines FROM l WHERE line <> '' GROUP BY lang",
    "docx_documents": f"SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN md5(regexp_replace(text, '{_XML}', '', 'g')) END AS digest, doc_id % 9 = 4 AS failed FROM documents",
    "golden_scan": f"SELECT category, count(*) AS n, count(ground_truth) AS with_truth, CAST(sum(length(question)) AS BIGINT) AS chars FROM {CASES.sql()} GROUP BY category",
    "exported_documents": """
        WITH d AS (SELECT 'D' || doc_id AS title, replace(text, chr(10), ' ') AS text, replace(replace(replace(replace(text, chr(10), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents)
        SELECT 'json' AS form, count(*) AS lines, 0::BIGINT AS chars FROM d UNION ALL SELECT 'html', count(*), CAST(sum(length(title) + length(safe) + 35) AS BIGINT) FROM d
        UNION ALL SELECT 'markdown', 2 * count(*), CAST(sum(length(title) + length(text) + 2) AS BIGINT) FROM d""",
    "report_files": "SELECT lang, count(*) AS n, (SELECT count(DISTINCT lang) FROM documents) AS listed FROM documents GROUP BY lang",
    "document_passages": r"""
        WITH p AS (SELECT doc_id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n') AS p FROM documents),
        e AS (SELECT doc_id, i AS position, regexp_replace(p[i + 1], '^\s+|\s+$', '', 'g') AS passage FROM (SELECT *, unnest(range(0, len(p))) AS i FROM p))
        SELECT doc_id, position, md5(passage) AS digest FROM e WHERE length(passage) > 100""",
    "filtered_chunks": f"SELECT doc_id, chunk_index FROM {CHUNKS_SQL} WHERE doc_id % 7 = 3 AND NOT contains(content, '$') AND chunk_index % 9 BETWEEN 2 AND 5 ORDER BY doc_id, chunk_index LIMIT 1000",
    "generated_answers": "SELECT item_id AS query_id, CASE WHEN length(text) % 3 = 0 THEN 'B' ELSE 'A' END || length(text) AS answer, CASE WHEN length(text) % 3 = 0 THEN 'second' ELSE 'first' END AS provider, true AS success FROM benchmark",
    "stream_once": "SELECT event_type, count(*) AS n, count(*) AS ids FROM events GROUP BY event_type",
    "token_counts_exported": f"WITH c AS (SELECT len({TOKENS_SQL.replace('text', 'content')}) AS n FROM {CHUNKS_SQL}) SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS most, min(n) AS fewest FROM c",
}
