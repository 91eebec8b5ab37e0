"""Queries over LaTeX structure, equations in retrieval, prompts, filters and stores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import citations as G
from ..operators import documents as D
from ..operators import latex as X
from ..operators import lexical as L
from ..operators import prompts as P
from ..operators import relational as R
from ..operators import vectors as O
from .common import literal, rows_df, table, values_sql
from .ops_queries import ANSWERS, META, _CITED, _uses
from .search_queries import _asked, _bm25_sql
from .text_queries import FILES_SQL, LATEX, LATEX_SQL, TOKENS_SQL, _files

#: A LaTeX source made of each document: plain pieces, and SQL that both engines read in brackets.
BOOK = [
    "\\documentclass[11pt]{Aero", ("CASE WHEN doc_id % 3 = 0 THEN 'Structure' ELSE 'Book' END",), "}\n\\title{ Document ", ("CAST(doc_id AS STRING)",), " }\n\\author{", ("source",), "}\n\\begin{document}\n\\chapter[Ch ",
    ("CAST(doc_id % 12 AS STRING)",), "]{Chapter ", ("CAST(doc_id % 12 AS STRING)",), "}\n\\label{ch:", ("CAST(doc_id % 12 AS STRING)",), "}\n", ("text",), "\n\\section{Loads}\nFirst. Second one! Third? See \\ref{eq:",
    ("CAST(doc_id AS STRING)",), "} $x_{", ("CAST(doc_id AS STRING)",), "}$ and $$q = VQ/I$$ here. Fourth.\n\\begin{equation}\n\\label{eq:", ("CAST(doc_id AS STRING)",), "}\nP = \\frac{a}{", ("CAST(doc_id AS STRING)",), "}\n\\end{equation}\n",
    ("CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END",), "\n\\subsection{Shear}\\label{sec:s}\n\\begin{align}\nu &= $v$ \\\\ w\n\\end{align} After it.\n\\begin{figure}\n\\includegraphics{f.png}\n\\caption{Figure of ",
    ("lang",), "}\n\\label{fig:", ("CAST(doc_id AS STRING)",), "}\n\\end{figure}\n\\begin{table}no caption\\end{table}\n\\[ z = 1 \\]\n", ("CASE WHEN doc_id % 5 = 0 THEN '$$ odd { $$' ELSE '' END",), "\\end{document}",
]


def _sql(part) -> str:
    return f"({part[0]})" if isinstance(part, tuple) else literal(part)


BOOK_SQL = "(SELECT doc_id AS id, " + " || ".join(map(_sql, BOOK)) + f" AS text FROM documents UNION ALL SELECT -id, text FROM {LATEX_SQL})"
QUERIES_OF_KINDS = ["technical_qa", "equation_explanation", "procedural_steps", "conceptual", "comparative"]


def _books(s, d):
    made = F.concat(*(F.expr(p[0]) if isinstance(p, tuple) else F.lit(p) for p in BOOK))
    own = rows_df(s, LATEX, "id long, text string").select((-F.col("id")).alias("id"), "text")
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), made.alias("text")).unionByName(own)


def latex_front_matter(s, d):
    return X.front_matter(_books(s, d))


def latex_sections(s, d):
    return X.sections(_books(s, d))


def latex_equations(s, d):
    return X.equations(_books(s, d)).withColumn("content", F.md5("content"))


def latex_figures(s, d):
    return X.figures(_books(s, d))


def equation_boundaries(s, d):
    rows = _books(s, d).select("id", F.explode(X.boundaries(F.col("text"))).alias("s"))
    return rows.select("id", F.col("s.kind").alias("kind"), F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


def equation_contexts(s, d):
    rows = _books(s, d).select("id", F.explode(X.equation_contexts(F.col("text"))).alias("s"))
    return rows.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.context").alias("context"))


def chunk_equation_check(s, d):
    split = X.split_equations(F.col("text"))
    return _books(s, d).select("id", split.alias("violations"), (split == 0).alias("valid"))


def equations_in_chunks(s, d):
    """Range join: each equation with the windows of 400 characters, 300 apart, that hold its start."""
    from ..operators import chunking as C

    books = _books(s, d)
    windows = C.fixed_windows(books, 400, 100, "id", "text").select(F.col("doc_id").alias("id"), "chunk_index", F.col("start_char").alias("start"), F.col("end_char").alias("stop"))
    points = X.equations(books).where("kind = 'equation'").select("id", F.col("start").alias("at"))
    return X.within(points, windows, "id").select("id", "at", F.col("chunk_index").cast("long").alias("chunk_index"))



def parser_validation(s, d):
    checked = X.validated(_books(s, d).select("id", F.col("text").alias("source"), F.when(F.col("id") % 10 == 3, F.replace("text", F.lit("$$"), F.lit(""))).when(F.col("id") % 10 != 7, F.col("text")).alias("markdown")))
    return checked.select("id", "original", "kept", F.round("preservation", 6).alias("preservation"), "syntax_valid", "passed", F.array_join("issues", "|").alias("issues"))


def parser_report(s, d):
    return X.validation_report(X.validated(_books(s, d).select("id", F.col("text").alias("source"), F.when(F.col("id") % 10 == 3, F.replace("text", F.lit("$$"), F.lit(""))).when(F.col("id") % 10 != 7, F.col("text")).alias("markdown"))))


def project_chunks(s, d):
    """Metadata of the whole project for each file's chunk."""
    files = _files(s, d)
    out = X.with_projects(files.where("file LIKE '%.tex'").select("dir", "file"), files, D.projects(files), D.chapters(files), D.cross_references(files))
    return out.withColumn("references_chapters", F.array_join("references_chapters", "|"))


# --- equations in retrieval -----------------------------------------------------------


def _points(s, d):
    return X.equations(_books(s, d)).where("kind IN ('equation', 'align', 'display')").select(F.col("start").alias("place"), "kind", "content", F.col("id").alias("context_chunk_id"))


def retrieve_with_equations(s, d):
    """The five best documents of each passage, each with the equations of the book made from it."""
    hits = L.bm25(_asked(s, d), table(s, d, "documents"), 5).select("query_id", F.col("doc_id").alias("id"), F.col("rank").cast("long").alias("rank"))
    out = R.equations_of(hits, _points(s, d).select("place", "kind", "context_chunk_id"))
    return out.select("query_id", "id", "rank", F.array_join(F.transform("equations", lambda e: F.concat(e["kind"], F.lit("@"), e["place"].cast("string"))), "|").alias("equations"))


def equation_parent(s, d):
    chunks = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return R.parents_of(_points(s, d).select("place", "kind", "context_chunk_id"), chunks)


def equation_text_match(s, d):
    """Equations whose LaTeX has all parts of a query, with the number of each chunk's matches."""
    found = _points(s, d).where(R.contains_all_parts(F.col("content"), "P = \\frac{a}"))
    return found.groupBy("context_chunk_id").agg(F.count("*").alias("n"))


# --- filters --------------------------------------------------------------------------


def dict_filters(s, d):
    return table(s, d, "documents").where(R.dict_filters({"lang": "en", "n_chars": {"gte": 200, "lt": 5000}}, ["lang", "n_chars", "doc_id"])).select("doc_id", "n_chars")


def json_contains(s, d):
    return table(s, d, "events").where(R.contains_json(F.col("props"), {"k": 7})).select("event_id")


def json_contains_nested(s, d):
    """Conversations as JSON of a header and an array of turns: those that contain some turns, typed."""
    c = table(s, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.lit("chat").alias("kind"), F.count("*").alias("n")).alias("head"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))).alias("j"))
    asked = {"first_user": {"turns": [{"turn": 0, "role": "user"}]}, "both_sides": {"turns": [{"role": "assistant", "turn": 3}, {"role": "user"}]}, "five": {"head": {"n": 5.0}}, "text_five": {"head": {"n": "5"}}}
    return turns.select("conv_id", *(R.contains_json(F.col("j"), w).alias(k) for k, w in asked.items()))


def all_terms_match(s, d):
    """The words of each passage as a query: how many documents have all of them."""
    asked = _asked(s, d).select("query_id", T.tokens(F.col("query")).alias("terms"))
    return L.all_terms(asked, table(s, d, "documents")).groupBy("query_id").agg(F.count("*").alias("n"))


def terms_predicate(s, d):
    return table(s, d, "documents").where(R.contains_all_terms(T.tokens(F.col("text")), F.array(F.lit("de"), F.lit("la")))).select("doc_id")


def score_clamp(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(R.clamped(F.get("embedding", F.lit(0)).cast("double") * 5), 6).alias("score"))


# --- prompts --------------------------------------------------------------------------


def prompt_kinds(s, d):
    """The five kinds of prompt over each passage's three best documents."""
    best = L.fetched(L.bm25(_asked(s, d), table(s, d, "documents"), 3).select("query_id", "doc_id", "rank"), table(s, d, "documents").select("doc_id", "text"))
    context = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    rows = _asked(s, d).join(context, "query_id").select("query_id", "query", F.transform("c", lambda x: x["text"]).alias("c"))
    q, c = F.col("query"), F.col("c")
    asked = {
        "technical_qa": P.prompt("technical_qa", c, question=q),
        "equation_explanation": P.prompt("equation_explanation", c, question=q, equation=F.lit("$I = \\frac{bh^3}{12}$")),
        "procedural_steps": P.prompt("procedural_steps", c, task=q),
        "conceptual": P.prompt("conceptual", c, question=q, concept=F.substring(q, 1, 20)),
        "comparative": P.prompt("comparative", c, items=F.array(F.lit("beams"), F.lit("plates")), criteria=F.when(F.col("query_id") % 2 == 0, "weight")),
    }
    return rows.select("query_id", F.explode(F.create_map(*(x for k, v in asked.items() for x in (F.lit(k), F.struct(v["system"], v["user"]))))).alias("kind", "p")).select("query_id", "kind", F.md5("p.col1").alias("system"), F.md5("p.col2").alias("user"))


def _cited(s, d):
    return G.tracked(_uses(s, d))


def answer_sources(s, d):
    meta = rows_df(s, META, "n int, chunk_id string, meta string").select("chunk_id", F.expr("str_to_map(meta, '[|]', '=')").alias("meta"))
    rows = _cited(s, d).join(meta, "chunk_id").select("answer_id", "rank", G.citation_text("ieee", F.col("rank"), F.lit("")).alias("citation"), G.source_info(F.col("meta"), F.col("chunk_id")).alias("info"), G.source_link(F.col("meta")).alias("link"))
    return P.with_sources(rows_df(s, ANSWERS, "answer_id int, answer string"), rows)


def citation_summary(s, d):
    return P.citation_summary(_uses(s, d), _cited(s, d))


def _results(s, d):
    best = L.bm25(_asked(s, d), table(s, d, "documents"), 6)
    return L.fetched(best, table(s, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("source"), F.col("text").alias("content")))


def rendered_results(s, d):
    return P.rendered_results(_results(s, d)).select("query_id", F.md5("text").alias("digest"))


def context_summary(s, d):
    return P.context_summary(_results(s, d).withColumn("score", F.round(F.col("score"), 6))).select("query_id", F.md5("summary").alias("digest"))


# --- vectors and stores ---------------------------------------------------------------


def masked_pooling(s, d):
    """Vectors of eight rows as tokens of one text, those of even labels masked in."""
    e = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("id"), "vec_id", V.as_double(F.col("embedding")).alias("v"), (F.col("label") % 2 == 0).cast("int").alias("m"))
    rows = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "m"))).alias("t"))
    pooled = V.masked_mean(F.transform("t", lambda x: x["v"]), F.transform("t", lambda x: x["m"]))
    return rows.select("id", F.posexplode(pooled).alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def quantise_metrics(s, d):
    return O.quantisation_metrics(table(s, d, "embeddings"))


def chunk_points(s, d):
    chunks = table(s, d, "documents").select("doc_id", F.array(F.lit(0.0)).alias("v"), "lang", F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("page"))
    return R.points(chunks, "doc_id", "v", ["lang", "size"], ["page"]).select("id", "payload")


def comprehensive_search(s, d):
    """Best documents by BM25 and facts that hold for the passage's language, as sources of one answer; a third source failed."""
    lexical = L.bm25(_asked(s, d), table(s, d, "documents"), 3).select("query_id", F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    facts = _asked(s, d).where("query_id % 2 = 0").select("query_id", F.concat(F.lit("fact-"), F.col("query_id").cast("string")).alias("id"), F.lit(1.0).alias("score"))
    return R.comprehensive(vector=lexical, graph=facts, other=None)


def remaining_rows(s, d):
    return R.remaining(Documents=table(s, d, "documents"), Chunks=table(s, d, "pages").where("page_id < 0"))


def captured_parse(s, d):
    """LaTeX of each book's first equation, or why it isn't valid."""
    rows = _books(s, d).select("id", F.regexp_extract("text", r"\$\$([^$]+)\$\$", 1).alias("e"))
    return R.captured(rows, "id", F.char_length("e").cast("long"), T.latex_error(F.col("e")))


QUERIES = {f.__name__: f for f in (latex_front_matter, latex_sections, latex_equations, latex_figures, equation_boundaries, equation_contexts, chunk_equation_check, equations_in_chunks, parser_validation, parser_report, project_chunks, retrieve_with_equations, equation_parent, equation_text_match, dict_filters, json_contains, json_contains_nested, all_terms_match, terms_predicate, score_clamp, prompt_kinds, answer_sources, citation_summary, rendered_results, context_summary, masked_pooling, quantise_metrics, chunk_points, comprehensive_search, remaining_rows, captured_parse)}

# --- SQL ------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(patterns: dict[str, str], source: str = "b") -> str:
    """id, text, kind, found, start, stop, line of all matches."""
    each = [f"SELECT id, text, {_q(kind)} AS kind, regexp_extract_all(text, {_q(p)}, 0) AS f, regexp_split_to_array(text, {_q(p)}) AS p FROM {source}" for kind, p in patterns.items()]
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda v: length(v))), 0)"
    return f"""(SELECT id, text, kind, f[i] AS found, CAST({size('p[1:i]')} + {size('f[1:i-1]')} AS BIGINT) AS start, CAST({size('p[1:i]')} + {size('f[1:i]')} AS BIGINT) AS stop
        FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({' UNION ALL '.join(each)})))"""


_LINE = "length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1"
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_HEAD = {level: X.HEADING.format(level=level) for level in T.HEADINGS}
_ANY_HEAD = X.HEADING.format(level="[a-z]+")
_KINDS = {k: p for k, p in T.EQUATION_KINDS.items()}
_INSIDE = "CASE kind " + " ".join(f"WHEN {_q(k)} THEN regexp_extract(found, {_q(p)}, 1)" for k, p in _KINDS.items()) + " END"
_FIGS = {k: rf"(?s)\\begin\{{{k}\}}(.+?)\\end\{{{k}\}}" for k in X.FIGURE_KINDS}
_BOUNDS = f"""
    x AS MATERIALIZED (SELECT id, text, found, start, stop FROM {_spans_sql(X.DISPLAY)}),
    y AS MATERIALIZED (SELECT id, text, found, start, stop FROM {_spans_sql({'inline': X.INLINE})}),
    z AS MATERIALIZED (SELECT id, text, 'display' AS kind, found, start, stop FROM x UNION ALL SELECT id, text, 'inline', found, start, stop FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = y.id AND x.start <= y.start AND y.start < x.stop))"""
_B = f"WITH b AS MATERIALIZED (SELECT * FROM {BOOK_SQL})"
_COUNT = lambda t, ps: " + ".join(f"len(regexp_extract_all({t}, {_q(p)}))" for p in ps)
_CHECKED = f"""{_B},
    p AS (SELECT id, text AS source, CASE WHEN id % 10 = 3 THEN replace(text, '$$', '') WHEN id % 10 <> 7 THEN text END AS markdown FROM b),
    c AS (SELECT *, {_COUNT('source', X.SOURCE_EQUATIONS)} AS original, coalesce({_COUNT('markdown', X.PARSED_EQUATIONS)}, 0) AS kept,
          coalesce(len(list_filter(regexp_extract_all(markdown, '\\$\\$([^$]+)\\$\\$', 1), lambda e: length(replace(e, '{{', '')) <> length(replace(e, '}}', '')) OR length(replace(e, '[', '')) <> length(replace(e, ']', '')))) = 0, false) AS syntax_valid FROM p),
    r AS (SELECT *, CASE WHEN markdown IS NULL THEN 0.0::DOUBLE WHEN original > 0 THEN kept / original ELSE 1.0::DOUBLE END AS preservation FROM c),
    v AS (SELECT *, CASE WHEN markdown IS NULL THEN 'Parser failed' ELSE concat_ws('|', CASE WHEN preservation < 0.95 THEN printf('Equation preservation rate %.1f%% below target 95.0%%', preservation * 100) END, CASE WHEN NOT syntax_valid THEN 'Invalid LaTeX syntax detected in equations' END) END AS issues FROM r)"""

def _template_sql(kind: str, **values: str) -> str:
    import re

    parts = re.split(r"\{([a-z]+)\}", P.TEMPLATES[kind])
    return " || ".join(values[p] if i % 2 else literal(p) for i, p in enumerate(parts) if p)


_PROMPTS = {
    "technical_qa": _template_sql("technical_qa", context="context", question="query"),
    "equation_explanation": _template_sql("equation_explanation", context="context", question="query", equation="'$I = \\frac{bh^3}{12}$'"),
    "procedural_steps": _template_sql("procedural_steps", context="context", task="query", validation=literal(P.VALIDATION)),
    "conceptual": _template_sql("conceptual", context="context", question="query", concept="substr(query, 1, 20)"),
    "comparative": _template_sql("comparative", context="context", items="'beams vs. plates'", criteria="CASE WHEN query_id % 2 = 0 THEN chr(10) || '**Focus Criteria:** weight' || chr(10) ELSE '' END"),
}
_POINTS = f"p AS MATERIALIZED (SELECT id AS context_chunk_id, kind, start AS place, {_STRIP(_INSIDE)} AS content FROM {_spans_sql({k: _KINDS[k] for k in ('display', 'equation', 'align')})})"

_CLASS, _BODY, _CAPTION = r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}", r"(?s)^\\begin\{[a-z]+\}(.+)\\end\{[a-z]+\}$", r"\\caption\{([^}]+)\}"
_command = lambda p, of="text": _STRIP(f"regexp_extract({of}, {_q(p)}, 1)")

ORACLES = {
    "latex_front_matter": f"""{_B} SELECT id, {_command(r'\\title\{([^}]+)\}')} AS title, {_command(r'\\author\{([^}]+)\}')} AS author, {_command(_CLASS)} AS document_class, octet_length(encode(text)) AS file_size_bytes,
        CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')) END AS line_count, contains(regexp_extract(text, {_q(_CLASS)}, 1), 'AeroStructure') AS has_custom_class FROM b""",
    "latex_sections": f"{_B} SELECT id, kind AS level, {_STRIP(f'regexp_extract(found, {_q(_ANY_HEAD)}, 2)')} AS title, nullif(regexp_extract(found, {_q(_ANY_HEAD)}, 1), '') AS short_title, nullif(regexp_extract(substr(text, stop + 1, 100), {_q(X.LABEL)}, 1), '') AS label, {_LINE} AS line FROM {_spans_sql(_HEAD)}",
    "latex_equations": f"""{_B}, e AS (SELECT *, {_INSIDE} AS inside, {_STRIP('substr(text, CAST(greatest(start - 99, 1) AS BIGINT), CAST(least(start, 100) AS BIGINT))')} AS before, {_STRIP('substr(text, stop + 1, 100)')} AS after FROM {_spans_sql(_KINDS)})
        SELECT id, kind, md5({_STRIP('inside')}) AS content, nullif(regexp_extract(inside, {_q(X.LABEL)}, 1), '') AS label, {_LINE} AS line, start, stop, CASE WHEN length(before) > 50 THEN right(before, 50) ELSE before END AS context_before, substr(after, 1, 50) AS context_after FROM e""",
    "latex_figures": f"""{_B}, e AS (SELECT *, regexp_extract(found, {_q(_BODY)}, 1) AS body FROM {_spans_sql(_FIGS)})
        SELECT id, kind, {_command(_CAPTION, 'body')} AS caption, nullif(regexp_extract(body, {_q(X.LABEL)}, 1), '') AS label, {_STRIP('body')} AS content, {_LINE} AS line FROM e""",
    "equation_boundaries": f"{_B}, {_BOUNDS} SELECT id, kind, start, stop FROM z",
    "equation_contexts": rf"""{_B}, {_BOUNDS}, c AS (SELECT id, start, found, regexp_split_to_array(substr(text, 1, start), '[.!?]+\s+') AS before, regexp_split_to_array(substr(text, stop + 1), '[.!?]+\s+') AS after FROM z WHERE kind = 'display')
        SELECT id, start, {_STRIP("array_to_string(before[-2:], ' ') || ' ' || found || ' ' || array_to_string(after[1:2], ' ')")} AS context FROM c""",
    "chunk_equation_check": f"{_B}, {_BOUNDS}, v AS (SELECT id, count(*) AS n FROM z WHERE kind = 'display' AND ((length(found) - length(replace(found, '$$', ''))) // 2) % 2 <> 0 GROUP BY id) SELECT b.id, coalesce(n, 0) AS violations, coalesce(n, 0) = 0 AS valid FROM b LEFT JOIN v USING (id)",
    "equations_in_chunks": f"{_B}, w AS (SELECT id, i AS chunk_index, i * 300 AS a, i * 300 + length(substr(text, i * 300 + 1, 400)) AS z FROM (SELECT id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 300.0) AS BIGINT)))) AS i FROM b)), e AS (SELECT id, start FROM {_spans_sql({'equation': _KINDS['equation']})}) SELECT e.id, start AS at, chunk_index FROM e JOIN w ON w.id = e.id AND a <= start AND start < z",
    "parser_validation": f"{_CHECKED} SELECT id, original, kept, round(preservation, 6) AS preservation, syntax_valid, issues = '' AS passed, issues FROM v",
    "parser_report": f"{_CHECKED} SELECT count(*) AS total_files, count(*) FILTER (issues = '') AS passed, count(*) FILTER (issues <> '') AS failed, round(count(*) FILTER (issues = '') / count(*), 6) AS pass_rate, round(avg(preservation), 6) AS avg_preservation FROM v",
    "project_chunks": rf"""
        WITH f AS MATERIALIZED (SELECT * FROM {FILES_SQL}), t AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY file) AS n FROM f WHERE file LIKE '%.tex'),
        pr AS (SELECT dir, last(split_part(dir, '/', -1)) AS project_name, bool_or(has) AS has_custom_class FROM (SELECT dir, file LIKE '%.cls' AS has FROM f) GROUP BY dir),
        ok AS (SELECT pr.* FROM pr JOIN (SELECT dir, count(*) AS n_tex, bool_or(n <= 3 AND regexp_matches(text, '\\myexternaldocument|\\input')) AS links FROM t GROUP BY dir) USING (dir) WHERE n_tex >= 3 AND (has_custom_class OR links)),
        ch AS (SELECT dir, file, CAST(nullif(regexp_extract(file, 'Ch(\d+)_.*\.tex', 1), '') AS INTEGER) AS number, nullif(regexp_extract(text, '\\chapter(?:\[[^\]]*\])?\{{([^}}]+)\}}', 1), '') AS title, contains(lower(file), 'app') AS is_appendix FROM f),
        rf AS (SELECT dir, file, array_to_string(list_sort(regexp_extract_all(text, '\\myexternaldocument\{{([^}}]+)\}}', 1)), '|') AS refs FROM f)
        SELECT t.dir, t.file, ok.dir IS NOT NULL AS is_project, project_name, CASE WHEN ok.dir IS NOT NULL THEN number END AS chapter_number, CASE WHEN ok.dir IS NOT NULL THEN title END AS chapter_title, CASE WHEN ok.dir IS NOT NULL THEN is_appendix END AS is_appendix, has_custom_class,
               CASE WHEN ok.dir IS NOT NULL THEN (SELECT min(file) FROM f WHERE f.dir = t.dir AND file LIKE '%.cls') END AS document_class, CASE WHEN ok.dir IS NOT NULL THEN (SELECT max(refs) FROM rf WHERE rf.dir = t.dir) <> '' END AS has_cross_refs,
               CASE WHEN ok.dir IS NOT NULL THEN refs END AS references_chapters, CASE WHEN ok.dir IS NOT NULL THEN true END AS book_context, CASE WHEN ok.dir IS NOT NULL THEN (SELECT count(*) FROM ch c WHERE c.dir = t.dir AND number IS NOT NULL AND NOT is_appendix) END AS total_chapters
        FROM t LEFT JOIN ok USING (dir) JOIN ch USING (dir, file) JOIN rf USING (dir, file)""",
    "retrieve_with_equations": f"{_B}, {_POINTS}, {_bm25_sql('m', 5)}, n AS (SELECT context_chunk_id, string_agg(kind || '@' || place, '|' ORDER BY place, kind) AS e FROM p GROUP BY 1) SELECT query_id, doc_id AS id, rank, coalesce(e, '') AS equations FROM mk LEFT JOIN n ON context_chunk_id = doc_id",
    "equation_parent": f"{_B}, {_POINTS} SELECT place, kind, context_chunk_id, lang, source FROM p JOIN documents ON doc_id = context_chunk_id",
    "equation_text_match": rf"{_B}, {_POINTS} SELECT context_chunk_id, count(*) AS n FROM p WHERE contains(content, 'P') AND contains(content, '=') AND contains(content, '\frac{{a}}') GROUP BY 1",
    "dict_filters": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200 AND n_chars < 5000",
    "json_contains": "SELECT event_id FROM events WHERE props::JSON ->> 'k' = '7'",
    "json_contains_nested": "SELECT conv_id, bool_or(turn = 0 AND role = 'user') AS first_user, bool_or(turn = 3 AND role = 'assistant') AND bool_or(role = 'user') AS both_sides, count(*) = 5 AS five, false AS text_five FROM conversations GROUP BY conv_id",
    "all_terms_match": f"""
        WITH q AS (SELECT item_id AS query_id, list_distinct({TOKENS_SQL}) AS terms FROM benchmark), t AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents)
        SELECT query_id, count(*) AS n FROM q, t WHERE len(list_intersect(terms, toks)) = len(terms) GROUP BY query_id""",
    "terms_predicate": f"SELECT doc_id FROM (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents) WHERE list_contains(toks, 'de') AND list_contains(toks, 'la')",
    "score_clamp": "SELECT vec_id, round(greatest(0, least(1, embedding[1]::DOUBLE * 5)), 6) AS score FROM embeddings",
    "prompt_kinds": f"""
        WITH {_bm25_sql('m', 3)}, c AS (SELECT query_id, string_agg('[Context ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM mk JOIN documents USING (doc_id) GROUP BY query_id),
        r AS (SELECT query_id, text AS query, context FROM benchmark JOIN c ON query_id = item_id)
        {' UNION ALL '.join(f"SELECT query_id, {_q(k)} AS kind, md5({literal(P.SYSTEM[k])}) AS system, md5({_PROMPTS[k]}) AS user FROM r" for k in QUERIES_OF_KINDS)}""",
    "answer_sources": _CITED + r""",
        m AS (SELECT chunk_id, """ + ", ".join(rf"nullif(regexp_extract(meta, '(?:^|\|){k}=([^|]*)', 1), '') AS {k}" for k in ("document", "section", "chapter", "page", "figure", "table", "url", "document_path")).replace("AS table", 'AS "table"') + f" FROM {values_sql(META, 'n, chunk_id, meta')})," + """
        i AS (SELECT *, coalesce(nullif(concat_ws(', ', document, coalesce('Section ' || section, 'Chapter ' || chapter), 'p. ' || page, coalesce('Figure ' || figure, 'Table ' || "table")), ''), 'Source ' || chunk_id) AS info, coalesce(url, 'file://' || document_path || '#page=' || page) AS link FROM m),
        l AS (SELECT answer_id, string_agg('[' || rank || '] ' || info || coalesce(' ([View Source](' || link || '))', '') || chr(10), '' ORDER BY rank) AS lines FROM c JOIN i USING (chunk_id) GROUP BY answer_id)
        SELECT CAST(a.answer_id AS INTEGER) AS answer_id, answer || coalesce(chr(10) || chr(10) || '**Sources:**' || chr(10) || lines, '') AS answer FROM """ + values_sql(ANSWERS, "answer_id, answer").replace("AS v", "AS a") + " LEFT JOIN l ON l.answer_id = a.answer_id",
    "citation_summary": _CITED + " SELECT u.answer_id, count(c.chunk_id) AS total_citations, count(*) AS total_chunks_tracked, count(c.chunk_id) AS chunks_above_threshold, 'ieee' AS citation_style, round(avg(c.relevance), 6) AS avg_relevance, round(avg(c.confidence), 6) AS avg_confidence FROM u LEFT JOIN c ON c.answer_id = u.answer_id AND c.chunk_id = u.chunk_id GROUP BY u.answer_id",
    "rendered_results": f"WITH {_bm25_sql('m', 6)} SELECT query_id, md5('Found ' || count(*) || ' relevant results:' || chr(10) || chr(10) || string_agg('[Source: ' || source || ']' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank)) AS digest FROM mk JOIN documents USING (doc_id) GROUP BY query_id",
    "context_summary": f"WITH {_bm25_sql('m', 5)} SELECT query_id, md5(string_agg(printf('Chunk %d (Score: %.3f):', rank, round(score, 6)) || chr(10) || 'Source: ' || source || ' (' || lang || ')' || chr(10) || 'Content: ' || substr(text, 1, 200) || '...', chr(10) || chr(10) ORDER BY rank)) AS digest FROM mk JOIN documents USING (doc_id) GROUP BY query_id",
    "masked_pooling": "SELECT vec_id // 8 AS id, dim, round(coalesce(sum(x) FILTER (label % 2 = 0), 0) / greatest(count(*) FILTER (label % 2 = 0), 1e-9), 6) AS x FROM (SELECT vec_id, label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2",
    "quantise_metrics": "WITH s AS (SELECT count(*) AS n, sum(len(embedding)) * 4 AS o, sum((len(embedding) + 7) // 8) AS b, sum(len(embedding)) AS i FROM embeddings) SELECT kind, n, round(o / 1048576.0::DOUBLE, 6) AS original_mb, round(CASE kind WHEN 'binary' THEN b ELSE i END / 1048576.0::DOUBLE, 6) AS quantized_mb, round(o / CASE kind WHEN 'binary' THEN b ELSE i END::DOUBLE, 6) AS ratio FROM s, (SELECT unnest(['binary', 'int8']) AS kind)",
    "chunk_points": """SELECT doc_id AS id, '{"lang":"' || lang || '","size":' || n_chars || CASE WHEN doc_id % 3 = 0 THEN ',"page":' || doc_id ELSE '' END || '}' AS payload FROM documents""",
    "comprehensive_search": f"WITH {_bm25_sql('m', 3)}, a AS (SELECT query_id, doc_id::VARCHAR AS id, round(score, 6) AS score, 'vector' AS source FROM mk UNION ALL SELECT item_id, 'fact-' || item_id, 1.0::DOUBLE, 'graph' FROM benchmark WHERE item_id % 2 = 0) SELECT *, count(*) OVER (PARTITION BY query_id) AS total_results FROM a",
    "remaining_rows": "SELECT 'Documents remaining:' AS status, count(*) AS n FROM documents UNION ALL SELECT 'Chunks remaining:', count(*) FROM pages WHERE page_id < 0",
    "captured_parse": rf"""{_B}, e AS (SELECT id, regexp_extract(text, '\$\$([^$]+)\$\$', 1) AS e FROM b), c AS (SELECT id, e, CASE WHEN e = '' THEN 'Empty or invalid input' WHEN len(string_split(e, '{{')) <> len(string_split(e, '}}')) THEN printf('Unbalanced braces: %d open, %d close', len(string_split(e, '{{')) - 1, len(string_split(e, '}}')) - 1)
        WHEN regexp_matches(e, '[_^\\]\s*$') THEN 'Incomplete command at end' WHEN length(e) > 5000 THEN printf('LaTeX too long (%d chars, max 5000)', length(e)) END AS error FROM e) SELECT id, CASE WHEN error IS NULL THEN length(e) END AS value, error FROM c""",
}
