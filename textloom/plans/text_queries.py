"""Queries over text structure and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from .common import Derived, rows_df, table, values_sql

LATEX = [
    (1, "\\documentclass{book}\n\\title{Beams}\n% a comment\n\\begin{document}\n\\chapter{Loads}\n\\label{ch:loads}\nSee Figure 2-1 and fig. 3 in \\ref{eq:a}, \\ref{eq:b} \\cite{x, y} \\cite{x}. 5\\% of $E$ % tail\n\\begin{equation}\nP = \\frac{a}{b}\n\\end{equation}\n\\section[short]{Shear flow}\nInline $I$ and $$q = VQ/I$$ end.\n\\end{document}"),
    (2, "a \\% b % c\n% x\n\n  \nplain"),
    (3, "The Euler buckling formula is $$P_{cr} = \\frac{\\pi^2 EI}{L^2}$$. See Figure 2-1."),
    (4, "\\begin{align}x &= 1\\end{align} and \\begin{align*}y\\end{align*} \\[ z \\] \\begin{gather}g\\end{gather} \\begin{eqnarray}e\\end{eqnarray} \\begin{equation*}s\\end{equation*}"),
    (5, ""),
    (6, "The FEM and CFD Equation of Motion has stiffness, tension and density. NASA FIG 7 Fig.8-2"),
]
BROKEN = [
    (1, "\\frac{1{2"), (2, "\\begin{array} x"), (3, "\\left( x"), (4, "x    y"), (5, "x_"), (6, "\\frac{1{2  _"), (7, ""), (8, "a}} b}}"), (9, "\\right) y"), (10, "\\frac{a}"), (11, "{ a }  {b }"),
    (12, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (13, "\\frac{1}{2}"), (14, "x^"), (15, "x\\"), (16, "\\begin{align} a"), (17, "{a"),
]
MARKDOWN = [(1, "# One\nintro\n## Two\nbody\n### Three\nmore\n## Four\nlast"), (2, "text\n# Only\n\nend"), (3, "none")]
ENTITIES = [(1, "Google and microsoft hired Sam Altman in San Francisco for AI said Acme Corp"), (2, "metal applejack; deep learning with GPT, 5G and an API by Foo Ltd in New York"), (3, "")]
FILES = [
    ("a", "Ch01_x.tex", "\\chapter{One} \\myexternaldocument{Ch02} $a$"), ("a", "Ch02_y.tex", "\\chapter[s]{Two} \\myexternaldocument{Ch01} \\myexternaldocument{Ch03}"), ("a", "App_z.tex", "$1$ $2$ $3$ $4$ $5$ $6$"),
    ("b", "Ch01_q.tex", "none"), ("b", "x.cls", ""), ("c", "Ch01.tex", ""), ("c", "Ch02.tex", ""), ("c", "Ch03.tex", ""), ("c", "my.cls", ""),
]
FRONT = [(1, "---\ntitle: X\n---\nBody text\n# Late", "one.md"), (2, "\n\n# Second doc\nwords here", "two.md"), (3, "1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n# too late", "three.md"), (4, "", "four.md")]
PARSES = [(1, "x" * 120, "fallback"), (2, " " * 120 + "short", "y" * 150), (3, None, "z" * 99), (4, None, None)]
SIZES = [(0,), (512,), (1536,), (1048576,), (5 * 1024**3,), (3 * 1024**4,)]

#: The literal cases united with what is made of every document.
FRONTS = Derived(FRONT, "id int, text string, file string", ("documents", "doc_id + 1000", "CASE doc_id % 3 WHEN 0 THEN concat('---', chr(10), 'title: D', CAST(doc_id AS STRING), chr(10), '---', chr(10), text) WHEN 1 THEN concat(chr(10), '# Head ', CAST(doc_id AS STRING), chr(10), text) ELSE text END", "concat('doc', CAST(doc_id AS STRING), '.md')"))
PARSED = Derived(PARSES, "id int, a string, b string", ("documents", "doc_id + 1000", "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '   short ' ELSE text END", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat(text, ' b') END"))
SIZED = Derived(SIZES, "n long", ("documents", "n_chars * n_chars * (doc_id + 1) * 100 + 7"), ("orders", "o_orderkey * 100 + 7"))

_docs = lambda s, d: table(s, d, "documents")
_latex = lambda s: rows_df(s, LATEX, "id int, text string")
LATEX_SQL = "(SELECT CAST(id AS INTEGER) AS id, text FROM " + values_sql(LATEX, "id, text") + ")"
#: Every text of the corpus and the LaTeX samples.
MIXED_SQL = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {LATEX_SQL})"


#: Markdown made of each document, LaTeX that may be broken, and files of a project for every five documents, in SQL that both engines read.
_MD_EXPR = "concat('# D', CAST(doc_id AS STRING), {n}, text, {n}, '## S', CAST(doc_id % 4 AS STRING), {n}, 'x', {n}, CASE WHEN doc_id % 3 = 0 THEN concat('### Deep', {n}) ELSE '' END, 'y', {n}, '# Second', {n}, replace(text, {n}, ' '))"
_BROKEN_EXPR = "CASE doc_id % 4 WHEN 0 THEN concat(text, '{{') WHEN 1 THEN concat({b}, 'begin{{align}}', text) WHEN 2 THEN concat({b}, 'left(', text, '}}') ELSE text END"
MARKDOWN_SQL = f"(SELECT CAST(id AS BIGINT) AS id, text FROM {values_sql(MARKDOWN, 'id, text')} UNION ALL SELECT doc_id + 100, {_MD_EXPR.format(n='chr(10)')} FROM documents)"
BROKEN_SQL = f"(SELECT CAST(id AS BIGINT) AS id, latex FROM {values_sql(BROKEN, 'id, latex')} UNION ALL SELECT doc_id + 100, {_BROKEN_EXPR.format(b='chr(92)')} FROM documents)"
FILES_SQL = f"""(SELECT * FROM {values_sql(FILES, 'dir, file, text')} UNION ALL SELECT 'p' || (doc_id // 5), 'Ch' || (doc_id % 5 + 1) || '_x.tex', chr(92) || 'chapter{{T' || doc_id || '}} ' || chr(92) || 'input{{a}} ' || chr(92) || 'myexternaldocument{{Ch' || (doc_id % 3) || '}} ' || text FROM documents)"""


def _markdown(s: SparkSession, d: str) -> DataFrame:
    return rows_df(s, MARKDOWN, "id long, text string").unionByName(_docs(s, d).select((F.col("doc_id") + 100).alias("id"), F.expr(_MD_EXPR.format(n="chr(10)")).alias("text")))


def _broken(s: SparkSession, d: str) -> DataFrame:
    return rows_df(s, BROKEN, "id long, latex string").unionByName(_docs(s, d).select((F.col("doc_id") + 100).alias("id"), F.expr(_BROKEN_EXPR.format(b="chr(92)")).alias("latex")))


def _files(s: SparkSession, d: str) -> DataFrame:
    made = _docs(s, d).select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5).cast("string")).alias("dir"),
        F.concat(F.lit("Ch"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("_x.tex")).alias("file"),
        F.concat(F.lit("\\chapter{T"), F.col("doc_id").cast("string"), F.lit("} \\input{a} \\myexternaldocument{Ch"), (F.col("doc_id") % 3).cast("string"), F.lit("} "), F.col("text")).alias("text"),
    )
    return rows_df(s, FILES, "dir string, file string, text string").unionByName(made)


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select(F.col("doc_id").alias("id"), "text").unionByName(_latex(s).select((-F.col("id")).cast("long").alias("id"), "text"))


def tokenize_counts(s, d):
    return _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct"))


def normalize_whitespace(s, d):
    return _mixed(s, d).select("id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


def strip_comments(s, d):
    return _mixed(s, d).select("id", T.strip_comments(F.col("text")).alias("stripped"))


def latex_equation_counts(s, d):
    return _mixed(s, d).select("id", *(c.alias("n_" + k.replace("*", "_star")) for k, c in T.equation_counts(F.col("text")).items()))


def latex_refs(s, d):
    return _mixed(s, d).select("id", F.array_join(T.references(F.col("text")), "|").alias("refs"), F.array_join(T.citations(F.col("text")), "|").alias("cites"))


def latex_to_markdown(s, d):
    return _mixed(s, d).select("id", F.md5(T.to_markdown(F.col("text"))).alias("digest"))


def enrich_chunks(s, d):
    out = D.enrich(_mixed(s, d))
    return out.select("id", "equation_count", "has_equations", F.array_join("figure_references", "|").alias("figures"), F.array_join("keywords", "|").alias("keywords"), "chunk_type", "latex_source", "token_count")


def latex_clean(s, d):
    return D.clean_latex(_broken(s, d), "latex")


def latex_validate(s, d):
    return _broken(s, d).select("id", T.latex_error(F.col("latex")).alias("error"))


def markdown_sections(s, d):
    return D.sections(_markdown(s, d), "id", "text")


def section_asof(s, d):
    docs = _markdown(s, d)
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "row")).select("id", (F.col("at") + 1).cast("long").alias("line"), "row")
    out = D.section_of(D.sections(docs, "id", "text"), lines, "id", "line")
    return out.select("id", "line", F.array_join("section_path", " > ").alias("path"))


def entities_dictionary(s, d):
    rows = rows_df(s, ENTITIES, "id long, text string").unionByName(_docs(s, d).select((F.col("doc_id") + 1000).alias("id"), "text"))
    return rows.select("id", *(F.array_join(c, "|").alias(k) for k, c in D.dictionary_entities(F.col("text")).items()))


def entities_pattern(s, d):
    rows = rows_df(s, ENTITIES, "id long, text string").unionByName(_docs(s, d).select((F.col("doc_id") + 1000).alias("id"), "text"))
    return rows.select("id", *(F.array_join(c, "|").alias(k) for k, c in D.pattern_entities(F.col("text")).items()))


def episode_truncate(s, d):
    out = T.truncated_episode(F.col("text"), F.col("source"))
    return _docs(s, d).select("doc_id", F.char_length(out).cast("long").alias("n"), F.md5(out).alias("digest"))


def title_frontmatter(s, d):
    rows = FRONTS.df(s, d)
    return rows.select("id", T.title(F.col("text"), F.regexp_replace("file", r"\.[^.]*$", "")).alias("title"), T.frontmatter(F.col("text")).alias("frontmatter"), F.size(F.split("text", "\n")).cast("long").alias("line_count"))


def parser_fallback(s, d):
    return D.with_parsers(PARSED.df(s, d), "a", "b").select("id", F.char_length("content").cast("long").alias("n"), F.col("content").isNull().alias("failed"))


def project_detect(s, d):
    return D.projects(_files(s, d)).select("dir", "n_tex", "has_class", "has_links", "is_project")


def chapter_info(s, d):
    return D.chapters(_files(s, d))


def xref_degrees(s, d):
    edges = D.cross_references(_files(s, d))
    return edges.groupBy("dir", "src").agg(F.count("*").alias("out_degree"), F.array_join(F.array_sort(F.collect_list("dst")), "|").alias("targets"))


def html_to_text(s, d):
    return table(s, d, "pages").select("page_id", F.char_length(T.html_text(F.col("html"))).cast("long").alias("n"), F.md5(T.html_text(F.col("html"))).alias("digest"))


def format_sizes(s, d):
    return SIZED.df(s, d).distinct().select("n", T.format_size(F.col("n")).alias("size"), T.format_millis(F.col("n")).alias("time"))


def token_estimate(s, d):
    return _docs(s, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.round(F.avg(T.token_estimate(F.col("text"))), 6).alias("avg_tokens"))


QUERIES = {f.__name__: f for f in (tokenize_counts, normalize_whitespace, strip_comments, latex_equation_counts, latex_refs, latex_to_markdown, enrich_chunks, latex_clean, latex_validate, markdown_sections, section_asof, entities_dictionary, entities_pattern, episode_truncate, title_frontmatter, parser_fallback, project_detect, chapter_info, xref_degrees, html_to_text, format_sizes, token_estimate)}

TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+'), lambda t: t <> '')"


def _names(names: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


def _matches_sql(patterns: tuple[str, ...]) -> str:
    """All matches in a text with a mark after each character that is no letter, so that one match doesn't take the space before the next."""
    out = []
    for p in patterns:
        body = p.removeprefix(r"(?i)\b").removesuffix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s+", r"[\s\x01]+").replace(" ", r" \x01")
        out.append(f"list_transform(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({body})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), lambda x: replace(x, chr(1), ''))")
    return " || ".join(out)


def _markdown_sql() -> str:
    """`to_markdown` in SQL."""
    x = r"coalesce(nullif(regexp_extract(text, '(?s)\\begin\{document\}(.+?)\\end\{document\}', 1), ''), text)"
    for name, marks in T.HEADINGS.items():
        x = rf"regexp_replace({x}, '\\{name}(?:\[([^\]]+)\])?\{{([^}}]+)\}}', chr(10) || '{marks} \2' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?s)\\begin\{{equation\}}\s*(.+?)\s*\\end\{{equation\}}', chr(10) || '$$' || chr(10) || '\1' || chr(10) || '$$' || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\\label\{{[^}}]+\}}', '', 'g'), '\\[a-zA-Z]+\{{([^}}]+)\}}', '\1', 'g')"


def _times(needle: str) -> str:
    return f"(length(latex) - length(replace(latex, '{needle}', ''))) // {len(needle)}"


ORACLES = {
    "latex_to_markdown": f"SELECT id, md5({_markdown_sql()}) AS digest FROM {MIXED_SQL}",
    "latex_validate": rf"""
        WITH c AS (SELECT id, latex AS x, length(latex) - length(replace(latex, '{{', '')) AS o, length(latex) - length(replace(latex, '}}', '')) AS c, {', '.join(f"{_times(chr(92) + 'begin{' + e + '}')} AS b_{e}, {_times(chr(92) + 'end{' + e + '}')} AS e_{e}" for e in T.BALANCED)}, {_times(chr(92) + 'left')} AS l, {_times(chr(92) + 'right')} AS r FROM {BROKEN_SQL})
        SELECT id, CASE WHEN x IS NULL OR x = '' THEN 'Empty or invalid input' WHEN o <> c THEN printf('Unbalanced braces: %d open, %d close', o, c) {' '.join(f"WHEN b_{e} <> e_{e} THEN printf('Unbalanced {e} environment: %d begin, %d end', b_{e}, e_{e})" for e in T.BALANCED)}
            WHEN l <> r THEN printf('Unbalanced \left/\right: %d left, %d right', l, r) WHEN regexp_matches(x, '[_^\\]\s*$') THEN 'Incomplete command at end'
            WHEN len(list_filter(list_distinct(string_split(x, '')), lambda v: contains(x, repeat(v, 101)))) > 0 THEN 'Excessive character repetition (possible infinite loop)' WHEN length(x) > 5000 THEN printf('LaTeX too long (%d chars, max 5000)', length(x)) END AS error FROM c""",
    "tokenize_counts": f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, len(list_distinct({TOKENS_SQL})) AS n_distinct FROM documents",
    "normalize_whitespace": rf"""
        SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM {MIXED_SQL}""",
    "strip_comments": rf"""
        SELECT id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^((?:[^%\\]|\\%|\\)*?)%.*$', '\1')),
            lambda x: regexp_replace(x, '\s', '', 'g') <> ''), chr(10)) AS stripped FROM {MIXED_SQL}""",
    "latex_equation_counts": f"SELECT id, {', '.join(f'''len(regexp_extract_all(text, '{p}', 1)) AS n_{k.replace('*', '_star')}''' for k, p in T.EQUATION_KINDS.items())} FROM {MIXED_SQL}",
    "latex_refs": rf"""
        SELECT id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\ref\{{([^}}]+)\}}', 1))), '|'), '') AS refs,
               coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(text, '\\cite\{{([^}}]+)\}}', 1), lambda x: list_transform(string_split(x, ','), lambda y: trim(y)))))), '|'), '') AS cites
        FROM {MIXED_SQL}""",
    "enrich_chunks": rf"""
        WITH e AS (
            SELECT id, text,
                   len(regexp_extract_all(text, '\$\$[^$]+\$\$')) + len(regexp_extract_all(text, '\\begin\{{equation\}}')) + len(regexp_extract_all(text, '\\begin\{{align\}}'))
                     + len(regexp_extract_all(text, '\\\[')) + len(regexp_extract_all(text, '\$[^$]+\$')) AS equation_count,
                   list_sort(list_distinct(regexp_extract_all(text, '(?i)fig\.?\s*(\d+(?:-\d+)?)', 1) || regexp_extract_all(text, '(?i)figure\s+(\d+(?:-\d+)?)', 1))) AS figs,
                   list_sort(list_distinct(
                     list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: regexp_matches(w, '^\p{{Lu}}.{{3,}}$') AND regexp_matches(w, '\p{{Ll}}'))
                     || list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z]{{2,}}$') OR regexp_matches(w, '.(ness|tion|ment|ity)$'))))[1:10] AS kw
            FROM {MIXED_SQL})
        SELECT id, equation_count, equation_count > 0 AS has_equations, coalesce(array_to_string(figs, '|'), '') AS figures, coalesce(array_to_string(kw, '|'), '') AS keywords,
               CASE WHEN equation_count > 0 AND len(figs) > 0 THEN 'mixed' WHEN equation_count > 0 THEN 'equation' WHEN len(figs) > 0 THEN 'figure' ELSE 'text' END AS chunk_type,
               coalesce(nullif(regexp_extract(text, '\$\$([^$]+)\$\$', 1), ''), nullif(regexp_extract(text, '\$([^$]+)\$', 1), '')) AS latex_source,
               len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS token_count
        FROM e""",
    "markdown_sections": rf"""
        WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {MARKDOWN_SQL})
        SELECT id, CAST(line AS BIGINT) AS line, length(regexp_extract(row, '^(#{{1,6}})\s+', 1)) AS level, regexp_extract(row, '^#{{1,6}}\s+(.+)$', 1) AS title
        FROM l WHERE regexp_matches(row, '^#{{1,6}}\s+.+$')""",
    "section_asof": rf"""
        WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {MARKDOWN_SQL}),
        h AS (SELECT id, line, length(regexp_extract(row, '^(#{{1,6}})\s+', 1)) AS level, regexp_extract(row, '^#{{1,6}}\s+(.+)$', 1) AS title FROM l WHERE regexp_matches(row, '^#{{1,6}}\s+.+$'))
        SELECT l.id, CAST(l.line AS BIGINT) AS line, coalesce(string_agg(h.title, ' > ' ORDER BY h.level), '') AS path
        FROM l LEFT JOIN h ON h.id = l.id AND h.line <= l.line
          AND NOT EXISTS (SELECT 1 FROM h x WHERE x.id = h.id AND x.line > h.line AND x.line <= l.line AND x.level <= h.level)
        GROUP BY l.id, l.line""",
    "entities_dictionary": rf"""
        WITH t AS (SELECT CAST(id AS BIGINT) AS id, text FROM {values_sql(ENTITIES, 'id, text')} UNION ALL SELECT doc_id + 1000, text FROM documents)
        SELECT id, coalesce(array_to_string(list_sort(list_filter({_names(D.COMPANIES)}, lambda n: regexp_matches(lower(text), '\b' || lower(n) || '\b'))), '|'), '') AS companies,
               coalesce(array_to_string(list_sort(list_filter({_names(D.TECHNOLOGIES)}, lambda n: contains(lower(text), lower(n)))), '|'), '') AS technologies,
               coalesce(array_to_string(list_sort(list_filter({_names(D.PEOPLE)}, lambda n: contains(text, n))), '|'), '') AS people,
               coalesce(array_to_string(list_sort(list_filter({_names(D.LOCATIONS)}, lambda n: contains(text, n))), '|'), '') AS locations FROM t""",
    "entities_pattern": f"""
        WITH r AS (SELECT CAST(id AS BIGINT) AS id, text FROM {values_sql(ENTITIES, 'id, text')} UNION ALL SELECT doc_id + 1000, text FROM documents),
        m AS (SELECT id, regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g') AS text FROM r)
        SELECT id, coalesce(array_to_string(list_sort(list_distinct({_matches_sql(D.COMPANY_PATTERNS)})), '|'), '') AS companies, coalesce(array_to_string(list_sort(list_distinct({_matches_sql(D.TECHNOLOGY_PATTERNS)})), '|'), '') AS technologies FROM m""",
    "episode_truncate": """
        WITH h AS (SELECT doc_id, source, text, substr(text, 1, 6000) AS head FROM documents),
        e AS (SELECT *, greatest(CASE WHEN instr(reverse(head), ' .') > 0 THEN 6000 - instr(reverse(head), ' .') - 1 ELSE -1 END,
                                 CASE WHEN instr(reverse(head), ' !') > 0 THEN 6000 - instr(reverse(head), ' !') - 1 ELSE -1 END,
                                 CASE WHEN instr(reverse(head), ' ?') > 0 THEN 6000 - instr(reverse(head), ' ?') - 1 ELSE -1 END) AS cut FROM h),
        c AS (SELECT doc_id, source, CASE WHEN length(text) <= 6000 THEN text WHEN cut > 4200 THEN substr(head, 1, cut + 1) || ' [TRUNCATED]' ELSE head || '... [TRUNCATED]' END AS content FROM e),
        f AS (SELECT doc_id, CASE WHEN source <> '' AND length(content) < 5900 THEN '[Doc: ' || substr(source, 1, 50) || ']' || chr(10) || chr(10) || content ELSE content END AS out FROM c)
        SELECT doc_id, length(out) AS n, md5(out) AS digest FROM f""",
    "title_frontmatter": rf"""
        SELECT CAST(id AS INTEGER) AS id, coalesce(trim(substr(trim(list_filter(string_split(text, chr(10))[1:10], lambda x: starts_with(trim(x), '# '))[1]), 3)), regexp_replace(file, '\.[^.]*$', '')) AS title,
               nullif(regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1), '') AS frontmatter, len(string_split(text, chr(10))) AS line_count
        FROM {FRONTS.sql()}""",
    "parser_fallback": rf"""
        WITH p AS (SELECT CAST(id AS INTEGER) AS id, CASE WHEN length(trim(a)) >= 100 THEN a WHEN length(trim(b)) >= 100 THEN b END AS content FROM {PARSED.sql()})
        SELECT id, length(content) AS n, content IS NULL AS failed FROM p""",
    "project_detect": rf"""
        WITH f AS (SELECT *, file LIKE '%.tex' AS tex, row_number() OVER (PARTITION BY dir, file LIKE '%.tex' ORDER BY file) AS i FROM {FILES_SQL}),
        g AS (SELECT dir, count(*) FILTER (tex) AS n_tex, bool_or(file LIKE '%.cls') AS has_class, bool_or(tex AND i <= 3 AND regexp_matches(text, '\\myexternaldocument|\\input')) AS has_links FROM f GROUP BY dir)
        SELECT *, n_tex >= 3 AND (has_class OR has_links) AS is_project FROM g""",
    "chapter_info": rf"""
        SELECT dir, file, CAST(nullif(regexp_extract(file, 'Ch(\d+)_.*\.tex', 1), '') AS INTEGER) AS number, nullif(regexp_extract(text, '\\chapter(?:\[[^\]]*\])?\{{([^}}]+)\}}', 1), '') AS title,
               contains(lower(file), 'app') AS is_appendix, (length(text) - length(replace(text, '$', ''))) + (length(text) - length(replace(text, '\begin{{equation}}', ''))) // 16 > 10 AS has_equations
        FROM {FILES_SQL}""",
    "xref_degrees": rf"""
        WITH e AS (SELECT dir, file AS src, unnest(regexp_extract_all(text, '\\myexternaldocument\{{([^}}]+)\}}', 1)) AS dst FROM {FILES_SQL})
        SELECT dir, src, count(*) AS out_degree, string_agg(dst, '|' ORDER BY dst) AS targets FROM e GROUP BY dir, src""",
    "html_to_text": r"""
        WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages),
        u AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS x FROM t)
        SELECT page_id, length(x) AS n, md5(x) AS digest FROM u""",
    "format_sizes": f"""
        SELECT CAST(n AS BIGINT) AS n,
               CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
                    WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size,
               CASE WHEN n < 1000 THEN printf('%.0fms', n::DOUBLE) WHEN n < 60000 THEN printf('%.1fs', n / 1000.0::DOUBLE) ELSE printf('%.1fmin', n / 60000.0::DOUBLE) END AS time
        FROM (SELECT DISTINCT n FROM {SIZED.sql()})""",
    "token_estimate": "SELECT lang, count(*) AS n_docs, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(avg(length(text) // 4), 6) AS avg_tokens FROM documents GROUP BY lang",
}
