"""Column functions over text: structure of LaTeX and markdown, keywords, cleaning.

Everything here is a Column expression that Spark compiles; no Python runs on
rows. Classes are spelled out (`[\\p{L}\\p{N}_]`) since `\\w` and `\\b` mean
ASCII in Java and Unicode elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: What stands between two tokens.
BETWEEN = r"[^\p{L}\p{N}_-]+"

# The kinds of equation and their patterns, and the kinds of heading.
EQUATION_KINDS = {
    "inline": r"\$([^$]+?)\$",
    "display": r"(?s)\$\$(.+?)\$\$",
    "equation": r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}",
    "equation*": r"(?s)\\begin\{equation\*\}(.+?)\\end\{equation\*\}",
    "align": r"(?s)\\begin\{align\}(.+?)\\end\{align\}",
    "align*": r"(?s)\\begin\{align\*\}(.+?)\\end\{align\*\}",
    "eqnarray": r"(?s)\\begin\{eqnarray\}(.+?)\\end\{eqnarray\}",
    "gather": r"(?s)\\begin\{gather\}(.+?)\\end\{gather\}",
}
HEADINGS = {"chapter": "#", "section": "##", "subsection": "###", "subsubsection": "####", "paragraph": "#####"}
BALANCED = ("array", "matrix", "align", "equation")


def occurrences(text: Column, needle: str) -> Column:
    """How often a plain string occurs, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern (or of one of its groups)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# --- tokens ---------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case words: what is neither letter, digit, underscore, hyphen nor white space separates."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def words(text: Column) -> Column:
    """The tokens of a text as one text, a space between any two; one may stand at either end."""
    return F.regexp_replace(F.lower(text), BETWEEN, " ")


def normalize_whitespace(text: Column) -> Column:
    """At most one blank line, single spaces, nothing at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " +", " "), r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """About four characters to a token."""
    return F.floor(F.char_length(text) / 4).cast("long")


def title(text: Column, fallback: Column) -> Column:
    """The first `# ` heading of the first ten lines, else the fallback."""
    heads = F.filter(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.startswith(F.trim(x), F.lit("# ")))
    return F.coalesce(F.trim(F.substring(F.trim(F.get(heads, F.lit(0))), 3, 1 << 30)), fallback)


def frontmatter(text: Column) -> Column:
    """The block between leading `---` lines, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1), F.lit(""))


def truncated_episode(text: Column, doc_title: Column, most: int = 6000) -> Column:
    """Long texts end at a sentence end in their last 30 %, or with dots; a title goes before texts with room for it."""
    head = F.substring(text, 1, most)
    back = F.reverse(head)

    def last(mark: str) -> Column:
        at = F.instr(back, " " + mark)
        return F.when(at > 0, most - at - 1).otherwise(-1)  # counted from 0

    end = F.greatest(last("."), last("!"), last("?"))
    cut = F.when(end > most * 0.7, F.concat(F.substring(head, F.lit(1), end + 1), F.lit(" [TRUNCATED]"))).otherwise(F.concat(head, F.lit("... [TRUNCATED]")))
    content = F.when(F.char_length(text) > most, cut).otherwise(text)
    named = F.concat(F.lit("[Doc: "), F.substring(doc_title, 1, 50), F.lit("]\n\n"), content)
    return F.when((doc_title != "") & (F.char_length(content) < most - 100), named).otherwise(content)


# --- LaTeX ----------------------------------------------------------------------------


def strip_comments(text: Column) -> Column:
    """Lines end at their first `%` without a backslash before it; blank lines go."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?<!\\)%.*$", ""))
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"\s", "") != ""), "\n")


def equation_counts(text: Column) -> dict[str, Column]:
    return {kind: F.size(matches(text, pattern, 1)).cast("long") for kind, pattern in EQUATION_KINDS.items()}


def references(text: Column) -> Column:
    return sorted_set(matches(text, r"\\ref\{([^}]+)\}", 1))


def citations(text: Column) -> Column:
    """Cited keys; one command may name several, divided by commas."""
    parts = F.transform(matches(text, r"\\cite\{([^}]+)\}", 1), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))
    return sorted_set(F.flatten(parts))


def to_markdown(text: Column) -> Column:
    """The document's body with headings, `$$` blocks for equation environments, and simple commands unwrapped."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\\begin\{document\}(.+?)\\end\{document\}", 1), F.lit("")), text)
    for name, marks in HEADINGS.items():
        body = F.regexp_replace(body, r"\\" + name + r"(?:\[([^\]]+)\])?\{([^}]+)\}", "\n" + marks + " $2\n")
    body = F.regexp_replace(body, r"(?s)\\begin\{equation\}\s*(.+?)\s*\\end\{equation\}", "\n\\$\\$\n$1\n\\$\\$\n")
    body = F.regexp_replace(body, r"\\label\{[^}]+\}", "")
    return F.regexp_replace(body, r"\\[a-zA-Z]+\{([^}]+)\}", "$1")


def detected_equations(text: Column) -> Column:
    """Display and environment starts plus inline matches; `$$x$$` counts as both."""
    patterns = (r"\$\$[^$]+\$\$", r"\\begin\{equation\}", r"\\begin\{align\}", r"\\\[", r"\$[^$]+\$")
    return reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(p)) for p in patterns)).cast("long")


def figure_references(text: Column) -> Column:
    found = F.concat(matches(text, r"(?i)fig\.?\s*(\d+(?:-\d+)?)", 1), matches(text, r"(?i)figure\s+(\d+(?:-\d+)?)", 1))
    return sorted_set(found)


def keywords(text: Column, most: int = 10) -> Column:
    """Capitalised words of over three letters that aren't all capitals, acronyms, and words of technical endings; the first in order."""
    joined = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+")
    capital = F.filter(joined, lambda w: F.rlike(w, F.lit(r"^\p{Lu}(?=.*\p{Ll}).{3,}$")))
    edge = r"(?<![\p{L}\p{N}_])"
    special = matches(text, edge + r"(?:[A-Z]{2,}|[\p{L}\p{N}_]+(?:ness|tion|ment|ity))(?![\p{L}\p{N}_])")
    return F.slice(sorted_set(F.concat(capital, special)), 1, most)


def chunk_type(equations: Column, figures: Column) -> Column:
    has_equations, has_figures = equations > 0, F.size(figures) > 0
    return F.when(has_equations & has_figures, "mixed").when(has_equations, "equation").when(has_figures, "figure").otherwise("text")


def first_latex(text: Column) -> Column:
    """The first display equation, else the first inline one, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"\$\$([^$]+)\$\$", r"\$([^$]+)\$")))


# --- LaTeX repair ---------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _where(x: Column, part: str, then: Column) -> Column:
    """`then` of a text that has a part without which `then` would change nothing; a plain search costs less than a pattern."""
    return F.when(F.contains(x, F.lit(part)), then).otherwise(x)


def _close(text: Column, opened: Column, closed: Column, tail: str) -> Column:
    return F.concat(text, F.repeat(F.lit(tail), F.greatest(opened - closed, F.lit(0))))


def _closed_environment(env: str):
    begin, end = f"\\begin{{{env}}}", f"\\end{{{env}}}"
    return lambda x: _where(x, begin, _close(x, occurrences(x, begin), occurrences(x, end), " " + end))


def _closed_delimiters(x: Column) -> Column:
    left, right = occurrences(x, "\\left"), occurrences(x, "\\right")
    closed = F.concat(F.repeat(F.lit("\\left. "), F.greatest(right - left, F.lit(0))), _close(x, left, right, " \\right."))
    return F.when(F.contains(x, F.lit("\\left")) | F.contains(x, F.lit("\\right")), closed).otherwise(x)


def _without_open_end(x: Column) -> Column:
    return F.when(F.endswith(x, F.lit("\\")) & ~F.endswith(x, F.lit("\\\\")), F.regexp_replace(x, r"\\$", "")).otherwise(x)


def _balanced_braces(x: Column) -> Column:
    opened, closed = occurrences(x, "{"), occurrences(x, "}")
    spare = F.when(closed > opened, F.least(closed - opened, F.char_length(F.regexp_extract(x, r"\}*$", 0)))).otherwise(0)
    return F.when(opened == closed, x).otherwise(F.concat(F.substring(x, F.lit(1), F.char_length(x) - spare), F.repeat(F.lit("}"), F.greatest(opened - closed, F.lit(0)))))


def _trimmed(x: Column) -> Column:
    """Without white space at the ends; a line's end of another kind may stand after that which goes, so the last two characters tell."""
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -2, 2))
    return F.when(F.rlike(ends, F.lit(r"\s")), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(x)


def _clean_once(x: Column) -> Column:
    replaced = lambda part, pattern, short: lambda x: _where(x, part, F.regexp_replace(x, pattern, short))
    steps = [replaced("\\def\\", r"\\def\\([a-zA-Z]+)\{\\\1\}", ""), lambda x: F.regexp_replace(x, r"(.)\1{50,}", "$1$1$1"), *map(_closed_environment, BALANCED), _closed_delimiters]
    steps += [replaced("\\frac", r"\\frac\s*\{([^}]*)\}\s*$", r"\\frac{$1}{}"), replaced("_", r"_\s*$", ""), replaced("^", r"\^\s*$", ""), _without_open_end, replaced("\\\\", r"\\\\\s*$", ""), _balanced_braces]
    steps += [replaced("  ", "  +", " "), replaced("{", r"\{\s+", "{"), replaced("}", r"\s+\}", "}"), _trimmed]
    for step in steps:
        x = _let(x, step)
    return x


def clean_latex_step(text: Column) -> Column:
    """One round of repair; `operators.documents.clean_latex` applies three."""
    return _let(text, lambda x: F.when(x.isNull() | (x == ""), x).otherwise(_clean_once(x)))


def latex_error(text: Column) -> Column:
    """Why an expression is invalid, or null if it is valid; the first check that fails tells."""
    opened, closed = occurrences(text, "{"), occurrences(text, "}")
    out = F.when(text.isNull() | (text == ""), "Empty or invalid input")
    out = out.when(opened != closed, F.format_string("Unbalanced braces: %d open, %d close", opened, closed))
    for env in BALANCED:
        begin, end = occurrences(text, f"\\begin{{{env}}}"), occurrences(text, f"\\end{{{env}}}")
        out = out.when(F.contains(text, F.lit(f"{{{env}}}")) & (begin != end), F.format_string(f"Unbalanced {env} environment: %d begin, %d end", begin, end))
    left, right = occurrences(text, "\\left"), occurrences(text, "\\right")
    out = out.when((F.contains(text, F.lit("\\left")) | F.contains(text, F.lit("\\right"))) & (left != right), F.format_string("Unbalanced \\left/\\right: %d left, %d right", left, right))
    some = F.contains(text, F.lit("_")) | F.contains(text, F.lit("^")) | F.contains(text, F.lit("\\"))
    out = out.when(some & F.rlike(text, F.lit(r"[_^\\]\s*$")), "Incomplete command at end")
    out = out.when(F.rlike(text, F.lit(r"(.)\1{100,}")), "Excessive character repetition (possible infinite loop)")
    return out.when(F.char_length(text) > 5000, F.format_string("LaTeX too long (%d chars, max 5000)", F.char_length(text)))


# --- HTML and display -----------------------------------------------------------------


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, common entities are decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^\s+|\s+$", "")


def format_size(n: Column) -> Column:
    """Bytes in the largest unit of at least one."""
    out = F.when(n < 1024, F.format_string("%.1f B", n.cast("double")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", n / 1024.0**i))
    return out.otherwise(F.format_string("%.1f TB", n / 1024.0**4))


def format_millis(ms: Column) -> Column:
    """Milliseconds, seconds or minutes."""
    ms = ms.cast("double")
    return F.when(ms < 1000, F.format_string("%.0fms", ms)).when(ms < 60000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%.1fmin", ms / 60000))
