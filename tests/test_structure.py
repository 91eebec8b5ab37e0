"""Structure, chunkers, retrieval, prompts and stores against plain versions and literal cases."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import chunking, documents, evaluation, latex, lexical, models, monitoring, prompts, relational

BOOK = "\\documentclass{book}\n\\title{A {nested} title}\n\\section[s]{One}\n\\label{sec:one}\ntext $a$ $$b$$\n\\begin{equation}\\label{eq:x}\nc\n\\end{equation}\n\\begin{figure}\\caption{Cap}\\end{figure}\\section*{No}"


def random_text(seed, n=60):
    r = random.Random(seed)
    parts = []
    for _ in range(n):
        words = " ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 40)))
        parts.append(r.choice(["", "# Head\n", "- item\n", "1. one\n", "## Deep er\n\n"]) + words + r.choice([". ", "! ", "?\n", "\n\n", "; ", ", ", "\n"]))
    return "".join(parts)


def greedy(parts, size, most):
    out, held = [], ""
    for p in parts:
        if held and size(held) + size(p) > most:
            out.append(held)
            held = ""
        held += p
    return [*out, held] if held else out


@pytest.mark.parametrize("seed", range(6))
def test_sentence_chunks_equal_a_plain_loop(seed):
    text = random_text(seed)
    parts = re.findall(r"(?s).*?[.!?]+\s+|.+\Z", text)
    assert "".join(parts) == text
    assert [text[a:b] for a, b in chunking.sentence_spans(text)] == greedy(parts, chunking.words_in, 200)


@pytest.mark.parametrize("seed", range(6))
def test_paragraph_chunks_equal_a_plain_loop(seed):
    text = random_text(seed)
    parts = re.findall(r"(?s).*?\n\s*\n|.+\Z", text)
    assert [text[a:b] for a, b in chunking.paragraph_spans(text)] == greedy(parts, len, 1000)


@pytest.mark.parametrize("seed", range(6))
def test_sliding_chunks_equal_a_plain_loop(seed):
    text = random_text(seed)
    want, start = [], 0
    while True:
        end = min(start + 1000, len(text))
        if end < len(text):
            for at in range(end - 1, max(start, end - 200 - 1), -1):
                if text[at] in ".!?\n" and at >= max(start + 1, end - 200):
                    end = at + 1
                    break
        want.append((start, end))
        if end == len(text):
            break
        start = max(end - 100, start + 1)
    assert chunking.sliding_spans(text) == want
    tail = chunking.sliding_tail_spans(text)
    assert tail[:-1] == want and tail[-1] == (len(text) - 100, len(text))


@pytest.mark.parametrize("seed", range(6))
def test_recursive_and_structural_chunks_keep_their_bounds(seed):
    text = random_text(seed)
    spans = chunking.recursive_spans(text)
    assert "".join(text[a:b] for a, b in spans) == text and all(chunking.words_in(text[a:b]) <= 200 for a, b in spans)
    marks = [0, *(m.start() for m in re.finditer(r"(?m)^(?:#{1,6}\s|[-*+]\s|\d+\.\s|```|\||---+\s*$)|\n\s*\n", text) if m.start())]
    spans = chunking.structural_spans(text)
    assert all(b - a <= 1000 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    parts = [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]
    if all(len(p) <= 1000 for p in parts):
        assert [text[a:b] for a, b in spans] == greedy(parts, len, 1000)


def test_hybrid_chunks_stand_under_their_headings(spark):
    text = "intro\n# A\n\none\n\n## B\n" + "word " * 700 + "\n# C\nlast"
    rows = chunking.hybrid(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), most=300).orderBy("chunk_index").collect()
    assert [r["heading_path"] for r in rows] == ["", "A", "A > B", "A > B", "A > B", "A > B", "C"]
    assert all(r["token_count"] <= 300 and r["content"] == text[r["start_char"] : r["end_char"]] for r in rows)
    assert rows[1]["contextual"].startswith("A\n# A")


def test_parsed_chunks_carry_metadata(spark):
    docs = spark.createDataFrame([(1, "Some words here. " * 200, "en"), (2, "short", None)], "doc_id long, text string, lang string")
    rows = chunking.parsed(docs, ["lang"], overlap=3).collect()
    assert {r["metadata"] for r in rows if r["doc_id"] == 1} == {'{"lang":"en"}'} and [r["metadata"] for r in rows if r["doc_id"] == 2] == ["{}"]
    assert [r["content"] for r in rows if r["doc_id"] == 1 and r["chunk_index"] == 1][0].startswith("words here. ") or len(rows) > 2


# --- LaTeX ----------------------------------------------------------------------------


def plain_clean(x, rounds=3):
    """The repair as a plain function of a string."""
    for _ in range(rounds):
        if not x:
            return x
        x = re.sub(r"\\def\\([a-zA-Z]+)\{\\\1\}", "", x)
        x = re.sub(r"(.)\1{50,}", r"\1\1\1", x)
        for env in ("array", "matrix", "align", "equation"):
            lack = x.count(f"\\begin{{{env}}}") - x.count(f"\\end{{{env}}}")
            x += f" \\end{{{env}}}" * max(lack, 0)
        left, right = x.count("\\left"), x.count("\\right")
        x = "\\left. " * max(right - left, 0) + x + " \\right." * max(left - right, 0)
        x = re.sub(r"\\frac\s*\{([^}]*)\}\s*$", r"\\frac{\1}{}", x)
        x = re.sub(r"\^\s*$", "", re.sub(r"_\s*$", "", x))
        x = re.sub(r"\\\\\s*$", "", x)
        if x.endswith("\\") and not x.endswith("\\\\"):
            x = x[:-1]
        opened, closed = x.count("{"), x.count("}")
        x += "}" * max(opened - closed, 0)
        for _ in range(closed - opened):
            if x.endswith("}"):
                x = x[:-1]
        for pattern, short in (("  +", " "), (r"\{\s+", "{"), (r"\s+\}", "}")):
            x = re.sub(pattern, short, x)
        x = x.strip()
    return x


def latex_text(seed, n):
    r = random.Random(seed)
    bits = ["$a$", "$$ b. c $$", "$$x$$", "word. ", "So! ", "é ", "\n", "\\begin{equation}y. $z$\\end{equation}", "\\[ q \\]", "\\section{S}", "\\begin{align}u\\end{align}", "$", " "]
    return "".join(r.choice(bits) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_spans_against_plain_loops(spark, seed):
    texts = [latex_text(seed * 10 + i, 40) for i in range(6)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in frame.select("id", latex.boundaries(F.col("text")).alias("b"), latex.equation_contexts(F.col("text")).alias("c"), latex.all_spans(F.col("text"), {"inline": latex.INLINE}).alias("i")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i]["b"] is None and got[i]["c"] is None
            continue
        display = [m for p in latex.DISPLAY.values() for m in re.finditer(p, text)]
        inline = [m for m in re.finditer(latex.INLINE, text) if not any(d.start() <= m.start() < d.end() for d in display)]
        assert [(b["start"], b["stop"], b["kind"]) for b in got[i]["b"]] == sorted([(m.start(), m.end(), "display") for m in display] + [(m.start(), m.end(), "inline") for m in inline])
        want = []
        for m in display:
            before, after = re.split(r"[.!?]+\s+", text[: m.start()])[-2:], re.split(r"[.!?]+\s+", text[m.end() :])[:2]
            want.append((m.start(), m.end(), (" ".join(before) + " " + m[0] + " " + " ".join(after)).strip(" \t\n\x0b\f\r")))
        assert sorted(tuple(c) for c in got[i]["c"]) == sorted(want)
        assert [(s["start"], s["line"], s["before"], s["after"]) for s in got[i]["i"]] == [(m.start(), text.count("\n", 0, m.start()) + 1, text[max(0, m.start() - 100) : m.start()], text[m.end() : m.end() + 100]) for m in re.finditer(latex.INLINE, text)]


def test_spans_of_a_long_text_take_time_in_proportion(spark):
    def seconds(n):
        frame = spark.createDataFrame([("See $$q = V$$ and $a$. It is so. \n" * n,)], "text string")
        frame.select(F.size(latex.boundaries(F.col("text")))).collect()
        began = time.perf_counter()
        one = frame.select(F.size(latex.boundaries(F.col("text"))).alias("b"), F.size(latex.equation_contexts(F.col("text"))).alias("c"), F.size(latex.all_spans(F.col("text"), latex.DISPLAY)).alias("s")).first()
        assert one["b"] > n and one["c"] == one["s"] == n
        return time.perf_counter() - began

    short, long = (min(seconds(n) for _ in range(2)) for n in (20_000, 40_000))
    assert long < 2.5 * short + 0.5


def test_latex_repair_equals_a_plain_function(spark):
    r = random.Random(2)
    bits = ["\\frac{1}{2}", "{", "}", "\\begin{array}", "\\end{align}", "\\left(", "\\right)", "x_", "y^", "\\", " ", "   ", "a" * 60, "\\frac{3}", "\\def\\q{\\q}", "b", "\\begin{equation}"]
    rows = [("".join(r.choice(bits) for _ in range(r.randint(0, 9))),) for _ in range(400)]
    got = documents.clean_latex(spark.createDataFrame(rows, "x string"), "x").collect()
    assert [(g["x"], g["cleaned"]) for g in got] == [(x, plain_clean(x)) for (x,) in rows]


def test_formulas_keep_the_original_where_repair_fails(spark):
    rows = spark.createDataFrame([(1, "x", "o"), (2, "{x", "o"), (3, None, "o"), (4, "", "o"), (5, "y" * 6 + "}{" * 3000, "o")], "id int, read string, text string")
    assert {r["id"]: (r["latex"], r["status"]) for r in documents.enriched_formulas(rows, "id", "read", "text").collect()} == {1: ("x", "recognised"), 2: ("{x}", "repaired"), 3: ("o", "failed"), 4: ("o", "failed"), 5: ("o", "fallback")}


def test_latex_structure_of_a_small_book(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, ""), (3, None)], "id long, text string")
    front = {r["id"]: r for r in latex.front_matter(docs).collect()}
    assert front[1]["title"] == "A {nested" and front[1]["line_count"] == 9 and front[2]["line_count"] == 0 and front[3]["title"] is None
    assert [(r["level"], r["title"], r["short_title"], r["label"], r["line"]) for r in latex.sections(docs).collect()] == [("section", "One", "s", "sec:one", 3)]
    found = {(r["kind"], r["content"], r["label"], r["line"]) for r in latex.equations(docs).collect()}
    assert {("inline", "a", None, 5), ("display", "b", None, 5), ("equation", "\\label{eq:x}\nc", "eq:x", 6)} <= found
    for r in latex.equations(docs).collect():
        assert r["content"] in BOOK[r["start"] : r["stop"]]
    assert [(r["kind"], r["caption"], r["label"]) for r in latex.figures(docs).collect()] == [("figure", "Cap", None)]


def test_range_join_equals_all_pairs(spark):
    r = random.Random(3)
    points = [(r.choice("ab"), r.randint(0, 9000)) for _ in range(300)] + [("a", 4095), ("a", 4096)]
    ranges = [(r.choice("ab"), a, a + r.randint(0, 6000)) for a in (r.randint(0, 8000) for _ in range(60))] + [("a", 0, 4096), ("a", 4096, 4097)]
    got = latex.within(spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(ranges, "k string, start int, stop int"), "k").collect()
    want = sorted((k, at, a, b) for k, at in points for j, a, b in ranges if j == k and a <= at < b)
    assert sorted((x["k"], x["at"], x["start"], x["stop"]) for x in got) == want


# --- retrieval ------------------------------------------------------------------------


def test_holding_equals_a_search_of_all_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    r = random.Random(4)
    texts = [(x["doc_id"], x["text"]) for x in docs.collect()]
    asked = []
    for i in range(60):
        text = r.choice(texts)[1]
        at = r.randrange(max(1, len(text) - 5))
        asked.append((i, text[at : at + r.choice([1, 4, 15, 60, 300])]))
    asked += [(100, ""), (101, " "), (102, "zzz not there zzz"), (103, None), (104, texts[0][1])]
    got = {(x["query_id"], x["doc_id"]) for x in lexical.holding(spark.createDataFrame(asked, "query_id long, query string"), docs).collect()}
    assert got == {(i, d) for i, q in asked if q is not None for d, t in texts if q in t}


@pytest.mark.parametrize("filtered", [False, True])
def test_two_stage_equals_a_plain_version(spark, filtered):
    import pandas as pd

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 90")
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).limit(8)
    asked = asked.unionByName(spark.createDataFrame([(900, "explain the concept in chapter 2"), (901, "FEM stress beam equation on pages 10-20 with equations"), (902, "beam of page 16"), (903, "with figures")], "query_id long, query string"))
    given = spark.createDataFrame([(900, "chapter_3", None), (902, None, True)], "query_id long, document_id string, has_equations boolean")
    about = {}
    if filtered:
        docs = docs.withColumns({"document_id": F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("chapter_"), (F.col("doc_id") % 4).cast("string"))), "has_equations": F.col("doc_id") % 2 == 0, "page_number": (F.col("doc_id") % 30).cast("int")})
        about = {r["doc_id"]: r for r in docs.collect()}
    limits = {900: lambda r: r["document_id"] == "chapter_3", 901: lambda r: r["has_equations"] and 10 <= r["page_number"] <= 20, 902: lambda r: r["has_equations"] and r["page_number"] == 16}
    embed, depth = models.hashing_embedder(), 20
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    unit = {d: np.array(v) for d, v in zip(texts, embed(pd.Series(list(texts.values()))), strict=True)}
    told = {r["query_id"]: r for r in lexical.analyze(asked, "query").collect()}
    lexical_order: dict = {}
    for r in lexical.bm25(asked, docs, None).orderBy("rank").collect():
        lexical_order.setdefault(r["query_id"], []).append(r["doc_id"])
    want, wide_orders = {}, {}
    for r in asked.collect():
        i = r["query_id"]
        passes = lambda d: not filtered or i not in limits or bool(limits[i](about[d]))  # noqa: B023, E731
        vectors = [np.array(v) for v in embed(pd.Series([told[i]["expanded_query"], r["query"]]))]
        wide, cosine = ({d: round(float(v @ q), 6) for d, v in unit.items() if passes(d)} for q in vectors)
        wide_orders[i] = sorted(wide, key=lambda d: (-wide[d], d))[:depth]
        near = {d: n + 1 for n, d in enumerate(wide_orders[i])}
        own = {d: n + 1 for n, d in enumerate([d for d in lexical_order.get(i, []) if passes(d)][:depth])}
        w = 1 - told[i]["alpha"]
        fused = {d: round((w / (60 + near[d]) if d in near else 0) + ((1 - w) / (60 + own[d]) if d in own else 0), 9) for d in {*near, *own}}
        chosen = sorted(fused, key=lambda d: (-fused[d], d))[:depth]
        if chosen:
            want[i] = sorted(chosen, key=lambda d: (-cosine[d], d))[:10]
    near = {}
    for r in models.semantic_search(asked, docs, k=depth, given=given).orderBy("rank").collect():
        near.setdefault(r["query_id"], []).append(r["doc_id"])
    assert near == {i: order for i, order in wide_orders.items() if order}
    got: dict = {}
    for r in models.two_stage(asked, docs, depth=depth, given=given).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want and (not filtered or {900, 901, 902} <= set(got))


def test_best_sentence_equals_a_plain_loop(spark):
    cases = [("what is a beam", "A plate. A beam is long! What is it? "), ("x y", "none here. or here"), ("naïve été", "L'été est là. Naïve été."), ("q", "")]

    def plain(question, context):
        words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
        best = [(-len(set(words(s)) & set(words(question))), i, s.strip()) for i, s in enumerate(re.split(r"(?<=[.!?])\s+", context)) if s.strip()]
        return min(best)[2] if best else None

    rows = spark.createDataFrame(cases, "q string, c string").select("q", "c", models.best_sentence(F.col("q"), F.col("c")).alias("a")).collect()
    assert [r["a"] for r in rows] == [plain(q, c) for q, c in cases]


def test_hashing_embedder_equals_a_loop_over_words():
    import zlib

    import pandas as pd

    texts = ["a b a", "", None, "Été  naïve\tx", "word " * 50]
    for text, got in zip(texts, models.hashing_embedder(16)(pd.Series(texts)), strict=True):
        want = np.zeros(16)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            want[h % 16] += 1 if h >> 31 else -1
        n = np.linalg.norm(want)
        assert np.allclose(got, want / n if n else want, atol=1e-6)


def test_batches_that_fail_are_marked_and_taken_up_again(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string").coalesce(1)

    def broken(texts):
        raise OSError("no model")

    done = spark.createDataFrame([(0,)], "key long")
    rows = models.embedded_batches(docs, done, "text", "doc_id", embedder=broken).collect()
    assert {(r["key"], r["failed"], r["attempts"], r["vector"]) for r in rows} == {(str(i), True, 3, None) for i in range(1, 6)}
    assert models.embedded_batches(docs, done, "text", "doc_id").where("failed").count() == 0


def test_generators_take_over_from_each_other(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "query_id long, prompt string").coalesce(1)

    def broken(texts):
        raise OSError("no model")

    def picky(texts):
        return [None if t == "b" else f"picky {t}" for t in texts]

    got = {r["query_id"]: (r["answer"], r["provider"], r["attempts"], r["success"]) for r in models.generate(rows, {"x": broken, "y": picky, "z": lambda t: [f"last {v}" for v in t]}).collect()}
    assert got == {1: ("picky a", "y", 5, True), 2: ("last b", "z", 5, True), 3: ("picky ", "y", 5, True)}
    assert models.generate(rows, {"x": broken}, attempts=2).where("success OR answer IS NOT NULL OR attempts <> 2").count() == 0


def test_texts_are_reranked_by_pooled_vectors(spark):
    import pandas as pd

    texts = ["beam load stress", "stress of a beam", "cooking pasta", "", None]
    rows = spark.createDataFrame([(q, f"beam stress {q}", i, t) for q in (1, 2) for i, t in enumerate(texts)], "query_id int, query string, doc_id int, text string")
    embed = models.hashing_embedder()
    for q in (1, 2):
        unit = np.array(embed(pd.Series([f"beam stress {q}"]))[0])
        want = sorted(range(5), key=lambda i: (-round(float(np.array(embed(pd.Series([texts[i]]))[0]) @ unit), 6), i))[:3]
        assert [r["doc_id"] for r in models.rerank_texts(rows, 3).where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_chunkers_check_their_options(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five. Six.")], "doc_id long, text string")
    letters = lambda t: sum(c.isalpha() for c in t)
    assert [(r["content"], r["token_count"]) for r in chunking.split(docs, "sentences", most=12, size=letters).collect()] == [("One two. ", 6), ("Three four five. ", 13), ("Six.", 3)]
    for wrong in ({"most": 0}, {"most": 5, "overlap": 5}, {"overlap": -1}, {"words": 3}):
        with pytest.raises(ValueError):
            chunking.split(docs, "sliding", **wrong)


def test_max_sim_by_hand(spark):
    rows = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0], [1.0, 0.0]]), ([[3.0, 4.0]], [[0.0, 0.0]])], "q array<array<double>>, d array<array<double>>")
    assert [r["s"] for r in rows.select(models.max_sim(F.col("q"), F.col("d")).alias("s")).collect()] == [round(1 + 2**-0.5, 6), 0.0]


# --- prompts, filters, stores ---------------------------------------------------------


def test_prompts(spark):
    rows = spark.createDataFrame([("what?", ["one", "two"])], "q string, c array<string>")
    made = prompts.prompt("technical_qa", F.col("c"), question=F.col("q"))
    row = rows.select(made["system"].alias("system"), made["user"].alias("user")).first()
    assert "[Context 1]\none\n\n[Context 2]\ntwo" in row["user"] and "**Question:**\nwhat?" in row["user"] and "aerospace" in row["system"]
    bare = rows.select(prompts.prompt("technical_qa", F.col("c"), include_chunk_ids=False, question=F.col("q"))["user"].alias("u")).first()["u"]
    assert "one\n\ntwo" in bare and "[Context" not in bare
    steps = rows.select(prompts.prompt("procedural_steps", F.col("c"), include_validation=False, task=F.col("q"))["user"].alias("u")).first()["u"]
    assert "Common Pitfalls" not in steps
    pair = rows.select(prompts.prompt("comparative", F.col("c"), items=F.array(F.lit("a"), F.lit("b")))["user"].alias("u")).first()["u"]
    assert "a vs. b" in pair and "Focus Criteria" not in pair
    with pytest.raises(ValueError):
        prompts.prompt("equation_explanation", F.col("c"), question=F.col("q"))
    with pytest.raises(ValueError):
        prompts.prompt("poem", F.col("c"))


def test_filters(spark):
    rows = spark.createDataFrame([(1, "en", 5, '{"a": {"b": true}, "c": "x"}'), (2, "fr", 9, "{}"), (3, None, None, None)], "id int, lang string, n int, meta string")
    ids = lambda c: sorted(r["id"] for r in rows.where(c).collect())
    assert ids(relational.dict_filters({"lang": "en", "n": {"gte": 5, "lte": 6}})) == [1] and relational.dict_filters({}) is None
    assert ids(relational.contains_json(F.col("meta"), {"a": {"b": True}, "c": "x"})) == [1] and ids(relational.contains_json(F.col("meta"), {"a": {"b": False}})) == []
    assert ids(relational.contains_all_parts(F.col("lang"), "e n")) == [1]
    assert ids(relational.contains_all_terms(F.array("lang"), F.array())) == []
    with pytest.raises(ValueError):
        relational.dict_filters({"n": {"over": 3}})
    with pytest.raises(ValueError):
        relational.dict_filters({"x": 3}, ["n"])
    assert relational.checked_limit(99) == 50
    with pytest.raises(ValueError):
        relational.checked_limit(0)


def test_documents_and_chunks_are_appended_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, chunk_index int")
    for _ in range(2):  # a batch that runs again
        relational.append_documents(docs, chunks, str(tmp_path), "b1")
    chunks.write.parquet(f"{tmp_path}/chunks/batch=b2")  # a writer that died before its documents
    stored = relational.stored_chunks(spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/chunks"))
    assert stored.count() == 3 and spark.read.parquet(f"{tmp_path}/documents").count() == 2
    relational.emptied(docs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == docs.columns and spark.read.parquet(str(tmp_path / "t")).count() == 0


def test_masked_mean(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<double>>, m array<int>")
    assert [r["x"] for r in rows.select(V.masked_mean(F.col("t"), F.col("m")).alias("x")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_errors_are_captured_or_stop_the_job(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "{")], "id int, e string")
    got = {r["id"]: (r["value"], r["error"]) for r in relational.captured(rows, "id", F.upper("e"), T.latex_error(F.col("e"))).collect()}
    assert got[1] == ("X", None) and got[2][0] is None and "braces" in got[2][1]
    with pytest.raises(Exception, match="braces"):
        relational.captured(rows, "id", F.upper("e"), T.latex_error(F.col("e")), continue_on_error=False).collect()


def test_running_equals_a_plain_sum(spark):
    rows = spark.createDataFrame([(i + 1, i * 3 % 7) for i in range(200)], "position long, v long")
    got = {r["position"]: r["s"] for r in relational.running(rows, {"s": F.col("v")}, block=16).collect()}
    assert got == {i + 1: sum(j * 3 % 7 for j in range(i + 1)) for i in range(200)}


def test_metric_means_skip_what_is_not_measured(spark):
    scores = spark.createDataFrame([(1, 0.9, 0.0, 0.95, 0.9), (2, 0.8, 0.0, 0.9, 0.9)], "id int, context_precision double, context_recall double, faithfulness double, answer_relevancy double")
    row = evaluation.metric_means(scores).first()
    assert row["passed"] and row["n"] == 2
    assert not evaluation.metric_means(scores.withColumn("faithfulness", F.lit(0.5))).first()["passed"]


def test_alerts_before_any_cache_lookup(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 2, True), (3, 3, False)], "event_id long, position long, cache_hit boolean")
    got = {r["event_id"]: r["miss_pct"] for r in monitoring.with_cache_misses(rows).collect()}
    assert got == {1: 100.0, 2: 0.0, 3: 50.0}
    assert [r["event_id"] for r in monitoring.recent_alerts(monitoring.alerts(monitoring.with_cache_misses(rows), miss_pct=40.0), "INFO", 1).collect()] == [3]


def test_one_bad_text_costs_no_other_its_vector(spark):
    plain = models.hashing_embedder()

    def picky(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return plain(texts)

    docs = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    done = spark.createDataFrame([("5",)], "key string")
    got = {r["key"]: r for r in models.embedded_batches(docs, done, "text", "doc_id", attempts=2, embedder=picky, backoff=0.01).collect()}
    assert sorted(got) == ["0", "1", "2", "3", "4"] and [k for k, r in got.items() if r["failed"]] == ["3"] and got["3"]["vector"] is None
    assert all(r["vector"] is not None for k, r in got.items() if k != "3")
