"""Word and PDF files against what was put into them."""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import chunking, models
from textloom.plans import file_queries
from textloom.sources import office

from conftest import SMALL


def pdf(*pages: bytes, packed=True, about=b""):
    out = [b"%PDF-1.4\n"]
    for i, page in enumerate(pages):
        body = zlib.compress(page) if packed else page
        out.append(b"%d 0 obj\n<< /Length %d %s %s>>\nstream\n" % (i + 3, len(body), b"/Filter /FlateDecode" if packed else b"", about) + body + b"\nendstream\nendobj\n")
    return b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* <c9742065> Tj ET q 1 0 0 1 0 0 cm Q BT (next \\ block\
 goes on) Tj ET"
    assert office.pdf_text(pdf(one, b"BT (page two) Tj 10 0 Td (same line) Tj ET", packed=packed)) == "\nHello (big) world\nsecond line\nÉt e\nnext \\ block goes on".lstrip("\n") + "\n\npage twosame line"


def test_pdf_errors():
    for data, message in ((b"plain", "not a PDF"), (pdf(b"BT (x) Tj ET") + b"/Encrypt 5 0 R", "password")):
        with pytest.raises(ValueError, match=message):
            office.pdf_text(data)
    assert office.pdf_text(pdf(b"\x00\xff", about=b"/Subtype /Image ")) == ""
    with pytest.raises(zlib.error):
        office.pdf_text(pdf(b"BT (x) Tj ET").replace(b"stream\nx", b"stream\nq"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\r"), max_size=200))
def test_docx_round_trip(text):
    kept = "".join(c for c in text if c in "\t\n" or " " <= c <= "퟿" or "" <= c <= "�" or c >= "\U00010000")
    assert office.docx_text(office.docx_bytes(text)) == kept


def test_docx_tables_and_headings():
    w = office.W[1:-1]
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc>{p("x")}</w:tc><w:tc>{p("y")}{p("z")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr(office.BODY, body)
    assert office.docx_text(held.getvalue()) == "## Head\na\tb\nc\n| x | y z |"


def test_folders_are_read_in_bulk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(office.docx_bytes("# Title\nline"))
    (tmp_path / "sub/b.docx").write_bytes(b"PK damaged")
    (tmp_path / "sub/c.pdf").write_bytes(pdf(b"BT (text) Tj ET"))
    got = {r["name"]: (r["text"], r["error"]) for r in office.read_office(spark, str(tmp_path), "docx").collect()}
    assert got["a.docx"] == ("# Title\nline", None) and got["b.docx"][0] is None and "BadZipFile" in got["b.docx"][1] and len(got) == 2
    assert [r["text"] for r in office.read_office(spark, str(tmp_path), "pdf").collect()] == ["text"]
    with pytest.raises(ValueError, match="no reader"):
        office.read_office(spark, str(tmp_path), "odt")


def test_null_and_long_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "é\n" * 300_000)], "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", office.parsed(office.as_docx(F.col("t")), "docx").alias("p")).collect()}
    assert got[1]["text"] is None and got[1]["error"] is None and got[2]["text"] == "" and got[3]["text"] == "é\n" * 300_000


def test_truncated_embeddings(spark):
    got = {r["doc_id"]: r for r in file_queries.QUERIES["truncated_embeddings"](spark, SMALL).collect()}
    embed = models.hashing_embedder()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        short = np.array(embed(pd.Series([r["text"] if r["doc_id"] % 10 else ""]))[0])[:16]
        assert got[r["doc_id"]]["dims"] == 16 and got[r["doc_id"]]["norm"] == pytest.approx(float(np.linalg.norm(short) > 0), abs=1e-3)


# --- chunkers against plain versions --------------------------------------------------


def plain_packed(parts, size, most):
    out, held, n = [], "", 0
    for part in (p for p in parts if p):
        k = size(part)
        if n and n + k > most:
            out.append(held)
            held, n = "", 0
        held, n = held + part, n + k
    return [*out, held] if held else out


def plain_recursive(text, most):
    """Coarsest break first, as text pieces."""
    import re

    if not text or len(text.split()) <= most and len(text) <= 16 * most:
        return [text] if text else []
    for pattern in (r"\n+", r"[.!?]+\s+", r"[,;:]\s+", r"\s+"):
        ends = [0, *(m.end() for m in re.finditer(pattern, text)), len(text)]
        packed = plain_packed([text[a:b] for a, b in zip(ends, ends[1:])], lambda t: len(t.split()), most)
        pieces = [x for p in packed for x in ([p] if p == text else plain_recursive(p, most))]
        if len(pieces) > 1:
            return pieces
    return plain_recursive(text[: len(text) // 2], most) + plain_recursive(text[len(text) // 2 :], most)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Two words. ", "a, b; c: ", "\n", "\n\n", "x" * 40 + " ", "! ", "é ", "y" * 200, "   "]), max_size=60).map("".join), st.sampled_from([3, 7, 20]))
def test_recursive_chunks(text, most):
    assert [text[a:b] for a, b in chunking.recursive_spans(text, most)] == plain_recursive(text, most)


def plain_structural(text, most, window):
    import re

    marks = [0, *(m.start() for m in re.finditer(r"(?m)^(?:#{1,6}\s|[-*+]\s|\d+\.\s|```|\||---+\s*$)|\n\s*\n", text) if m.start()), len(text)]
    out = []
    for part in plain_packed([text[a:b] for a, b in zip(marks, marks[1:])], len, most):
        while len(part) > most:
            stops = [i for i in range(max(1, most - window), most) if part[i] in ".!?\n"]
            end = stops[-1] + 1 if stops else most
            out.append(part[:end])
            part = part[end:]
        out += [part] if part else []
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "- item\n", "1. one\n", "plain words. ", "more words ", "\n\n", "```\n", "| a | b |\n", "---\n", "z" * 70, "\n"]), max_size=60).map("".join), st.sampled_from([50, 120]))
def test_structural_chunks(text, most):
    assert [text[a:b] for a, b in chunking.structural_spans(text, most, 20)] == plain_structural(text, most, 20)
