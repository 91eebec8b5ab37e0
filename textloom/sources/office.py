"""Word documents and the text layer of PDF files, read in bulk.

Files come from Spark's binary reader, so any file system it knows will do and
a scan has as many tasks as it has splits of files; what can't be read is a row
with an error, not a failed job. Only the standard library is needed. PDF text
is what content streams show in fonts of a Latin encoding; scanned pages have
none, and files with a password are errors.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from ..operators.parallel import sliced

# The namespace of Word's XML, and names of its parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = "word/document.xml"

PARSED = StructType().add("text", StringType()).add("error", StringType())


# --- Word -----------------------------------------------------------------------------


def _paragraph(p: ElementTree.Element) -> str:
    parts = []
    for node in p.iter():
        if node.tag == W + "t":
            parts.append(node.text or "")
        elif node.tag in (W + "br", W + "cr"):
            parts.append("\n")
        elif node.tag == W + "tab":
            parts.append("\t")
    style = p.find(f"{W}pPr/{W}pStyle")
    level = re.fullmatch(r"Heading([1-6])", style.get(W + "val", "")) if style is not None else None
    return ("#" * int(level[1]) + " " if level else "") + "".join(parts)


def docx_text(data: bytes) -> str:
    """Paragraphs as lines, headings with #, rows of tables between bars, in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open(BODY) as body:
        root = ElementTree.parse(body).getroot().find(W + "body")
    lines = []
    for node in root if root is not None else ():
        if node.tag == W + "p":
            lines.append(_paragraph(node))
        elif node.tag == W + "tbl":
            for row in node.iter(W + "tr"):
                lines.append("| " + " | ".join(" ".join(_paragraph(p) for p in cell.iter(W + "p")) for cell in row.iter(W + "tc")) + " |")
    return "\n".join(lines)


def docx_bytes(text: str) -> bytes:
    """A Word document with a paragraph for each line; lines of one to six # and a space are headings. Characters that XML doesn't have are left out."""
    out = []
    for line in re.sub(r"[^\t\n\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", text).split("\n"):
        head = re.match(r"(#{1,6}) ", line)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(head[1])}"/></w:pPr>' if head else ""
        out.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line[head.end() :] if head else line)}</w:t></w:r></w:p>')
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(out)}</w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(zipfile.ZipInfo(BODY), body.encode())
    return held.getvalue()


# --- PDF ------------------------------------------------------------------------------

_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|[-+.\d]+|/[^\s/<>\[\]()]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    whole = re.sub(rb"\\(\r\n|[0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return whole


def _shown(content: bytes) -> str:
    """The text that a content stream shows; a move to another line is a line end, a wide gap a space."""
    out: list[str] = []
    operands: list = []
    depth = False
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.S):
        for token in _TOKEN.findall(block):
            if token[:1] in b"(<":
                operands.append(_string(token).decode("latin-1"))
            elif token == b"[":
                depth = True
            elif token == b"]":
                depth = False
            elif token[:1] in b"+-.0123456789":
                try:
                    number = float(token)
                except ValueError:
                    continue
                operands.append(" " if depth and number < -200 else number)
            elif token[:1] != b"/":
                if token in (b"Tj", b"TJ"):
                    out += [x for x in operands if isinstance(x, str)]
                elif token in (b"'", b'"'):
                    out += ["\n", *(x for x in operands if isinstance(x, str))]
                elif token == b"T*" or token in (b"Td", b"TD") and len(operands) > 1 and operands[-1] != 0:
                    out.append("\n")
                operands = []
        out.append("\n")
    return "".join(out).strip("\n")


def pdf_text(data: bytes) -> str:
    """The text layer, page streams in the order of the file with a blank line between them."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\b", data):
        raise ValueError("the file has a password")
    pages = []
    for match in _STREAM.finditer(data):
        about, start = match[1], match.end()
        length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", about)
        stop = start + int(length[1]) if length else data.find(b"endstream", start)
        body = data[start : stop if stop >= 0 else len(data)]
        if re.search(rb"/(Image|XRef|ObjStm|FontFile\d?)\b", about) or b"/Filter" in about and b"/FlateDecode" not in about:
            continue
        if b"/FlateDecode" in about:
            body = zlib.decompressobj().decompress(body)
        if text := _shown(body):
            pages.append(text)
    return "\n\n".join(pages)


# --- in bulk --------------------------------------------------------------------------

READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf_text}


def parsed(content: Column, kind: str) -> Column:
    """text and error of each file's bytes by the reader of a kind; null bytes have neither."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {sorted(READERS)}")
    reader = READERS[kind]

    def read(files: pa.Array) -> pa.Array:
        texts, errors = [], []
        for data in files:
            text = error = None
            if data.is_valid:
                try:
                    text = reader(data.as_py())
                except Exception as failure:  # a damaged file may fail in any way
                    error = f"{type(failure).__name__}: {failure}"
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return F.arrow_udf(sliced(read), PARSED)(content)


def read_office(spark: SparkSession, path: str, kind: str, recursive: bool = True) -> DataFrame:
    """path, name, size, text, error of each file of a kind below `path`."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {sorted(READERS)}")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), parsed(F.col("content"), kind).alias("p"))
    return rows.select("path", "name", "size", "p.text", "p.error")


def as_docx(text: Column) -> Column:
    """Each text as the bytes of a Word document; null stays null."""

    def make(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else docx_bytes(t) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(sliced(make), BinaryType())(text)

