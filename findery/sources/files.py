"""Files as a source: raw bytes with checksums, handlers by extension, insert if absent."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators.chunking import BLOCK_FIELDS, as_rows, block, markdown_blocks, plain_blocks


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, file_ext, file_size_bytes, sha256, content) of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", F.when(extension != "", F.concat(F.lit("."), extension)).alias("file_ext"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def new_only(incoming: DataFrame, known: DataFrame, checksum: str = "sha256") -> DataFrame:
    """One row of each content that is not known yet, the first by path."""
    first = incoming.groupBy(checksum).agg(F.min("path").alias("path"))
    return incoming.join(first, [checksum, "path"], "left_semi").join(known.select(checksum), checksum, "left_anti")


def _block(out: list[dict], kind: str, text: str, path: list[str], parent: int | None = None, level: int | None = None, **place: object) -> None:
    out.append(block(len(out), kind, text, path, level=level, parent=parent, **place))


def markdown_table(rows: list[list[object]]) -> str:
    """Rows as a Markdown table, the first as its head: short rows are padded, pipes escaped."""
    width = max(map(len, rows), default=0)
    lines = [[("" if c is None else str(c)).replace("|", r"\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]] for r in rows]
    if not width:
        return ""
    return "\n".join("| " + " | ".join(r) + " |" for r in [lines[0], ["---"] * width, *lines[1:]])


def _hwpx(content: bytes) -> list[dict]:
    """Top-level paragraphs and tables of each section of a zipped XML document, in order of section names."""
    out: list[dict] = []
    local = lambda e: e.tag.rpartition("}")[2]
    words = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t")

    def outer(e) -> Iterator:
        """Tables in no other table; one within a cell is text of that cell."""
        if local(e) == "tbl":
            yield e
        else:
            for c in e:
                yield from outer(c)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n, name in enumerate(sorted(x for x in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", x)), 1):
            for e in ElementTree.fromstring(z.read(name)):
                tables = list(outer(e))
                for t in tables:
                    rows = [[words(c).strip() for c in r if local(c) == "tc"] for r in t if local(r) == "tr"]
                    _block(out, "table", markdown_table(rows), [f"Section {n}"])
                if local(e) == "p" and not tables and (text := words(e).strip()):
                    _block(out, "paragraph", text, [f"Section {n}"])
    return out


class _Page(HTMLParser):
    """Headings, paragraphs, list items and tables of a web page; scripts and styles are skipped."""

    BREAKS = {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "body", "title", "td", "th", "pre", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self._text: list[str] = []
        self._path: list[str] = []
        self._skip = 0
        self._level = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text and self._level:
            self._path = [*self._path[: self._level - 1], text]
            _block(self.out, "heading", text, self._path, None, self._level)
        elif text:
            _block(self.out, "paragraph", text, self._path)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style", "noscript"):
            self._skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self._level = int(tag[1])
        elif tag in self.BREAKS:
            self._flush()

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style", "noscript"):
            self._skip = max(0, self._skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self._level = 0
        elif tag in self.BREAKS:
            self._flush()

    def handle_data(self, data) -> None:
        if not self._skip:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def html_blocks(text: str) -> list[dict]:
    page = _Page()
    page.feed(text)
    page.close()
    return page.out


def _pdf(content: bytes) -> list[dict]:
    from pypdf import PdfReader

    out: list[dict] = []
    for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        for b in plain_blocks(page.extract_text() or ""):
            _block(out, "paragraph", b["block_text"], [f"Page {n}"], page=n)
    return out


def _docx(content: bytes) -> list[dict]:
    import docx

    out, path = [], []
    document = docx.Document(io.BytesIO(content))
    for item in document.iter_inner_content():
        if hasattr(item, "rows"):
            _block(out, "table", markdown_table([[c.text for c in r.cells] for r in item.rows]), path)
        elif item.text.strip():
            m = re.fullmatch(r"Heading (\d)", item.style.name or "")
            if m:
                path = [*path[: int(m[1]) - 1], item.text.strip()]
            _block(out, "heading" if m else "paragraph", item.text.strip(), path, None, int(m[1]) if m else None)
    return out


def _pptx(content: bytes) -> list[dict]:
    import pptx

    out: list[dict] = []
    for n, slide in enumerate(pptx.Presentation(io.BytesIO(content)).slides, 1):
        path, parent = [f"Slide {n}"], None
        for s in slide.shapes:
            if s.has_table:
                _block(out, "table", markdown_table([[c.text for c in r.cells] for r in s.table.rows]), path, parent, slide=n)
            elif s.has_text_frame and s.text_frame.text.strip():
                title = s == slide.shapes.title
                if title:
                    path, parent = [f"Slide {n}", s.text_frame.text.strip()], len(out)
                for p in s.text_frame.paragraphs:
                    if p.text.strip():
                        _block(out, "heading" if title else "paragraph", p.text.strip(), path, None if title else parent, 2 if title else None, slide=n)
    return out


def _xlsx(content: bytes) -> list[dict]:
    import openpyxl

    out: list[dict] = []
    for sheet in openpyxl.load_workbook(io.BytesIO(content), data_only=True).worksheets:
        full = [c for r in sheet.iter_rows() for c in r if c.value is not None]
        if full:
            rows, columns = [c.row for c in full], [c.column for c in full]
            cells = sheet.iter_rows(min(rows), max(rows), min(columns), max(columns), values_only=True)
            corner = lambda at: sheet.cell(at(rows), at(columns)).coordinate  # noqa: B023, E731
            _block(out, "table", markdown_table([list(r) for r in cells]), [sheet.title], sheet=sheet.title, cell_range=f"{corner(min)}:{corner(max)}")
    return out


#: Handlers by extension; those of office formats need their library and say so if it is missing.
HANDLERS: dict[str, Callable[[bytes], list[dict]]] = {
    ".md": lambda b: markdown_blocks(b.decode("utf-8", "replace")),
    ".markdown": lambda b: markdown_blocks(b.decode("utf-8", "replace")),
    ".txt": lambda b: plain_blocks(b.decode("utf-8", "replace")),
    ".html": lambda b: html_blocks(b.decode("utf-8", "replace")),
    ".hwpx": _hwpx,
    ".pdf": _pdf,
    ".docx": _docx,
    ".pptx": _pptx,
    ".xlsx": _xlsx,
}


def extract(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, extraction_status, error, blocks...) of (key, file_ext, content): a row for each block, or one for a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "extraction_status", "error", *[f.split()[0] for f in BLOCK_FIELDS.split(", ")]]
        for pdf in batches:
            rows = []
            for k, ext, content in zip(pdf[key], pdf.file_ext, pdf.content, strict=True):
                handler = HANDLERS.get((ext or "").lower())
                try:
                    blocks = handler(content) if handler else None
                    error = None if handler else f"unsupported extension {ext}"
                except Exception as e:  # a broken file is a row of its own, not the end of the job
                    blocks, error = None, f"{type(e).__name__}: {e}"
                rows += [{key: k, "extraction_status": "succeeded"} | b for b in blocks or []] or [{key: k, "extraction_status": "failed" if error else "empty", "error": error}]
            yield as_rows(rows, names)

    return files.select(key, "file_ext", "content").mapInPandas(run, f"`{key}` string, extraction_status string, error string, {BLOCK_FIELDS}")


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(document_id, blocks...) of web pages held in a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"document_id": i} | b for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True) if t is not None for b in html_blocks(t)]
            yield as_rows(rows, ["document_id", *[f.split()[0] for f in BLOCK_FIELDS.split(", ")]])

    return pages.select(F.col(key).cast("long"), html).mapInPandas(run, f"document_id long, {BLOCK_FIELDS}")
