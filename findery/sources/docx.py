"""Markdown answers as Word documents, with the standard library alone."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from findery.operators.chunking import markdown_blocks

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def _paragraph(text: str, style: str = "") -> str:
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in text.split("\n"))
    return f"<w:p>{head}<w:r>{lines}</w:r></w:p>"


def _table(text: str) -> str:
    lines = [r for k, r in enumerate(text.split("\n")) if k != 1]
    rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in lines]
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def markdown_to_docx(text: str, title: str | None = None) -> bytes:
    """A .docx of headings, paragraphs, code and tables."""
    body = [_paragraph(title, "Title")] if title else []
    for b in markdown_blocks(text):
        if b["block_type"] == "table":
            body.append(_table(b["block_text"]))
        else:
            body.append(_paragraph(b["block_text"], f"Heading{b['level']}" if b["block_type"] == "heading" else ""))
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (_PARTS | {"word/document.xml": document}).items():
            z.writestr(name, content)
    return out.getvalue()
