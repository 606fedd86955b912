"""Text of Word files by a streaming walk over the zipped XML, with the standard library only."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: Bytes that the parts of a file may have when they are unpacked.
MOST_BYTES = 256 << 20
# The XML namespace of Word's elements, and the parts of a file that are read.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY, STYLES = "word/document.xml", "word/styles.xml"


class _Bounded(io.RawIOBase):
    """A part of a zip file that ends with an error when it unpacks to more than `most` bytes, whatever its header says."""

    def __init__(self, source, most: int):
        self.source, self.left = source, most

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(65_536 if n < 0 else min(n, 65_536))
        self.left -= len(data)
        if self.left < 0:
            raise ValueError("the file unpacks to too many bytes")
        if b"<!DOCTYPE" in data:
            raise ValueError("the file has a document type of its own")
        return data


def _styles(pack: zipfile.ZipFile, most: int) -> dict[str, str]:
    """The lower-case name of each style id."""
    if STYLES not in pack.namelist():
        return {}
    names = {}
    for _, e in ElementTree.iterparse(_Bounded(pack.open(STYLES), most)):
        if e.tag == f"{_W}style":
            name = e.find(f"{_W}name")
            names[e.get(f"{_W}styleId", "")] = (name.get(f"{_W}val", "") if name is not None else "").lower()
            e.clear()
    return names


def _said(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's runs, those of links included."""
    out = []
    for child in paragraph:
        runs = [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []
        for run in runs:
            for x in run:
                if x.tag == f"{_W}t":
                    out.append(x.text or "")
                elif x.tag in (f"{_W}br", f"{_W}cr"):
                    out.append("\n")
                elif x.tag in (f"{_W}tab", f"{_W}ptab"):
                    out.append("\t")
                elif x.tag == f"{_W}noBreakHyphen":
                    out.append("-")
    return "".join(out)


def _rows(table: ElementTree.Element) -> Iterator[list[str]]:
    """The cells of each row; a cell over several columns counts in each, one that goes on from above has the text from there."""
    above: dict[int, str] = {}
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            own = cell.find(f"{_W}tcPr")
            span = own.find(f"{_W}gridSpan") if own is not None else None
            merge = own.find(f"{_W}vMerge") if own is not None else None
            text = "\n".join(_said(p) for p in cell.findall(f"{_W}p")).strip().replace("\n", " ")
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
                text = above.get(len(cells), text)
            cells += [text] * max(1, int(span.get(f"{_W}val", "1")) if span is not None else 1)
        above = dict(enumerate(cells))
        yield cells


def _blocks(pack: zipfile.ZipFile, most: int) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables of the body in order; each is dropped before the next is read."""
    path: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(_Bounded(pack.open(BODY), most), events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if path and path[-1].tag == f"{_W}body":
            if e.tag in (f"{_W}p", f"{_W}tbl"):
                yield e
            path[-1].remove(e)


def docx_text(data: bytes, most: int = MOST_BYTES) -> str:
    """The text of a Word file: headings as #, table rows as | a | b |, blank lines between blocks.

    Raises ValueError for what isn't such a file, is damaged, or unpacks to more than `most` bytes.
    """
    parts: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as pack:
            styles = _styles(pack, most)
            for block in _blocks(pack, most):
                if block.tag == f"{_W}tbl":
                    parts += ["| " + " | ".join(cells) + " |" for cells in _rows(block) if any(cells)]
                    parts += ["", ""]
                    continue
                text = _said(block).strip()
                if not text:
                    parts.append("")
                    continue
                mark = block.find(f"{_W}pPr/{_W}pStyle")
                style = styles.get(mark.get(f"{_W}val", ""), "") if mark is not None else ""
                if style.startswith("heading"):
                    digits = "".join(c for c in style if c.isdigit())
                    text = "#" * (int(digits) if digits in ("1", "2", "3", "4", "5", "6") else 1) + " " + text
                parts += [text, ""]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, OSError, RuntimeError, zipfile.zlib.error) as e:
        raise ValueError(f"not a Word file: {e}") from e
    return "\n".join(parts)
