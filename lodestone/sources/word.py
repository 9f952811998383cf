"""Word files (.docx) to elements, from the XML inside them."""

from __future__ import annotations

import io
import re
import zipfile
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F

from lodestone.sources.elements import PARSED, _tidy

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TITLE = "{http://purl.org/dc/elements/1.1/}title"


def _part(files: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(files.read(name)) if name in files.namelist() else None


def _said(node) -> str:
    """The text below a node: runs, tabs and line breaks."""
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join((x.text or "") if x.tag == _W + "t" else marks.get(x.tag, "") for x in node.iter())


def _table(node) -> str:
    cells = [[" ".join("\n".join(_said(p) for p in cell.iter(_W + "p")).split()).replace("|", "\\|") for cell in row.iter(_W + "tc")] for row in node.iter(_W + "tr")]
    rows = [r for r in cells if any(r)]
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2:
        return ""
    shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([shown[0], "|---" * width + "|", *shown[1:]])


def word(content: bytes) -> tuple[list[dict], str | None] | None:
    """Elements in document order and the title; None for what is no Word file.

    A paragraph's style names its kind: headings by number, lists, and Title, which is no element but the title where
    the file names none.
    """
    try:
        files = zipfile.ZipFile(io.BytesIO(content))
        body = _part(files, "word/document.xml").find(_W + "body")
        core, styles = _part(files, "docProps/core.xml"), _part(files, "word/styles.xml")
    except (zipfile.BadZipFile, ElementTree.ParseError, AttributeError, KeyError):
        return None
    named = {s.get(_W + "styleId"): n.get(_W + "val", "") for s in (styles.iter(_W + "style") if styles is not None else ()) if (n := s.find(_W + "name")) is not None}
    title = ((core.findtext(_TITLE) if core is not None else None) or "").strip() or None
    found = []  # kind, text, level
    for node in body if body is not None else ():
        if node.tag == _W + "tbl":
            found.append(("table", _table(node), None))
        elif node.tag == _W + "p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            style = style.get(_W + "val", "") if style is not None else ""
            style, text = named.get(style, style).lower(), _tidy(_said(node))
            if style == "title" and text:
                title = title or text
                found.append(("break", "", None))
            elif style.startswith("heading"):
                number = re.search(r"\d", style)
                found.append(("heading", text, int(number[0]) if number else 1))
            elif "list" in style:
                found.append(("list", text and "- " + text, None))
            else:
                found.append(("paragraph", text, None))
    out = []
    kept = [x for x in found if x[1] or x[0] == "break"]
    for kind, run in groupby(kept, key=lambda x: x[0]):
        if kind == "list":
            out.append(("list", "\n".join(x[1] for x in run), None))
        elif kind != "break":
            out += run
    return [{"kind": k, "text": t, "level": n, "page": None} for k, t, n in out], title


@F.pandas_udf(PARSED)
def word_elements(content: pd.Series) -> pd.DataFrame:
    got = [word(c) if c is not None else None for c in content]
    return pd.DataFrame({"elements": [g and g[0] for g in got], "title": [g and g[1] for g in got]})
