"""Parsers: text to rows. Patterns run as built-in expressions; the line scanners run per document in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HTML = {
    "id": r'\bid="([^"]*)"', "link": r'<a[^>]* href="([^"]*)"', "class": r'\bclass="([^"]*)"', "function": r"function ([A-Za-z_$][A-Za-z0-9_$]*)\(",
    "script": r'<script[^>]* src="([^"]*)"', "heading": r"<h1>([^<]*)</h1>",
}
#: Words of SQL text that name a table after them.
SQL_TABLE = r"(?i)\b(?:from|join|into|update|table(?:\s+if\s+not\s+exists)?|view)\s+([A-Za-z_][A-Za-z0-9_.]*)"

def html(df: DataFrame, kind: str, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, place, name): ids, links, classes, functions, scripts or headings in order."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(HTML[kind]))
    return df.select(id_col, F.posexplode(found).alias("place", "name"))


def json_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def sql_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(SQL_TABLE)), F.lower))).alias("table_name"))


def skeletons(files: DataFrame) -> DataFrame:
    """files (path, content): (path, skeleton, folds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [skeleton(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in told], pa.string()), pa.array([n for _, n in told], pa.int32())], ["path", "skeleton", "folds"])

    return files.select("path", "content").mapInArrow(run, "path string, skeleton string, folds int")


def skeleton(text: str, marker: str = "...", keep: tuple[str, ...] = ()) -> tuple[str, int]:
    """A source text with the bodies of brace or indentation blocks folded to a marker, but for those named; and the folds.

    A body is what lies deeper than a function's line; it is folded where it has over two lines.
    """
    lines, out, folds, i = text.split("\n"), [], 0, 0
    head = re.compile(r"^\s*(?:pub\s+|async\s+|export\s+|public\s+|private\s+|static\s+)*(?:def|fn|func|function)\s+(\w+)")
    while i < len(lines):
        m = head.match(lines[i])
        out.append(lines[i])
        i += 1
        if not m or m[1] in keep:
            continue
        indent = len(lines[i - 1]) - len(lines[i - 1].lstrip())
        end = i
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
            end += 1
        while end > i and not lines[end - 1].strip():
            end -= 1
        if end - i > 2:
            out.append(" " * (indent + 4) + marker)
            folds += 1
            i = end
    return "\n".join(out), folds


# Bounds of a window, what opens a function, what ends one, and the marks of what is left out.
WINDOW_LINES, WINDOW_BYTES = 48, 6000
OPENS = r"^(pub(\((crate|super)\))? fn|(pub )?async fn|fn) "
BORDER = r"^((pub )?(async )?fn|impl|pub (struct|enum)) "
GAP, CUT = "/* … */\n", "/* … truncated seed window */\n"


_OPENS, _BORDER = re.compile(OPENS), re.compile(BORDER)
#: A break that ends the text or stands before its last terminator, and the same of a line's return.
_LAST_BREAK, _LAST_RETURN = re.compile("\n(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z)"), re.compile("\r(?=[\r\u0085\u2028\u2029]?\\Z)")


def window(text: str, symbols: list[str | None]) -> str:
    lines = [_LAST_RETURN.sub("", x) if "\r" in x else x for x in _LAST_BREAK.sub("", text).split("\n")]
    names = [s for s in symbols if s is not None]
    opens = [i for i, x in enumerate(lines) if _OPENS.match(t := x.strip(" ")) and any(f"fn {s}" in t or t.endswith(s) or f".{s}" in t for s in names)]
    borders = [i for i, x in enumerate(lines) if _BORDER.match(x)] if opens else []
    keep = bytearray(len(lines))
    for i in opens:
        start, after = max(i - 1, 0), bisect_right(borders, i)
        end = min(start + WINDOW_LINES, borders[after] if after < len(borders) else len(lines), len(lines))
        keep[start:end] = b"\1" * max(0, end - start)
    out: list[str] = []
    size, gap = 0, False
    for x, kept in zip(lines, keep, strict=True) if opens else ():
        if kept:
            more = len(x.encode()) + 1
            if size + more > WINDOW_BYTES:
                out.append(CUT)
                break
            out.append(x + "\n")
            size, gap = size + more, False
        elif not gap and out:
            out.append(GAP)
            size, gap = size + len(GAP.encode()), True
    return "".join(out)


def windows(sources: DataFrame) -> DataFrame:
    """sources (path, content, symbols): (path, body), the functions that the symbols name, each with the line before it, up to the next
    declaration at the margin or so many lines; a mark for each gap after the first line, and at the end of too many bytes.
    Files and symbols that meet nothing, and nulls, have an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [window(text or "", symbols or []) for text, symbols in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["path", "body"])

    return sources.select("path", "content", "symbols").mapInArrow(run, "path string, body string")
