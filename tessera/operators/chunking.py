"""Splitting documents into overlapping chunks under their headings.

A chunk depends on the one before (its tail is repeated), so that a document is walked in order in one
place; documents are independent of each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, as text formats count it.
_WS = "\t\n\x0b\x0c\r \xa0                　﻿"
_WORD_END = re.compile(f"[^{_WS}]*[{_WS}]*")
_HEADING = re.compile(rf"(#{{1,4}})[{_WS}]+([^\n\r  ]+)")


@dataclass(frozen=True)
class Sizes:
    """Characters: of a slice, of the longest chunk left whole, of the repeated tail."""

    target: int = 3600
    hard: int = 4096
    overlap: int = 540
    per_token: int = 4


@dataclass(frozen=True)
class Section:
    heading: str | None
    first: int
    last: int
    text: str


def markdown_sections(lines: list[str]) -> Iterator[Section]:
    """Every heading of level 1 to 4 opens a section; its path names the headings above it."""
    path: dict[int, str] = {}
    start = 0

    def section(end: int) -> Section:
        name = " > ".join(f"{'#' * level} {path[level]}" for level in sorted(path)) or None
        return Section(name, start + 1, end, "\n".join(lines[start:end]))

    for i, line in enumerate(lines):
        m = _HEADING.fullmatch(line)
        if m:
            if i > start:
                yield section(i)
            start = i
            path = {level: t for level, t in path.items() if level < len(m[1])}
            path[len(m[1])] = m[2].strip(_WS)
    yield section(len(lines))


def paragraphs(lines: list[str]) -> Iterator[Section]:
    """Runs of lines that aren't blank."""
    start = None
    for i, line in enumerate([*lines, ""]):
        if line.strip(_WS):
            start = i if start is None else start
        elif start is not None:
            yield Section(None, start + 1, i, "\n".join(lines[start:i]))
            start = None


def tail(text: str, size: int) -> str:
    """The last characters of a text from a word's start on; all of a short text."""
    if len(text) <= size:
        return text
    cut = len(text) - size
    if text[cut] not in _WS:
        found = [p for p in (text.find(" ", cut), text.find("\n", cut)) if p >= 0]
        cut = min(found, default=len(text))
    return text[cut:].lstrip(_WS)


def slices(text: str, sizes: Sizes) -> Iterator[tuple[int, str]]:
    """(offset, slice) of a long text; each next one begins at a word, within the one before."""
    at = 0
    while at < len(text):
        part = text[at : at + sizes.target].strip(_WS)
        if not part:
            return
        yield at, part
        at = _WORD_END.match(text, min(at + sizes.target - sizes.overlap, len(text))).end()


def chunks_of(content: str | None, markdown: bool, sizes: Sizes = Sizes()) -> Iterator[tuple[str, str | None, int, int]]:
    """(content, heading path, first line, last line) of a document's chunks in order; none for a blank one."""
    if not content or not content.strip(_WS):
        return
    lines, carried = content.split("\n"), ""
    for s in (markdown_sections if markdown else paragraphs)(lines):
        text = s.text.rstrip(_WS)
        if not text.strip(_WS):
            continue
        body = f"{carried}\n{text}" if carried else text
        if len(body) <= sizes.hard:
            yield body.strip(_WS), s.heading, s.first, s.last
            carried = tail(text, sizes.overlap)
            continue
        part = ""
        for at, part in slices(body, sizes):
            yield part, s.heading, math.floor(s.first + at / len(body) * (s.last - s.first) + 0.5), s.last
        carried = tail(part, sizes.overlap)


def chunked(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of documents (doc_id, content, markdown)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "chunk_idx", "content", "heading_path", "start_line", "end_line", "token_count"]
        for pdf in batches:
            rows = [
                (doc, i, text, heading, first, last, -(-len(text) // sizes.per_token))
                for doc, content, markdown in zip(pdf["doc_id"], pdf["content"], pdf["markdown"], strict=True)
                for i, (text, heading, first, last) in enumerate(chunks_of(content, markdown, sizes))
            ]
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, chunk_idx int, content string, heading_path string, start_line int, end_line int, token_count int"
    made = docs.select(F.col("doc_id").cast("long"), "content", "markdown").mapInPandas(run, schema)
    heading = F.when(F.col("heading_path").isNotNull(), F.concat(F.col("heading_path"), F.lit("\n\n"), F.col("content")))
    return made.withColumn("embedding_content", F.coalesce(heading, F.col("content")))
