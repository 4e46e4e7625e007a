"""Chunks for extraction: sections by their headings, packed paragraphs and sentences, overlap, a least size.

A text's sections run from heading line to heading line; what stands before the first is a section without a title. A
section over the limit is packed: units (paragraphs, or the sentences of a paragraph that is over the budget itself) are
appended while they fit. With an overlap each later chunk opens with the end of the one before, and the budget shrinks
by that much, unless under 200 characters would be left. Chunks under the least size join the one before; a first one
that is too small joins the second.

The rule is sequential within a text and cheap, so it runs over Arrow batches of texts, one text at a time; nothing is
shuffled. Offsets are those that the packing counts with: the sum of what was packed, not positions in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m

MOST, LEAST, SMALLEST_BUDGET = 12_000, 500, 200
_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s+")
SCHEMA = "array<struct<title:string,text:string,start_char:int,end_char:int>>"


@dataclass(frozen=True)
class Chunk:
    title: str | None
    text: str
    start_char: int
    end_char: int


def heading(paradigm: str) -> re.Pattern[str]:
    """A line that is one of the paradigm's section titles, numbered or not."""
    titles = "|".join(map(re.escape, m.SECTION_TITLES[paradigm]))
    return re.compile(rf"^\s*(?:(?:\d+(?:\.\d+)*\s+[.\-]?\s*)|(?:[IVXivx]+\.\s*))?({titles})\s*(?:[:.\-]?\s*)*$", re.MULTILINE | re.IGNORECASE)


def sections(text: str, titles: re.Pattern[str]) -> Iterator[tuple[str | None, str, int]]:
    """(title, body, start) of every section that isn't blank."""
    marks = [(None, 0, 0), *((x[1].strip(), x.start(), x.end()) for x in titles.finditer(text))]
    for (title, _, start), end in zip(marks, [*(x[1] for x in marks[1:]), len(text)], strict=True):
        if body := text[start:end].strip():
            yield title, (text if len(marks) == 1 else body), start


def packed(title: str | None, body: str, start: int, budget: int) -> Iterator[Chunk]:
    text, at = "", start
    for paragraph in filter(None, map(str.strip, _PARAGRAPH.split(body))):
        long = len(paragraph) > budget
        gap = " " if long else "\n\n"
        if long and text:  # what was gathered ends here, but its place in the count stays
            yield Chunk(title, text.strip(), at, at + len(text.strip()))
            text = ""
        for unit in _SENTENCE.split(paragraph) if long else [paragraph]:
            if text and len(text) + len(unit) + len(gap) > budget:
                done = Chunk(title, text.strip(), at, at + len(text.strip()))
                yield done
                text, at = "", done.end_char + 1
            text += unit + gap
    if text.strip():
        yield Chunk(title, text.strip(), at, at + len(text.strip()))


def overlapping(chunks: list[Chunk], start: int, overlap: int) -> list[Chunk]:
    out = chunks[:1]
    for before, c in zip(chunks, chunks[1:]):
        head = before.text[-overlap:].strip() if len(before.text) > overlap else before.text
        out.append(replace(c, text=f"{head}\n\n{c.text}".strip(), start_char=max(start, c.start_char - len(head))))
    return out


def joined(a: Chunk, b: Chunk, title: str | None) -> Chunk:
    return Chunk(title, f"{a.text}\n\n{b.text}".strip(), a.start_char, b.end_char)


def chunks_of(text: str | None, titles: re.Pattern[str], most: int = MOST, least: int = LEAST, overlap_ratio: float = 0.0) -> list[Chunk]:
    if not text or not text.strip():
        return []
    overlap = int(most * overlap_ratio)
    overlap = overlap if most - overlap >= SMALLEST_BUDGET else 0
    out: list[Chunk] = []
    for title, body, start in sections(text, titles):
        own = [Chunk(title, body, start, start + len(body))] if len(body) <= most else list(packed(title, body, start, most - overlap))
        for c in overlapping(own, start, overlap) if overlap else own:
            if out and len(c.text) < least:
                out[-1] = joined(out[-1], c, out[-1].title)
            else:
                out.append(c)
    if len(out) > 1 and len(out[0].text) < least:
        out[:2] = [joined(out[0], out[1], out[1].title)]
    return out


def extraction_chunks(text: Column, paradigm: Column, most: int = MOST, least: int = LEAST, overlap_ratio: float = 0.0) -> Column:
    """Array of (title, text, start_char, end_char) of each text; empty for null or blank texts. paradigm: STEM or HSS, else STEM."""
    titles = {p: heading(p) for p in m.SECTION_TITLES}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in batches:
            yield pd.Series([[vars(c) for c in chunks_of(t, titles.get(k, titles["STEM"]), most, least, overlap_ratio)] for t, k in zip(texts, kinds, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SCHEMA)(text, paradigm)


def chunked(docs: DataFrame, paradigm: Column | None = None, **limits) -> DataFrame:
    """doc_id, chunk_index, title, text, start_char, end_char: a row for each chunk of docs (doc_id, text)."""
    pieces = extraction_chunks(F.col("text"), F.lit("STEM") if paradigm is None else paradigm, **limits)
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")
