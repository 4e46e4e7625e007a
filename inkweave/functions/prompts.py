"""The sections of a prompt and their common budget, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as m
from .binding import record
from .text import once


def section(lines: Column, empty: str) -> Column:
    """An array of lines as a section; `empty` for none."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))


def fitting(text: Column, most: Column) -> Column:
    """As many whole lines from the start as fit into `most` characters; of a first line that is longer, its beginning."""
    cut = lambda start: F.length(start) - F.length(F.substring_index(start, "\n", -1)) - 1
    keep = lambda start: F.when(F.contains(start, F.lit("\n")), cut(start)).otherwise(F.greatest(most, F.lit(0)))
    short = once(F.substring(text, F.lit(1), F.greatest(most, F.lit(-1)) + 1), lambda start: F.substring(text, F.lit(1), keep(start)))
    return F.when(F.length(text) <= most, text).otherwise(short)


def _size(*sections: Column) -> Column:
    return sum((F.length(c) for c in sections), F.lit(0))


def _marked(text: Column, *after: Column) -> Column:
    """With the mark, if it is the last section that has any text."""
    return F.when((text != "") & (_size(*after) == 0), F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(m.CONTEXT_CUT))).otherwise(text)


def budgeted(entities: Column, relations: Column, chunks: Column, most: int) -> Column:
    """(entities, relations, chunks) of at most `most` characters together: chunks lose lines from the end first, then relations,
    then entities, until they leave room for the mark; the last section that has text left gets it."""
    room = F.lit(max(most - len(m.CONTEXT_CUT), 0))

    def cut(s: Column) -> Column:
        e, r = s["entities"], s["relations"]
        third = lambda c, r: once(fitting(e, room - _size(r, c)), lambda e: record(entities=_marked(e, r, c), relations=_marked(r, c), chunks=_marked(c)))
        second = lambda c: once(fitting(r, room - _size(e, c)), lambda r: third(c, r))
        return F.when(_size(e, r, s["chunks"]) <= most, s).otherwise(once(fitting(s["chunks"], room - _size(e, r)), second))

    return once(record(entities=entities, relations=relations, chunks=chunks), cut)
