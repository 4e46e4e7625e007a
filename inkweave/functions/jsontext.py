"""JSON in answers that wrap or break it, as Columns.

The text is cut into tokens (an escape with what follows, a quote, a bracket, a run of anything else) and folded from
left to right, with the depth, whether a string is open, and the place so far: brackets in strings don't count, and the
block ends where the depth of the opening kind is back at 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import record
from .text import once

_TOKENS = r"""\\[\s\S]?|["{}\[\]]|[^"\\{}\[\]]+"""
_FENCED = r"(?is)^```(?:json)?\s*(.*?)```\s*$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unfenced(raw: Column) -> Column:
    """Without white space around it and, where it is one code block, without its fences."""
    text = _stripped(raw)
    return F.when(text.rlike(_FENCED), _stripped(F.regexp_extract(text, _FENCED, 1))).otherwise(text)


def json_block(raw: Column) -> Column:
    """The first balanced object or array; the rest of the text if it never ends; the whole text if it opens with a bracket
    or has none. Null for null."""

    def block(b: Column) -> Column:
        def step(s: Column, token: Column) -> Column:
            live = ~s["inside"]
            depth = s["depth"] + F.when(live & (token == b["opens"]), 1).when(live & (token == b["closes"]), -1).otherwise(0)
            place = s["place"] + F.length(token)
            ends = (s["end"] == 0) & live & (token == b["closes"]) & (depth == 0)
            return record(depth=depth, inside=F.when(token == '"', live).otherwise(s["inside"]), place=place, end=F.when(ends, place).otherwise(s["end"]))

        end = F.aggregate(F.regexp_extract_all(b["tail"], F.lit(_TOKENS), F.lit(0)), record(depth=F.lit(0), inside=F.lit(False), place=F.lit(0), end=F.lit(0)), step, lambda s: s["end"])
        return once(end, lambda e: F.when(e > 0, F.substring(b["tail"], F.lit(1), e)).otherwise(b["tail"]))

    def found(t: Column) -> Column:
        # instr counts code points as substring does; 0 is none
        at = F.coalesce(F.least(*[F.nullif(F.instr(t, c), F.lit(0)) for c in "[{"]), F.lit(0))
        parts = lambda tail: record(tail=tail, opens=F.left(tail, F.lit(1)), closes=F.when(F.left(tail, F.lit(1)) == "{", "}").otherwise("]"))
        return F.when(at <= 1, t).otherwise(once(once(F.substring(t, at, F.length(t)), parts), block))

    return once(unfenced(raw), found)


def closed(block: Column) -> Column:
    """A block that was cut off, with its string, its last member and its brackets closed."""

    def step(s: Column, token: Column) -> Column:
        live = ~s["inside"]
        opener = F.when(token == "{", "}").when(token == "[", "]")
        pops = live & (token != "") & (token == F.left(s["open"], F.lit(1)))
        stack = F.when(live & opener.isNotNull(), F.concat(opener, s["open"])).when(pops, F.substring(s["open"], F.lit(2), F.length(s["open"]))).otherwise(s["open"])
        return record(inside=F.when(token == '"', live).otherwise(s["inside"]), open=stack)

    left = F.aggregate(F.regexp_extract_all(block, F.lit(_TOKENS), F.lit(0)), record(inside=F.lit(False), open=F.lit("")), step)
    cut = F.regexp_replace(block, r"\\$", "")
    done = F.regexp_replace(F.regexp_replace(block, r"[\s,]+$", ""), r":$", ":null")
    return once(left, lambda s: F.concat(F.when(s["inside"], F.concat(cut, F.lit('"'))).otherwise(done), s["open"]))


def json_repaired(raw: Column) -> Column:
    """The block if it is JSON; else closed, then also without commas before closing brackets and with JSON's names of constants,
    if that makes it JSON; else null."""
    fine = lambda c: F.try_parse_json(c).isNotNull() & c.rlike(r"^[\[{]")

    def plain(shut: Column) -> Column:
        out = F.regexp_replace(shut, r",(\s*[}\]])", "$1")
        for name, constant in (("True", "true"), ("False", "false"), ("None", "null")):
            out = F.regexp_replace(out, rf"([:\[,]\s*){name}\b", f"$1{constant}")
        return out

    last = lambda p: F.when(fine(p), p)
    second = lambda shut: F.when(fine(shut), shut).otherwise(once(plain(shut), last))
    return once(json_block(raw), lambda b: F.when(fine(b), b).otherwise(once(closed(b), second)))
