"""Title, sections, conclusion and meta lines of a paper's plain text, as Columns.

Line rules are folds over the array of lines with a small state; section rules are lazy patterns with look-ahead that are
tried in order, with fallbacks. Null and empty texts give empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import record
from .text import once

TITLE_LINES, TITLE_CHARS, SECTION_CHARS, INTRO_CHARS, IMPLICIT_CHARS, INTRO_SENTENCES, JOURNAL_LINES = 40, 800, 4_000, 4_000, 100, 8, 20
TAIL_CHARS, CONCLUSION_CHARS, META_CHARS = 3_000, 1_500, 300

# Patterns and marks that must match for equal results, in the order in which they are tried.
ABSTRACT = (
    r"\babstract\b\s*[:\-]?\s*(.+?)(?=\n(?:keywords?|key\s*words|index\s*terms|introduction|\d+\s*[\.\)]\s*introduction|references|acknowledgments)\b|\z)",
    r"(?:\[\s*摘\s*要\s*\]|摘\s*要\s*[：:])\s*(.+?)(?=\n(?:\[?\s*关键词|关键字|引言|前言|一[、．.\s]|1[\s、．.]|参考文献)|\z)",
)
KEYWORDS = (
    r"\bkeywords?\b\s*[:\-]?\s*(.+?)(?=\n(?:introduction|\d+\s*[\.\)]|references|acknowledgments)\b|\z)",
    r"(?:\[\s*关\s*键\s*词\s*\]|关\s*键\s*词\s*[：:])\s*(.+?)(?=\n(?:\[\s*作者|\[\s*基金|\[\s*中图|引言|前言|一[、．.\s]|1[\s、．.]|参考文献)|\z)",
)
INTRODUCTION = (
    r"\bintroduction\b\s*(.+?)(?=\n(?:\d+\s*[\.\)]\s*(?:related|background|methods|materials)|references)\b|\z)",
    r"(?:一[、．.\s]*(?:前\s*言|引\s*言)|引\s*言)\s*(.+?)(?=\n(?:二[、．.]|2[\s、．.]|参考文献)\b|\z)",
    r"前\s*言\s*(.+?)(?=\n(?:二[、．.]|2[\s、．.]|参考文献)\b|\z)",
)
_STOP = r"(?:^|\n)\s*(?:references|acknowledgments?|appendix|data\s+availability|author\s+contributions|competing\s+interests)\b|(?:^|\n)\s*(?:参考\s*文献|致\s*谢|附\s*录|数据\s*可用性|利益\s*冲突|作者\s*贡献)\b"
CONCLUSION = (
    rf"(?:^|\n)\s*(?:conclusions?|discussion|summary|concluding\s+remarks?)\s*[:\-]?\s*\n+(.+?)(?={_STOP}|\z)",
    rf"(?:^|\n)\s*(?:[一二三四五六七八九十][、．.]\s*)?(?:结\s*论|讨\s*论|总\s*结|结\s*语)\s*[:：]?\s*\n+(.+?)(?={_STOP}|\z)",
)
_FUND = r"(?:基金项目|资助项目|项目资助|受\s*资\s*助|Funding|Fund(?:ed)?\s+by|Financial\s+support|Grant|Supported\s+by)\s*[:：]\s*"
FUNDING = (rf"{_FUND}[^\n]{{0,60}}?[“\"《]([^”\"》]{{5,200}})[”\"》]", rf"{_FUND}(.+?)(?=\n|；|;|$)", r"(?:项目编号|Project\s+No\.?|Grant\s+No\.?)\s*[:：]?\s*(.+?)(?=\n|；|;|$)")
AFFILIATION = (
    r"(?:作者单位|工作单位|单位|Affiliations?)\s*[:：]\s*(.+?)(?=\n|；|;|$)",
    r"作者简介\s*[：:]\s*[^\n。；;]*?((?:大学|学院|研究所|研究中心|博物馆|考古所|博物院)[^\n。；;]{2,60}?)(?=主要研究|主要从事|E-mail|Email|通讯作者|[\n。；;]|$)",
    r"((?:Department|Institute|University|College|School|Faculty)\s+of\s+[^\n]{5,200})",
)
JOURNAL = (r"(?:期刊|杂志|Journal|Proceedings)\s*[:：]\s*(.+?)(?=\n|$)",)
NO_JOURNAL = r"doi|http|www\.|vol\.|no\.|issue|page|article|received|accepted|published|copyright|license|abstract|关键词|keywords"
JOURNAL_WORD = r"journal|proceedings|transactions|review|letters|quarterly|communications|magazine|学报|杂志|期刊|月刊|论丛|辑刊"
JOURNAL_NAME = r"^[一-龥]{2,8}(?:研究|学报|杂志|刊|丛)$"
AUTHOR = r"(?:\d+,\d+|&|\bUniversity\b|\bCollege\b|\bDepartment\b|\bChina\.|\bet al\b|\^[0-9])"
CHINESE_NAME = r"^[一-龥]{2,4}$"
BOILERPLATE = r"^(?:http|doi:|article|received:|accepted:|check for updates)"
BODY_STARTS = ("The development", "In recent", "In this", "Recently,", "Background", "Introduction", "本文", "本研究")

#: As in Python: "." takes line ends, case counts not, classes are Unicode, only line feeds end lines.
_FLAGS = "(?disU)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def section_lines(text: Column) -> Column:
    """Trimmed lines that aren't empty, with runs of blanks folded."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"[ \t\xA0]+", " "), "\n")
    return F.filter(F.transform(lines, _strip), lambda x: x != "")


def journal_line(line: Column) -> Column:
    """A journal's name standing alone."""
    name = line.rlike(f"(?diU){JOURNAL_WORD}") | line.rlike(JOURNAL_NAME)
    return (line != "") & (F.length(line) <= 40) & ~line.rlike(f"(?diU){NO_JOURNAL}") & name


def author_line(line: Column) -> Column:
    return ~journal_line(_strip(line)) & (line.rlike(f"(?U){AUTHOR}") | F.ltrim(_strip(line), F.lit("□")).rlike(CHINESE_NAME))


def paper_title(text: Column) -> Column:
    """Early lines up to the abstract, an author line or a blank line, without boilerplate and bare numbers; 800 characters."""

    def step(s: Column, line: Column) -> Column:
        blank = line == ""
        ends = (blank & (s["title"] != "")) | line.rlike(r"(?diU)摘\s*要|abstract") & ~_skipped(line) & ~blank | author_line(line) & ~_skipped(line) & ~blank
        takes = ~s["done"] & ~ends & ~blank & ~_skipped(line)
        size = s["size"] + F.when(takes, F.length(line)).otherwise(0)
        joined = F.when(s["title"] == "", line).otherwise(F.concat(s["title"], F.lit(" "), line))
        return record(title=F.when(takes, joined).otherwise(s["title"]), size=size, done=s["done"] | ends | (takes & (size >= TITLE_CHARS)))

    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, TITLE_LINES), _strip)
    start = record(title=F.lit(""), size=F.lit(0), done=F.lit(False))
    return F.left(F.aggregate(lines, start, lambda s, raw: once(raw, lambda line: step(s, line)), lambda s: s["title"]), F.lit(TITLE_CHARS))


def _skipped(line: Column) -> Column:
    return F.lower(line).rlike(BOILERPLATE) | line.rlike(r"(?U)^[\d\.\s]+$")


def _first(patterns: tuple[str, ...], text: Column) -> Column:
    """What the first pattern with any text finds, a paragraph for each line; null if none does."""
    body = lambda p: F.nullif(F.array_join(section_lines(F.regexp_extract(text, _FLAGS + p, 1)), "\n\n"), F.lit(""))
    return F.left(F.coalesce(*[body(p) for p in patterns]), F.lit(SECTION_CHARS))


def _lead(lines: Column) -> Column:
    """The abstract without a heading: from the first long line that opens with a capital, after three lines, up to what opens a body."""
    head = lambda x: F.left(x, F.lit(1))
    body = lambda x: F.exists(F.array(*[F.lit(b) for b in BODY_STARTS]), lambda b: x.startswith(b))

    def step(s: Column, e: Column) -> Column:
        line, begun = e["line"], s["text"] != ""
        opens = ~begun & (e["i"] >= 3) & ~author_line(line) & (F.length(line) >= 80) & (head(line) == F.upper(head(line))) & (head(line) != F.lower(head(line)))
        stops = s["done"] | (begun & body(line))
        text = F.when(~stops & begun, F.concat(s["text"], F.lit(" "), line)).when(~stops & opens, line).otherwise(s["text"])
        return once(text, lambda t: record(text=t, done=stops | (F.length(t) >= SECTION_CHARS)))

    found = F.aggregate(F.transform(lines, lambda x, i: record(line=x, i=i)), record(text=F.lit(""), done=F.lit(False)), step, lambda s: s["text"])
    return once(found, lambda t: F.when(F.length(t) >= IMPLICIT_CHARS, F.left(t, F.lit(SECTION_CHARS))))


def _after(text: Column, abstract: Column) -> Column:
    """The introduction without a heading: the sentences that follow the abstract's end."""
    anchor = F.right(abstract, F.lit(80))
    at = F.instr(text, anchor)
    tail = F.regexp_replace(_strip(F.substring(text, at + F.length(anchor), F.length(text))), r"(?U)\s+", " ")
    parts = F.slice(F.filter(F.split(tail, r"(?U)(?<=[。！？.!?])\s+"), lambda x: _strip(x) != ""), 1, INTRO_SENTENCES)
    return F.when(at > 0, F.nullif(F.left(F.array_join(parts, " "), F.lit(INTRO_CHARS)), F.lit("")))


def sections(text: Column) -> Column:
    """(title, abstract, keywords, intro) of a text."""

    def found(b: Column) -> Column:
        text = b["text"]
        abstract = F.coalesce(_first(ABSTRACT, text), _lead(b["lines"]))

        def rest(abstract: Column) -> Column:
            intro = F.coalesce(_first(INTRODUCTION, text), F.when(F.coalesce(abstract, F.lit("")) != "", _after(text, abstract)))
            paragraphs = F.slice(F.filter(F.transform(F.split(intro, r"(?U)\n\s*\n"), _strip), lambda p: p != ""), 1, 3)
            empty = F.lit("")
            return record(title=paper_title(text), abstract=F.coalesce(abstract, empty), keywords=F.coalesce(_first(KEYWORDS, text), empty), intro=F.coalesce(F.left(F.array_join(paragraphs, "\n\n"), F.lit(INTRO_CHARS)), empty))

        return once(abstract, rest)

    return once(section_lines(text), lambda lines: once(record(text=F.array_join(lines, "\n"), lines=lines), found))


def conclusion(text: Column, window: int = TAIL_CHARS) -> Column:
    """The last two lines of the last conclusion in the text's end; Chinese headings win over English ones."""
    tail = F.array_join(section_lines(F.right(text, F.lit(window))), "\n")

    def last(t: Column) -> Column:
        every = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(_FLAGS + p), F.lit(1)), F.lit(-1))
        lines = section_lines(F.coalesce(*[every(p) for p in reversed(CONCLUSION)]))
        return once(lines, lambda x: F.left(F.array_join(F.slice(x, F.greatest(F.size(x) - 1, F.lit(1)), F.lit(2)), "\n\n"), F.lit(CONCLUSION_CHARS)))

    return once(tail, last)


def _line(patterns: tuple[str, ...], text: Column) -> Column:
    """What the first pattern with three characters or more finds, in one line."""

    def clean(found: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(_strip(found), r"(?U)\s+", " "), r"(?U)(?<=[一-龥])\s+(?=[一-龥])", "")
        return once(F.regexp_replace(flat, r"^[ ;；，,]+|[ ;；，,]+\z", ""), lambda x: F.when(F.length(x) >= 3, F.left(x, F.lit(META_CHARS))))

    return F.coalesce(*[clean(F.regexp_extract(text, _FLAGS + p, 1)) for p in patterns])


def meta(text: Column) -> Column:
    """(funding, affiliation, journal); the journal else from the first line, of twenty, that is a journal's name."""
    text, empty = F.coalesce(text, F.lit("")), F.lit("")
    alone = F.get(F.filter(F.slice(section_lines(text), 1, JOURNAL_LINES), journal_line), F.lit(0))
    return record(funding=F.coalesce(_line(FUNDING, text), empty), affiliation=F.coalesce(_line(AFFILIATION, text), empty), journal=F.coalesce(_line(JOURNAL, text), alone, empty))
