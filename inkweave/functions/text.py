"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as m


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, the last three dots where cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def garbled(c: Column) -> Column:
    """Three replacement characters in a row, or more than half of all."""
    odd = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return c.rlike("�{3,}") | (odd * 2 > F.length(c))


def folded(c: Column) -> Column:
    """Lower case, white space folded to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def clean_lines(c: Column) -> Column:
    """Line feeds only, no blanks at line ends, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t\f\x0B]+\n", "\n"), r"^[\s]+", ""), r"[\s]+$", "")


def compact_lines(c: Column) -> Column:
    """Blanks folded (no-break spaces too), lines trimmed, empty lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(c, "[ \t ]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(c: Column) -> Column:
    """Trimmed pieces that end with terminal punctuation or a line end."""
    return F.filter(F.transform(F.split(c, r"(?<=[。！？.!?])\s*|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def first_sentence(c: Column, keywords: tuple[str, ...], default: Column, most: int = 120) -> Column:
    """First sentence with any keyword, cut; else default."""
    hit = F.filter(sentences(c), lambda s: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(s), k)))
    return F.coalesce(F.substring(F.get(hit, F.lit(0)), 1, most), default)


def title(c: Column) -> Column:
    """First line that isn't empty, without heading marks, 80 characters; a fixed name if there is none."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^#+", ""))), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 80), F.lit("未命名论文"))


def content_id(c: Column) -> Column:
    """H20."""
    return F.concat(F.lit("paper-"), F.substring(F.sha1(c), 1, 10))


def matched(c: Column, keywords: tuple[str, ...]) -> Column:
    """Sorted keywords that the folded text contains."""
    listed = F.array(*[F.lit(k) for k in sorted(keywords)])
    return once(folded(c), lambda text: F.filter(listed, lambda k: F.contains(text, k)))


def paradigm(stem: Column, hss: Column) -> Column:
    """Class of more matches; a tie is HSS if there are any."""
    return F.when(hss > stem, "HSS").when(stem > hss, "STEM").when(hss > 0, "HSS").otherwise("STEM")


def confidence(stem: Column, hss: Column) -> Column:
    both = stem + hss
    return F.round(F.when(both == 0, F.lit(0.55)).otherwise(F.least(F.lit(0.95), F.lit(0.62) + F.lit(0.07) * F.abs(hss - stem) + F.lit(0.02) * both)), 2)


def section_name(c: Column) -> Column:
    """Canonical name of a section title, null if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in m.SECTION_ALIASES.items() for x in kv])
    return F.try_element_at(pairs, folded(c))


def numbers(c: Column) -> Column:
    """Percents as shares, then plain numbers outside percents."""
    pct = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.cast("double") / 100)
    plain = F.transform(F.regexp_extract_all(F.regexp_replace(c, r"\d+(?:\.\d+)?\s*%", " "), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.concat(pct, plain)


def close(a: Column, b: Column, rel: float = 0.01, floor: float = 1e-9) -> Column:
    """H15."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(floor))


def ngrams(chars: Column, n: int, most: int) -> Column:
    """The first `most` n-grams of an array of characters."""
    last = F.least(F.size(chars) - n + 1, F.lit(most))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(*[F.get(chars, i + (j - 1)) for j in range(n)]))).otherwise(F.array().cast("array<string>"))


def keywords(c: Column, most: int = 40, stop: tuple[str, ...] = (), hints: Column | None = None) -> Column:
    """Hints, tokens of two or more characters, then character 4-, 3- and 2-grams, distinct, the first `most`.

    Of each kind of n-grams only as many are cut as can bring `most` different ones in a text that repeats none; where
    these repeat too often, all are.
    """
    clean = F.translate(F.translate(c, "？，。；：、", "      "), "「」”“", "")
    keep = lambda x: ~x.isin(*stop) if stop else F.lit(True)
    tokens = F.filter(F.split(clean, r"\s+"), lambda x: (F.length(x) >= 2) & keep(x))
    tokens = F.concat(hints, tokens) if hints is not None else tokens

    def picked(chars: Column, cut: int) -> Column:
        return F.array_distinct(F.concat(tokens, *[ngrams(chars, n, cut) for n in (4, 3, 2)]))

    chars = F.filter(F.split(F.replace(clean, F.lit(" "), F.lit("")), ""), lambda x: x != "")
    few = lambda chars: once(F.array_distinct(F.concat(tokens, ngrams(chars, 4, 4 * most))), lambda x: F.when((F.size(x) >= most) | (F.size(chars) <= 4 * most), F.slice(F.array_distinct(F.concat(x, ngrams(chars, 3, 4 * most), ngrams(chars, 2, 4 * most))), 1, most)))
    return once(chars, lambda chars: F.coalesce(few(chars), F.slice(picked(chars, 1 << 30), 1, most)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Deterministic stand-in of the reranker."""
    x, y = F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
