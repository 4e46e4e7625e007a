"""H06-H09 against the rules in Python."""

import random
import re

from pyspark.sql import functions as F

from inkweave.functions import heads as h

I, IS = re.I, re.I | re.S
py = lambda p: p.replace(r"\z", r"\Z")


def lines(t):
    return [x for x in (re.sub("[ \t\xa0]+", " ", r).strip() for r in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")) if x]


def journal(x):
    return 0 < len(x) <= 40 and not re.search(h.NO_JOURNAL, x, I) and bool(re.search(h.JOURNAL_WORD, x, I) or re.match(h.JOURNAL_NAME, x))


def author(x):
    return not journal(x.strip()) and bool(re.search(h.AUTHOR, x) or re.match(h.CHINESE_NAME, x.strip().lstrip("□")))


def title(t):
    out = []
    for x in map(str.strip, (t or "").split("\n")[:40]):
        if not x:
            if out:
                break
        elif re.match(h.BOILERPLATE, x.lower()) or re.match(r"^[\d\.\s]+$", x):
            continue
        elif re.search(r"摘\s*要|abstract", x, I) or author(x):
            break
        else:
            out.append(x)
            if sum(map(len, out)) >= 800:
                break
    return " ".join(out)[:800]


def first(patterns, t):
    for p in patterns:
        if (x := re.search(py(p), t, IS)) and (body := "\n\n".join(lines(x[1]))):
            return body[:4000]


def lead(ls):
    at = next((i for i, x in enumerate(ls) if i >= 3 and not author(x) and len(x) >= 80 and x[0].isupper()), None)
    if at is None:
        return None
    got = ""
    for x in ls[at:]:
        if got and x.startswith(h.BODY_STARTS):
            break
        got += (" " if got else "") + x
        if len(got) >= 4000:
            break
    return got[:4000] if len(got) >= 100 else None


def after(t, a):
    anchor = a[-80:]
    if anchor not in t:
        return None
    tail = " ".join(t[t.index(anchor) + len(anchor) :].split())
    return " ".join([s for s in re.split(r"(?<=[。！？.!?])\s+", tail) if s.strip()][:8])[:4000] or None


def sections(t):
    t = "\n".join(ls := lines(t))
    a = first(h.ABSTRACT, t) or lead(ls)
    i = first(h.INTRODUCTION, t) or (after(t, a) if a else None)
    return title(t), a or "", first(h.KEYWORDS, t) or "", "\n\n".join([p.strip() for p in re.split(r"\n\s*\n", i or "") if p.strip()][:3])[:4000]


def conclusion(t):
    tail, got = "\n".join(lines((t or "")[-3000:])), None
    for p in h.CONCLUSION:
        for x in re.finditer(py(p), tail, IS):
            got = x[1]
    return "\n\n".join(lines(got)[-2:])[:1500]


def line(patterns, t):
    for p in patterns:
        if x := re.search(py(p), t or "", IS):
            s = re.sub(r"(?<=[一-龥])\s+(?=[一-龥])", "", re.sub(r"\s+", " ", x[1].strip())).strip(" ;；，,")
            if len(s) >= 3:
                return s[:300]


def meta(t):
    return line(h.FUNDING, t) or "", line(h.AFFILIATION, t) or "", line(h.JOURNAL, t) or next((x for x in lines(t)[:20] if journal(x)), "")


PARTS = [
    "A Study of Things", "http://x.y", "12. 3", "Abstract: we show", "ABSTRACT", "摘 要：本文研究", "Keywords: a, b", "关键词：甲；乙", "1. Introduction", "Introduction", "一、引言", "2. Methods", "二、方法", "References", "参考文献", "Conclusion", "结论：",
    "Discussion:", "Acknowledgments", "University of Nowhere, Town", "王小明", "□李四", "西夏研究", "Journal of Tests", "Journal: Acta ; x", "Funding: grant “Deep Project Name” 12", "基金项目：国家 社科 基金；二", "Grant No. 77", "作者单位：某 大学；", "Received: May", "In this paper we do.",
    "É" + "xyz words go on. " * 9, "Short sentence. Another one! 第三句。 Fourth?", "", "  ", "lower " * 30, "本文 后", "\tTabbed\u00a0 line\r", "作者简介：张三，北京大学考古文博学院教授，主要研究方向",
]


def test_heads_equal_the_rules(spark):
    r = random.Random(12)
    texts = ["\n".join(r.choices(PARTS, k=r.randrange(0, 18))) for _ in range(400)] + [None, "", "\n\n", "word " * 3000, "A" * 900 + "\nb", "Conclusion\n" + "x. " * 2000, "a\nb\nc\n" + "Many Words here. " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    t = F.col("t")
    for x in df.select("i", h.paper_title(t).alias("title"), h.sections(t).alias("s"), F.coalesce(h.conclusion(t), F.lit("")).alias("c"), h.meta(t).alias("m")).collect():
        own = texts[x["i"]]
        assert x["title"] == title(own), own
        assert tuple(x["s"]) == sections(own), own
        assert x["c"] == conclusion(own), own
        assert tuple(x["m"]) == meta(own), own
