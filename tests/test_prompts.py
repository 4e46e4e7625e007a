"""K07, S27, H02 against brute force."""

import random
import re

from pyspark.sql import functions as F

from inkweave import model as m
from inkweave.functions.prompts import budgeted
from inkweave.operators.extraction_chunks import chunked
from inkweave.operators.lexical import ranked


def trimmed(sections, most):
    """Lines go one by one from the end of the last section that has text."""
    if sum(map(len, sections)) <= most:
        return sections
    s, room = list(sections), max(most - len(m.CONTEXT_CUT), 0)
    while sum(map(len, s)) > room and any(s):
        i = max(k for k in range(3) if s[k])
        lines = s[i].split("\n")
        s[i] = "\n".join(lines[:-1]) if len(lines) > 1 else s[i][: max(0, len(s[i]) - (sum(map(len, s)) - room))]
    for i in (2, 1, 0):
        if s[i]:
            s[i] = s[i].rstrip() + m.CONTEXT_CUT
            break
    return s


def test_budget(spark):
    r = random.Random(1)
    text = lambda: "\n".join("".join(r.choices("ab é", k=r.randrange(0, 20))) for _ in range(r.randrange(0, 6)))
    rows = [(i, text(), text(), text()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, e string, r string, c string")
    for most in (0, 10, 60, 100, 140, 10_000):
        got = df.select("i", budgeted(F.col("e"), F.col("r"), F.col("c"), most).alias("b")).collect()
        for x in got:
            assert list(x["b"]) == list(trimmed(rows[x["i"]][1:], most)), (most, rows[x["i"]])


def test_ranking(spark):
    r = random.Random(2)
    words = ["alpha", "Beta", "be", "a", "x1", "é", "gamma.2", "no-go", "日本", "2_b", "", "bet"]
    line = lambda n: " ".join(r.choices(words, k=n))
    chunks = [(p, i, line(r.randrange(0, 9)) if r.random() < 0.95 else None) for p in range(4) for i in range(8)]
    asked = [(q, r.randrange(0, 5), line(r.randrange(0, 5)) if q else None) for q in range(60)]
    got = {}
    for x in ranked(spark.createDataFrame(asked, "question_id int, paper_id int, text string"), spark.createDataFrame(chunks, "paper_id int, chunk_index int, text string"), 3).collect():
        got.setdefault(x["question_id"], []).append((x["rank"], x["chunk_index"], x["score"]))
    for q, p, text in asked:
        tokens = {t.lower() for t in re.findall(r"[a-zA-Z0-9][\w.-]*", text or "") if len(t) >= 2}
        score = sorted(((-sum(t in (c or "").lower() for t in tokens), i) for pp, i, c in chunks if pp == p))[:3]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(score)]


def chunks_by_hand(text, most, least, ratio):
    """The rule written out over a list of (title, body, start)."""
    if not (text or "").strip():
        return []
    names = "|".join(re.escape(t) for t in m.SECTION_TITLES["STEM"])
    at = list(re.finditer(rf"^\s*(?:(?:\d+(?:\.\d+)*\s+[.\-]?\s*)|(?:[IVXivx]+\.\s*))?({names})\s*(?:[:.\-]?\s*)*$", text, re.M | re.I))
    parts = [(None, text, 0)] if not at else [(None, text[: at[0].start()].strip(), 0)] + [(a.group(1), text[a.end() : b].strip(), a.end()) for a, b in zip(at, [x.start() for x in at[1:]] + [len(text)])]
    over = int(most * ratio)
    budget = most - over
    if budget < 200:
        over, budget = 0, most
    out = []
    for title, body, start in parts:
        if not body.strip():
            continue
        if len(body) <= most:
            pieces = [[body, start, start + len(body)]]
        else:
            pieces, cur, pos = [], "", start
            for para in [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]:
                if len(para) > budget:
                    if cur:
                        pieces.append([cur.strip(), pos, pos + len(cur.strip())])
                        cur = ""
                    for s in re.split(r"(?<=[.!?。！？])\s+", para):
                        if cur and len(cur) + len(s) + 1 > budget:
                            pieces.append([cur.strip(), pos, pos + len(cur.strip())])
                            cur, pos = "", pos + len(cur.strip()) + 1
                        cur += s + " "
                else:
                    if cur and len(cur) + len(para) + 2 > budget:
                        pieces.append([cur.strip(), pos, pos + len(cur.strip())])
                        cur, pos = "", pos + len(cur.strip()) + 1
                    cur += para + "\n\n"
            if cur.strip():
                pieces.append([cur.strip(), pos, pos + len(cur.strip())])
            if over:
                heads = [None] + [p[0][-over:].strip() if len(p[0]) > over else p[0] for p in pieces[:-1]]
                pieces = [p if h is None else [f"{h}\n\n{p[0]}".strip(), max(start, p[1] - len(h)), p[2]] for p, h in zip(pieces, heads)]
        for t, a, b in pieces:
            if out and len(t) < least:
                out[-1] = [out[-1][0], f"{out[-1][1]}\n\n{t}".strip(), out[-1][2], b]
            else:
                out.append([title, t, a, b])
    if len(out) > 1 and len(out[0][1]) < least:
        out[:2] = [[out[1][0], f"{out[0][1]}\n\n{out[1][1]}".strip(), out[0][2], out[1][3]]]
    return [tuple(x) for x in out]


def test_extraction_chunks(spark):
    r = random.Random(3)
    parts = ["Abstract\n", "1. Introduction\n", "II. Methods:\n", "Some words here. ", "More of them! ", "x" * 90 + " ", "\n\n", "\n", "Results", "  ", "é? "]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 60))) for _ in range(120)] + [None, "", "  \n", "Abstract", "a. " * 2000, "b" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for most, least, ratio in ((300, 60, 0.0), (400, 50, 0.2), (12_000, 500, 0.0), (210, 1, 0.5)):
        got = {}
        for x in chunked(df, most=most, least=least, overlap_ratio=ratio).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(x["doc_id"], []).append(tuple(x)[2:])
        for i, t in enumerate(texts):
            assert got.get(i, []) == chunks_by_hand(t, most, least, ratio), (i, most)


def test_ranked_word_that_grows_in_lower_case(spark):
    """The small letter of a dotted capital I has a mark that is no letter; the word still stands in the chunk. Chunks given twice count once."""
    asked = spark.createDataFrame([(1, 7, "aİb, cd"), (2, 8, "aİb")], "question_id int, paper_id int, text string")
    chunks = spark.createDataFrame([(7, 0, "none"), (7, 1, "xaİb cd cde"), (7, 1, "xaİb cd cde"), (7, 2, None), (9, 0, "aİb")], "paper_id int, chunk_index int, text string")
    got = ranked(asked, chunks, 2).collect()
    assert sorted((x["question_id"], x["rank"], x["chunk_index"], x["score"]) for x in got) == [(1, 1, 1, 2), (1, 2, 0, 0)]
