"""Streams are the same for every way to cut or order what comes in."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from inkweave.streaming.answers import CJK_MARKS, Cleaner, Splitter, answer_events, cleaned
from inkweave.streaming.runs import drained
from inkweave.streaming.watchdog import stuck_indexing

BEFORE = rf" +([{re.escape(CJK_MARKS)}])"
PARTS = ["a", "b ", "`", "*", "**", "#", "# ", "\n", "  ", "\t", "。", "，", "x y", "[CITE:", "[CITE:n1]", "`[CITE:edge:e2]`", "[", "]", "[CI", "TE:", "p]", "page:3"]


def whole(t):
    """The rules on a whole text, by look-ahead."""
    out, held, mode, i, fresh, n = [], "", None, 0, True, len(t)
    while i < n:
        c = t[i]
        if mode and (c == "`" if mode == "`" else t[i : i + 2] == "**"):
            fresh = held.endswith(("\n", "\r")) if held else fresh
            out.append(held)
            i += len(mode)
            held, mode = "", None
        elif mode == "**" and c == "*" and i + 1 == n:
            i += 1
        elif mode:
            held += c
            i += 1
        elif c == "`" or t[i : i + 2] == "**":
            mode = c if c == "`" else "**"
            i += len(mode)
        elif c == "*":
            i += 1
        elif c == "#" and fresh:
            i, fresh = i + len(re.match("[# ]*", t[i:])[0]), False
        else:
            out.append(c)
            fresh = c in "\n\r"
            i += 1
    text = re.sub(BEFORE, r"\1", "".join(out))
    solid = text.rstrip(" \t")
    held = re.sub(" {2,}", " ", held)
    rest = held if held and text != solid and held[0] in CJK_MARKS else text[len(solid) :] + held
    return solid + re.sub(BEFORE, r"\1", rest)


def joined(events):
    out = {}
    for place, kind, value in events:
        at = out.setdefault(place, ["", None])
        if kind == "message":
            at[0] += value
        else:
            at[1] = (kind, value)
    return {k: v for k, v in out.items() if v != ["", None]}


def cut(r, t):
    at = sorted(r.randrange(0, len(t) + 1) for _ in range(r.randrange(0, 6)))
    return [t[a:b] for a, b in zip([0, *at], [*at, len(t)])]


def test_cleaner_equals_the_rules():
    r = random.Random(2)
    for _ in range(6000):
        t = "".join(r.choices(PARTS[:13], k=r.randrange(0, 14)))
        c = Cleaner()
        assert "".join(c.feed(p) for p in cut(r, t)) + c.flush() == whole(t)


def test_splitter_is_the_same_for_every_cut():
    r = random.Random(3)
    for _ in range(6000):
        t, kept, got = "".join(r.choices(PARTS, k=r.randrange(0, 14))), None, []
        parts = cut(r, t)
        for i, p in enumerate(parts):
            s = Splitter(kept)
            got += s.feed(p, i + 1 == len(parts))
            kept = s.kept()
        assert joined(got) == joined(Splitter().feed(t, True))


def test_markers_and_marks():
    # blanks wait across a marker
    got = joined(Splitter().feed("see **[x]** `[CITE:edge:e1]` and [CITE:n2], `a*b`[CITE:page:3]", True))
    assert got == {0: ["see [x]", ("edge", "e1")], 1: ["  and", ("node", "n2")], 2: [" , a*b", ("page", "3")]}
    assert cleaned("# Title\n**bold**  `x`  。 2*3") == "Title\nbold x。 23"
    assert cleaned("") == ""


AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream(spark, tmp_path, batches, schema, build):
    """Each batch is a file of its own, read one at a time in order."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return drained(spark, build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_over_several_batches(spark, tmp_path, seed):
    """Deltas of three answers in any order, with state between batches; the third has no end and is flushed by its timer."""
    r = random.Random(seed)
    texts = {i: "".join(r.choices(PARTS, k=30)) for i in range(3)}
    rows = []
    for i, t in texts.items():
        parts = [t[a : a + 7] for a in range(0, len(t), 7)]
        rows += [(i, n, p, n + 1 == len(parts) and i < 2, AT + timedelta(seconds=n)) for n, p in enumerate(parts)]
    r.shuffle(rows)
    later = [(9, 0, "end", True, AT + timedelta(hours=1)), (9, 1, "never taken", True, AT + timedelta(hours=1))]
    got = stream(spark, tmp_path, [rows[:8], rows[8:16], rows[16:], later, later[:1]], "answer_id long, seq long, text string, last boolean, at timestamp", answer_events)
    for i, t in texts.items():
        mine = sorted((x for x in got if x["answer_id"] == i), key=lambda x: x["seq"])
        assert joined([(x["place"], x["kind"], x["value"]) for x in mine]) == joined(Splitter().feed(t, True))


def test_watchdog_takes_late_rows_in_order(spark, tmp_path):
    s = lambda n: AT + timedelta(seconds=n)
    rows = [
        (1, 1, "indexing", s(0)), (2, 1, "indexing", s(250)),  # alive at 250, stuck at 340
        (3, 2, "indexing", s(0)), (4, 2, "ready", s(200)),  # done in time
        (5, 3, "indexing", s(0)),  # never heard of again: stuck at 300
        (6, 4, "indexing", s(0)), (8, 4, "indexing", s(450)), (9, 4, "ready", s(460)),  # 7, late, keeps it alive until 340 only
    ]
    late = [(7, 4, "indexing", s(249)), (10, 5, "pending", s(500))]
    end = [(11, 6, "pending", s(5000))]
    got = stream(spark, tmp_path, [rows, late, end, [(12, 6, "pending", s(5001))]], "event_id long, paper_id long, status string, ts timestamp", stuck_indexing)
    when = lambda t: int(t.timestamp() - s(0).timestamp())
    assert sorted((x["paper_id"], when(x["started"]), when(x["heartbeat"]), when(x["due"])) for x in got) == [(1, 0, 250, 340), (3, 0, 0, 300), (4, 0, 249, 339)]
