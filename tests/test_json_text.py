"""H24 against a scan in Python."""

import random
import re

from inkweave.functions.jsontext import json_block, json_repaired


def block(raw):
    text = raw.strip()
    if m := re.match(r"^```(?:json)?\s*([\s\S]*?)```\s*$", text, re.I):
        text = m[1].strip()
    at = re.search(r"[\[{]", text)
    if not at or at.start() == 0:
        return text
    tail, depth, inside, i = text[at.start() :], 0, False, 0
    while i < len(tail):
        c = tail[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            inside = not inside
        elif not inside and c == tail[0]:
            depth += 1
        elif not inside and c == "}]"["{[".index(tail[0])]:
            depth -= 1
            if depth == 0:
                return tail[: i + 1]
        i += 1
    return tail


def test_blocks_equal_a_scan(spark):
    r = random.Random(8)
    parts = ["{", "}", "[", "]", '"', "\\", "\\\\", "a", " ", "\n", "é😀", ":", ",", "1", "```", "```json\n", '{"k": "v}"}']
    raws = ["".join(r.choices(parts, k=r.randrange(0, 16))) for _ in range(1500)]
    raws += ["", "  ", "no json", 'so: {"a": [1, "}"]} and {"b": 2}', '```json\n{"a": 1}\n```', "x " + "{" * 3000 + "}" * 3000, 'y {"' + '\\"' * 5000 + '"} z']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").repartition(2).select("i", json_block(rows_raw()).alias("b")).collect()
    for x in rows:
        assert x["b"] == block(raws[x["i"]]), (raws[x["i"]], x["b"], block(raws[x["i"]]))


def rows_raw():
    from pyspark.sql import functions as F

    return F.col("raw")


def test_repairs(spark):
    cases = {
        'say {"a": 1} ok': '{"a": 1}', '{"a": [1, 2': '{"a": [1, 2]}', '{"a": "x': '{"a": "x"}', '{"a": "x\\': '{"a": "x"}', '{"a":': '{"a":null}', '{"a": 1,': '{"a": 1}',
        '{"a": [1, ], }': '{"a": [1 ] }', '{"a": True, "b": None}': '{"a": true, "b": null}', "none": None, "": None, "{a b}": None, "```\n[1]\n```": "[1]", None: None,
    }
    got = dict(spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", json_repaired(rows_raw())).collect())
    assert {k: v and v.replace(" ", "") for k, v in got.items()} == {k: v and v.replace(" ", "") for k, v in cases.items()}
