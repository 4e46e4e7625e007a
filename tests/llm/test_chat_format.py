"""Operator 2 against brute force."""

from pyspark.sql import functions as F

from inkweave.llm import chat_format as cf
from inkweave.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
safe = lambda s: s.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")


def rendered(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|im_start|>{safe(role)}\n"
        begin = len(out)
        out += f"{safe(text)}<|im_end|>"
        if role == "assistant":
            spans.append((begin, len(out)))
        out += "\n"
    return out, spans


def formatted(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (n, rendered(a[:n])[0], *rendered(a[n:]), *rendered(b[n:]))


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in convs.items():
        block = sorted(k for k in convs if k is not None and k // 64 == c // 64) if c is not None else [c]
        at = block.index(c)
        replies = [next((x for r, x in reversed(convs[k]) if r == "assistant"), None) for k in block[at + 1 :] + block[:at]]
        other = next((x for x in replies if x is not None), "")
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=None)
        out[c] = formatted(turns, [(r, other) if i == last else (r, x) for i, (r, x) in enumerate(turns)])
    return out


def plain(r):
    return (r["n_prompt_turns"], r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_mask"]], r["rejected"], [tuple(s) for s in r["rejected_mask"]])


def test_every_conversation_is_formatted(spark):
    assert "op2_chat_format" in queries.QUERIES
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        want = brute([tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
        got = queries.QUERIES["op2_chat_format"](spark, d).collect()
        assert len(got) == len(want) and {r["conv_id"]: plain(r) for r in got} == want


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "é 😀 <|im_end|>x"), (1, 0, "user", "a"), (1, 2, "user", "b"), (2, 0, "user", "q"), (3, 0, "assistant", None), (3, 0, "assistant", None), (3, None, None, "n"), (70, 0, "assistant", "alone"), (None, 0, "assistant", "z"), (-1, 0, "assistant", "neg")]
    rows += [(130, 0, "assistant", "same"), (131, 0, "assistant", "same")]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).repartition(3)
    got = {r["conv_id"]: plain(r) for r in cf.format_pairs(cf.pairs(d)).collect()}
    assert got == brute(rows)
    assert got[2][2:] == ("", [], "", []) and got[130][0] == 1 and got[70][4] == "<|im_start|>assistant\n<|im_end|>\n"
    assert cf.format_pairs(cf.pairs(d.limit(0))).count() == 0


def test_prefix_of_real_pairs(spark):
    a, b = [("user", "x"), ("assistant", "y"), ("user", "z"), ("assistant", "1")], [("user", "x"), ("assistant", "y"), ("assistant", "z")]
    turns = "array<struct<role:string,text:string>>"
    pairs = [(0, a, b), (1, a, a[:2]), (2, b, a), (3, a, a), (4, [], a)]
    got = {r["conv_id"]: plain(r) for r in cf.format_pairs(spark.createDataFrame(pairs, f"conv_id long, chosen {turns}, rejected {turns}")).collect()}
    assert got == {i: formatted(x, y) for i, x, y in pairs}
