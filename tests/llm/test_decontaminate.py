"""Operator 5: names that open sentences, partial passages."""

from inkweave.llm import decontaminate as dc


def judged(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r["doc_id"]: (r["contaminated"], r["coverage"]) for r in dc.decontaminate(d, b).collect()}


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more. How many does Tom have?"
    docs = [
        item.replace("Tom", "Sue"),
        f"Some words before.\n\"{item.replace('Tom', 'Sue').replace('5', '8')}\" (And after.)",
        item.replace("Tom has", "Now, Sue has").replace("Tom", "Sue"),  # the first name opens no sentence here
        item.lower(),  # windows without the name inside a sentence match
        "Sue has 5 apples. Bob buys 3 more. How many does Ann have?",  # one name became three
        "Sue had 5 pears. Sue lost 3 there. Why does nobody tell Sue that?",
    ]
    got = judged(spark, docs, [item])
    assert {i: v[0] for i, v in got.items()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert got[0][1] == got[1][1] == got[2][1] == 1.0 and got[3][1] < 1.0 and got[4][1] < 1.0


def test_words_that_open_sentences_stay_literals(spark):
    item = "The red box holds coins. Every coin weighs as much as two beans. Then nobody counts them"
    got = judged(spark, [item, item.lower(), item.replace(". ", ", ").replace("Every", "every").replace("Then", "then")], [item])
    assert all(v == (1, 1.0) for v in got.values())


def test_partial_passages_of_the_longest_items(spark):
    items = sorted((r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()), key=lambda t: -len(t.split()))[:2]
    items.append(" ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)))
    plain = [w.split() for w in items]
    assert len(plain[0]) > 50
    own = plain[2]
    docs = ["before it " + " ".join(own[20:33]) + " after it", " ".join(own[20:32]), " ".join(own[:19]), "x y " + " ".join(own[46:])]
    docs += [" ".join(own[:12] + ["gap"] + own[12:20])]  # windows in two runs, each too short
    docs += [" ".join(plain[0][10:30]), " ".join(plain[1][-20:])]
    got = judged(spark, docs, items)
    assert {i: v[0] for i, v in got.items()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1}
    assert got[0][1] < dc.COVER


def test_runs_do_not_go_over_rows(spark):
    own = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    rows = [(1, " ".join(own[:11])), (1, " ".join(["x"] * 4 + own[4:15]))]  # the second goes on at the same places
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(own))], "item_id long, text string")
    assert dc.decontaminate(d, b).where("contaminated = 1").count() == 0


def test_copies_in_any_case(spark):
    item = "How many apples does Tom have, if Tom starts with 12 apples, walks 5 km to Anna Miller and gives her 3 of them for free?"
    docs = [item, item.upper(), item.lower(), item.title(), "BEFORE IT " + item.upper() + " AND AFTER IT", item.upper().replace("12", "40"), "NOTHING OF THIS IS IN ANY ITEM AT ALL, SAYS TOM TO ANNA"]
    got = judged(spark, docs, [item])
    assert {i: v[0] for i, v in got.items()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    assert all(got[i][1] == 1.0 for i in (0, 1, 3, 4)) and 0.5 < got[2][1] < 1.0


def _brute(docs, items, window=dc.WINDOW, cover=dc.COVER, run=dc.RUN):
    """The rule over token lists, every window of a document with every window of an item; coverage of each leak."""

    def mark(w, way):
        if w[0] == dc.FIRST:
            return dc.NAME if way == dc.NAMED else w[1:]
        if w[0] == dc.NAME and way == dc.PLAIN:
            return w[1:]
        return w[0] if w[0] < "\u0006" else w

    def kind(w):
        return {dc.FIRST: "first", dc.NAME: "name", dc.NUMBER: "value", dc.UNIT: "value"}.get(w[0], "word")

    def match(d, i):
        if not any(all(mark(x, way) == mark(y, way) for x, y in zip(d, i)) for way in dc.WAYS):
            return False
        slots = []
        for x, y in zip(d, i):
            kinds = {kind(x), kind(y)}
            same = mark(x, dc.PLAIN) == mark(y, dc.PLAIN)
            if not same or "value" in kinds or ("name" in kinds and "word" not in kinds):
                slots.append(tuple(dc.NAME + w[1:] if kind(w) == "first" else w for w in (x, y)))
        one = len(set(slots))
        if one != len({x for x, _ in slots}) or one != len({y for _, y in slots}):
            return False
        return 2 * len(slots) <= len(d) or all(x == y for x, y in slots)

    out = {}
    for di, d in docs.items():
        for ii, i in items.items():
            n = min(window, len(i))
            hits = {(p, q) for q in range(len(i) - n + 1) for p in range(len(d) - n + 1) if n and match(d[p:p + n], i[q:q + n])}
            long = 0
            for p, q in hits:
                k = 0
                while (p + k, q + k) in hits:
                    k += 1
                long = max(long, k + n - 1)
            full = {q for p, q in hits if all(kind(y) != "name" or kind(x) != "word" for x, y in zip(d[p:p + n], i[q:q + n]))}
            share = (len({q for _, q in hits}) + len(full)) / (len(i) - n + 1) / 2 if n else 0.0
            if hits and (share >= cover or long >= run):
                out[di, ii] = share
    return out


def _items(spark, most=14):
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()
    names = ["Tom", "Anna", "Ravi", "Lena"]
    out = []
    for k, r in enumerate(rows[:most]):  # items with names and numbers put between their words
        w = r["text"].split()[:40]
        for at in range(3, len(w), 6):
            w[at] = names[(k + at) % 4] if at % 2 else f"{k * 7 + at} km"
        out.append(" ".join(w))
    return out


def test_whole_rule_against_brute_force_and_recall(spark):
    items = _items(spark)
    swap = {"Tom": "Sue", "Anna": "Bela", "Ravi": "Omar", "Lena": "Ida"}
    docs, truth = [], []
    for k, item in enumerate(items):
        w = item.split()
        renamed = " ".join(swap.get(x, str(int(x) + 100) if x.isdigit() else x) for x in w)
        half = " ".join(w[len(w) // 4:len(w) // 4 + max(len(w) // 2, 1)])
        for d in (renamed, item.upper(), item.lower(), item.title(), "so it goes " + half + " and on"):
            docs.append(d)
            truth.append(k)
    clean = len(docs)
    docs += [" ".join(reversed(i.split())) for i in items] + ["", "12 KM", "Tom " * 20]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    toks = lambda df, key: {r[0]: r[1] for r in df.select(key, dc.tokens(df["text"])).collect()}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in dc.leaks(d, b).collect()}
    assert got == _brute(toks(d, "doc_id"), toks(b, "item_id"))
    found = sum((i, t) in got for i, t in enumerate(truth)) / len(truth)
    assert found >= 0.9, found
    assert not any(i >= clean and i < clean + len(items) and len(items[i - clean].split()) > 8 for i, _ in got)
