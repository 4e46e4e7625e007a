"""Checks, routing, pair insights and report rules over whole tables.

Columns in, Columns out where a rule looks at one row; DataFrames where it joins or groups. Joins are on the paper or on
the key of a pair, so a paper's rows meet those of its own pairs only; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..shared import shared_folder, written
from . import graph as g

# Words of chunk titles in the order they are looked for, and per paradigm the node types they hide.
MASK_WORDS = ("experiments", "results", "methods", "theoretical framework", "analysis")
MASKED_TYPES = {
    ("STEM", "experiments"): ("ResearchQuestion",), ("STEM", "results"): ("ResearchQuestion",), ("STEM", "methods"): ("ResearchQuestion", "Baseline", "Claim"),
    ("HSS", "theoretical framework"): ("ObjectOrData",), ("HSS", "analysis"): ("IntellectualContext",),
}
MASK_NODES = 80
# Types to cite first, per question scale and paradigm (None: whatever the paradigm).
PREFERRED_TYPES = {
    ("cross_paper", None): (), ("summary", None): ("Thesis", "ResearchQuestion"),
    ("detail", "STEM"): ("Method", "SubArgument", "Claim"), ("detail", "HSS"): ("SubArgument", "Method", "Thesis"),
    ("verification", "STEM"): ("Evidence", "Claim", "Dataset", "Experiment"), ("verification", "HSS"): ("AnalyticalLens", "ObjectOrData", "Evidence", "Thesis"),
}
# Limits of chunked extraction and of failure summaries.
MAX_CHUNKS, INPUT_CHARS, INPUT_MARGIN, LEAST_CHUNK, SUMMARY_CHARS = 1000, 20_000, 500, 1000, 200


def node_list_check(nodes: DataFrame, types=m.STEM_NODE_TYPES) -> DataFrame:
    """Per paper with nodes: their number, ids that occur again, nodes of other types, and whether the list is accepted."""
    odd = F.coalesce(~F.col("type").isin(*types), F.lit(True))
    ids = nodes.groupBy("paper_id", "id").agg(F.count("*").alias("n"), F.count(F.when(odd, 1)).alias("odd"))
    out = ids.groupBy("paper_id").agg(F.sum("n").alias("n_nodes"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"), F.sum("odd").alias("n_odd"))
    return out.withColumn("accepted", (F.col("n_repeated") == 0) & (F.col("n_odd") == 0))


def edge_list_check(edges: DataFrame, nodes: DataFrame, order: str, types=m.STEM_EDGE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(edges, of one id the first by `order`; per paper n_edges, the warning that names repeated ids, accepted)."""
    first = Window.partitionBy("paper_id", "id").orderBy(order)
    kept = edges.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    # one shuffle of the edges: of each id how often it stands and its first edge
    ids = edges.groupBy("paper_id", "id").agg(F.count("*").alias("n"), F.min_by(F.struct("source", "target", "type"), F.struct(order)).alias("e")).select("paper_id", "id", "n", "e.*")
    ids = written(ids, shared_folder(edges.sparkSession), "ids")
    again = ids.where("n > 1").groupBy("paper_id").agg(F.concat(F.lit("DUPLICATE_EDGE_IDS_DEDUPLICATED:"), F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("warning"))
    odd = F.col("type").isin(*m.FORBIDDEN_EDGE_TYPES) | ~(F.col("type").isin(*types) | F.col("type").rlike(m.DYNAMIC_EDGE_TYPE))
    count = ids.groupBy("paper_id").agg(F.count("*").alias("n_edges"), F.count(F.when(F.coalesce(odd, F.lit(True)), 1)).alias("n_odd"))
    loose = g.endpoints(ids).distinct().join(nodes.select("paper_id", "id"), ["paper_id", "id"], "left_anti").select("paper_id").distinct().withColumn("loose", F.lit(True))
    report = count.join(again, "paper_id", "left").join(loose, "paper_id", "left")
    return kept, report.select("paper_id", "n_edges", "warning", ((F.col("n_odd") == 0) & F.col("loose").isNull()).alias("accepted"))


def graph_check(papers: DataFrame, nodes: DataFrame, edges: DataFrame, node_types=m.STEM_NODE_TYPES, edge_types=m.STEM_EDGE_TYPES) -> DataFrame:
    """Per paper the broken rules of violations(), 0 for a graph without nodes or without edges, and the verdict."""
    has = lambda d, name: d.select("paper_id").distinct().withColumn(name, F.lit(True))
    bad = g.violations(nodes, edges, node_types, edge_types).groupBy("paper_id").agg(F.array_sort(F.collect_list("rule")).alias("bad"))
    out = papers.join(has(nodes, "n"), "paper_id", "left").join(has(edges, "e"), "paper_id", "left").join(bad, "paper_id", "left")
    rules = F.array_join(F.concat(F.when(F.col("n").isNull() | F.col("e").isNull(), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.coalesce("bad", F.array().cast("array<int>"))), ",")
    return out.select("paper_id", rules.alias("rules"), (rules == "").alias("accepted"))


def masked_nodes(nodes: DataFrame, chunks: DataFrame, most: int = MASK_NODES) -> DataFrame:
    """P10: nodes each chunk (paper_id, chunk_id, title, paradigm) shows: all, or without the types its title's first mask word hides if the paper has more than `most`."""
    size = nodes.groupBy("paper_id").agg(F.count("*").alias("__n"))
    word = F.coalesce(*[F.when(F.lower("title").contains(w), F.lit(w)) for w in MASK_WORDS])
    hidden = F.coalesce(*[F.when((F.col("paradigm") == p) & (F.col("__w") == w), F.array(*map(F.lit, ts))) for (p, w), ts in MASKED_TYPES.items()])
    ready = chunks.join(size, "paper_id").withColumn("__w", word).withColumn("__hidden", F.when(F.col("__n") > most, hidden))
    out = ready.select("paper_id", "chunk_id", "__hidden").join(nodes, "paper_id")
    return out.where(F.col("__hidden").isNull() | ~F.array_contains("__hidden", F.col("type"))).drop("__hidden")


def preferred_types(scale: Column, paradigm: Column) -> Column:
    """Node types to cite first; other scales than the four are null, other paradigms than STEM count as HSS."""
    side = F.when(paradigm == "STEM", "STEM").otherwise("HSS")
    cases = [F.when((scale == s) & (F.lit(True) if p is None else side == p), F.array(*map(F.lit, ts)).cast("array<string>")) for (s, p), ts in PREFERRED_TYPES.items()]
    return F.coalesce(*cases)


def paradigm_gate(a: Column, b: Column) -> Column:
    """Reason for which a pair of papers has no method overlap, null if it may have one."""
    return F.when((a == "HSS") | (b == "HSS"), "PARADIGM_UNSUPPORTED")


def route(failed: Column, background: Column | None = None) -> Column:
    """Next step of a workflow; without `background` the step can't be put off."""
    out = F.when(F.coalesce(failed, F.lit(False)), "fail")
    out = out if background is None else out.when(F.coalesce(background, F.lit(False)), "background")
    return out.otherwise("continue")


def anchor_refs(pairs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """For pairs (paper_a, paper_b, norm) the nodes of type `kind` of either paper with that label; side 0 is paper_a."""
    named = nodes.where(F.col("type") == kind).select("paper_id", F.lower(F.trim("label")).alias("norm"), F.col("id").alias("node_id"))
    both = pairs.select("paper_a", "paper_b", "norm", F.posexplode(F.array("paper_a", "paper_b")).alias("side", "paper_id"))
    return both.join(named, ["paper_id", "norm"]).groupBy("paper_a", "paper_b", "paper_id", "node_id").agg(F.min("side").alias("side"))


#: Fixed patterns: a citation of a chunk inside a text, and an older form of ids.
CITED_CHUNK, OLDER_ID = r"(?i)\[cite\s*:\s*chunk\s*:\s*([^\]]+)\]", r"^([\w-]+)_chunk_(\d+)$"


def chunk_citation(raw: Column) -> Column:
    """The chunk id that a raw citation means: without outer blanks and brackets, taken out of a citation in a longer
    text, no blanks around colons, older ids (p_chunk_3) as p:chunk:3. Null stays null, blank gives ''."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^[\[\]]+|[\[\]]+$", "")
    inside = F.regexp_extract(bare, CITED_CHUNK, 1)
    bare = F.regexp_replace(F.when(inside != "", inside).otherwise(bare), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s*:\s*", ":"), OLDER_ID, "$1:chunk:$2")


def resolved_chunks(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited (key, cited) with chunk_id of the key's chunks (key, chunk_id), by chunk_citation() of what is cited: equal, else the only one that ends in ':' and the citation, else the only one with its last segment, else null.

    A chunk is listed under each of its tails ("a:b:c", "b:c", "c"), so all three are equi-joins.
    """
    parts = F.split("chunk_id", ":")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ":"))
    listed = chunks.distinct().select("key", "chunk_id", F.explode(tails).alias("tail"))
    only = listed.groupBy("key", "tail").agg(F.max(F.when(F.col("tail") == F.col("chunk_id"), F.col("chunk_id"))).alias("same"), F.count(F.when(F.col("tail") != F.col("chunk_id"), 1)).alias("n"), F.max(F.when(F.col("tail") != F.col("chunk_id"), F.col("chunk_id"))).alias("end"), F.count("*").alias("n_last"), F.max("chunk_id").alias("last"))
    first = only.select("key", F.col("tail").alias("meant"), "same", F.when(F.col("n") == 1, F.col("end")).alias("end"))
    # the last segment "c" is a tail of exactly the chunks that have it as their last segment
    last = only.where(~F.col("tail").contains(":")).select("key", F.col("tail").alias("segment"), F.when(F.col("n_last") == 1, F.col("last")).alias("last"))
    out = cited.withColumn("meant", chunk_citation(F.col("cited"))).join(first, ["key", "meant"], "left").withColumn("segment", F.element_at(F.split("meant", ":"), -1)).join(last, ["key", "segment"], "left")
    return out.withColumn("chunk_id", F.when(F.col("meant") != "", F.coalesce("same", "end", "last"))).drop("meant", "segment", "same", "end", "last")


def shortlist(candidates: DataFrame, pair: list[str], coarse: float = 0.42, most: int = 8) -> DataFrame:
    """Of each pair's candidates (left_id, right_id, coarse_score) of at least `coarse` the `most` best; ties by ids."""
    order = Window.partitionBy(*pair).orderBy(F.col("coarse_score").desc(), "left_id", "right_id")
    return candidates.where(F.col("coarse_score") >= coarse).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def aligned_questions(candidates: DataFrame, pair: list[str], rerank: float | None = 0.6, strict: float = 0.75) -> DataFrame:
    """Each pair's aligned questions: of the shortlist the one of best rerank_score from `rerank` on (the first of equal ones); without reranker (None) the best coarse one if it reaches `strict`."""
    short = shortlist(candidates, pair)
    if rerank is None:
        return short.where((F.col("rank") == 1) & (F.col("coarse_score") >= strict)).drop("rank")
    best = Window.partitionBy(*pair).orderBy(F.col("rerank_score").desc(), "rank")
    return short.where(F.col("rerank_score") >= rerank).withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth", "rank")


def contradictions(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per pair (paper_a, paper_b) of papers ready with the primary theses and their conflict, or insufficient_data with the missing type (theses are looked at first) and the papers that lack it."""
    thesis = g.primary_nodes(nodes.where("type = 'Thesis'"), edges).select("paper_id", "id", "label")
    subs = nodes.where("type = 'SubArgument'").select("paper_id").distinct().withColumn("sub", F.lit(True))
    about = thesis.join(subs, "paper_id", "full")
    side = lambda s: about.select(F.col("paper_id").alias(f"paper_{s}"), F.col("id").alias(f"node_{s}"), F.col("label").alias(f"point_{s}"), F.col("sub").alias(f"sub_{s}"))
    both = pairs.join(side("a"), "paper_a", "left").join(side("b"), "paper_b", "left")
    lacking = lambda c: F.concat_ws(",", *[F.when(F.col(f"{c}_{s}").isNull(), F.col(f"paper_{s}").cast("string")) for s in "ab"])
    both = both.withColumn("no_thesis", lacking("node")).withColumn("no_sub", lacking("sub"))
    missing = F.when(F.col("no_thesis") != "", "Thesis").when(F.col("no_sub") != "", "SubArgument")
    conflict = F.when(F.lower(F.trim("point_a")) == F.lower(F.trim("point_b")), "none").otherwise("potential")
    return both.withColumn("missing_type", missing).select(
        "paper_a", "paper_b", F.when(F.col("missing_type").isNull(), "ready").otherwise("insufficient_data").alias("status"), "missing_type",
        F.when(F.col("missing_type") == "Thesis", F.col("no_thesis")).when(F.col("missing_type") == "SubArgument", F.col("no_sub")).alias("affected_papers"),
        *[F.when(F.coalesce(F.col("missing_type") != "Thesis", F.lit(True)), F.col(f"node_{s}")).alias(f"node_{s}") for s in "ab"], F.when(F.col("missing_type").isNull(), conflict).alias("conflict_type"),
    )


def exclusion(insights: DataFrame, phase: str = "node_precheck") -> DataFrame:
    """Insights (status, missing_type, affected_papers) with exclusion_logic, a struct where status is insufficient_data, else null."""
    metrics = F.struct(F.col("missing_type").alias("missing_node_type"), F.split("affected_papers", ",").alias("affected_papers"))
    payload = F.struct(F.lit("MISSING_REQUIRED_NODES").alias("reason_code"), F.lit(phase).alias("phase"), metrics.alias("metrics"))
    return insights.withColumn("exclusion_logic", F.when(F.col("status") == "insufficient_data", payload))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def handler_warning(kind: Column, error: Column, error_class: Column, most: int = SUMMARY_CHARS) -> Column:
    """Warning of a failed event handler; an empty message gives way to the error's class, longer ones end in '...'."""
    text = F.coalesce(F.nullif(F.trim(error, F.lit(" \t\n\r\x0b\x0c")), F.lit("")), error_class)
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("event_handler_failed: Handler "), kind, F.lit(" failed: "), short)


def with_notice(summary: Column, label: Column, papers: Column) -> Column:
    """Summary with its degradation notice (label, and papers joined by ', ' if there are any) once at the end; null label: none."""
    named = F.when(papers != "", F.concat(F.lit("；受影响论文："), papers)).otherwise("")
    suffix = F.concat(F.lit("（提示："), label, named, F.lit("）"))
    return F.when(label.isNull() | F.contains(summary, suffix), summary).otherwise(F.concat(F.rtrim(summary), F.lit(" "), suffix))


def chunk_rows(paper: Column, texts: Column, most: int | None = None) -> Column:
    """(chunk_id, text) of a paper's texts in order, numbered from 0; at most `most` of them."""
    kept = texts if most is None else F.slice(texts, 1, most)
    return F.transform(kept, lambda t, i: F.struct(F.concat(paper, F.lit(":chunk:"), i.cast("string")).alias("chunk_id"), t.alias("text")))


def chunk_chars(head: Column, requested: Column) -> Column:
    """Characters a chunk may have beside a head of `head` characters (null: none); a head that leaves too little room is disregarded."""
    room = F.lit(INPUT_CHARS - INPUT_MARGIN) - F.coalesce(head, F.lit(0))
    return F.least(requested, F.when(room < LEAST_CHUNK, INPUT_CHARS - INPUT_MARGIN).otherwise(room))


def ordered_union(have: Column, more: Column) -> Column:
    """Entries of both lists without repeats, in the order they first occur; null is an empty list."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(have, none), F.coalesce(more, none)))


def prompt_section(prompt: Column, heading: str) -> Column:
    """What follows '### heading' up to the next '### ' line, else the next '## ' line, else the end; '' without heading."""
    rest = F.substring_index(prompt, f"### {heading}", 1)
    rest = F.when(F.contains(prompt, F.lit(f"### {heading}")), F.substr(prompt, F.length(rest) + len(heading) + 5)).otherwise("")
    return F.when(F.contains(rest, F.lit("\n### ")), F.substring_index(rest, "\n### ", 1)).otherwise(F.substring_index(rest, "\n## ", 1))


def section_fingerprint(section: Column) -> Column:
    """Lines without white space, sorted and joined."""
    lines = F.transform(F.split(section, r"\r\n|\n|\r"), lambda line: F.regexp_replace(line, r"(?U)\s+", ""))
    return F.array_join(F.array_sort(F.filter(lines, lambda line: line != "")), "")


def prompt_subgraph(nodes: Column, edges: Column, seen_nodes: Column, seen_edges: Column) -> Column:
    """The retrieved half of a prompt's graph (null or empty: absent) and what a search found (seen_*) for the missing one."""
    have = lambda c: F.when(F.size(c) > 0, c)
    return F.struct(F.coalesce(have(nodes), seen_nodes).alias("nodes"), F.coalesce(have(edges), seen_edges).alias("edges"))


def pass_rate(cases: DataFrame, key: list[str]) -> DataFrame:
    """Cases, passed, failed and pass_rate of boolean `passed`; drift-guarded cases are those whose `drift_passed` isn't null."""
    yes = lambda c: F.count(F.when(F.col(c), 1))
    out = cases.groupBy(*key).agg(F.count("*").alias("cases"), yes("passed").alias("passed"), F.count("drift_passed").alias("drift_cases"), yes("drift_passed").alias("drift_passed"))
    return out.withColumn("failed", F.col("cases") - F.col("passed")).withColumn("pass_rate", F.round(F.try_divide("passed", "cases"), 4))


def graph_source(status: Column, stored: Column, preview: Column) -> Column:
    """Which graph a paper's readers get: stored in ready statuses, else the preview, else GRAPH_NOT_READY."""
    ready = status.isin("ready", "ready_with_warnings")
    return F.when(ready & stored, "stored").when(~ready & preview, "preview").otherwise("GRAPH_NOT_READY")


def paper_summary(papers: DataFrame) -> DataFrame:
    """Papers with empty titles as null, null warning lists as empty ones; a status that doesn't exist is an error."""
    known = F.col("status").isin(*sorted({s for pair in m.TRANSITIONS for s in pair}))
    status = F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))))
    return papers.withColumn("title", F.nullif(F.col("title"), F.lit(""))).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).withColumn("status", status)


def cascade(zombies: DataFrame) -> DataFrame:
    """The changes that end each zombie (paper_id, owner): its claim released, its row failed, its generation cleared, in this order."""
    change = lambda table, column, value: F.struct(F.lit(table).alias("store"), F.lit(column).alias("field"), value.cast("string").alias("value"))
    none = F.lit(None)
    steps = F.array(change("claims", "owner", none), change("papers", "status", F.lit("failed")), change("pipeline_runs", "error_code", F.lit("PROCESS_TIMEOUT")), change("pipeline_runs", "generation_id", none))
    return zombies.select("paper_id", F.posexplode(steps).alias("step", "c")).select("paper_id", "step", "c.*")


def index_timeouts(starts: DataFrame, seconds: int = 120) -> DataFrame:
    """Starts (paper_id, ts, ended) of index runs that took longer than `seconds` or, where ended is null, may still: when each is cancelled."""
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    return starts.withColumn("cancelled_at", F.when(F.col("ended").isNull() | (F.col("ended") > limit), limit)).where("cancelled_at is not null")
