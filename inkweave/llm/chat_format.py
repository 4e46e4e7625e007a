"""Operator 2, chat formatting of preference pairs: common prefix of turns, prompt rendered once, masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (role and text equal) is the
prompt and rendered once; what follows in either is its completion. A turn is rendered as <|im_start|>role, line feed,
text, <|im_end|>, line feed. A completion's mask lists the character spans that are trained on: text and end marker of
assistant turns. Headers, the line feed after a turn and turns of other roles are masked. Markers inside a text get a space
after '<|', so that no text can open or close a turn.

The conversations table holds no rejected side. op2 makes one: the last assistant turn is replaced by that of the next
conversation that has one, in the cycle of the up to 64 conversations of equal conv_id div 64, all other turns being
kept. If no other conversation of the block has an assistant turn, the replaced turn is empty.

Cases: every conv_id gets one row; without assistant turn both sides are equal, all is prompt and the completions are
empty, as with equal replies; null role or text is the empty string; rows are ordered by turn, role and text, null turns
first, and repeated rows all stay; rows with null conv_id are one conversation in a block of its own; an empty table gives
an empty result; extra columns are ignored. One block is sorted by conv_id in a task, one conversation is held as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, OPEN, CLOSE, TRAINED = 64, "<|im_start|>", "<|im_end|>", "assistant"
SPANS = "array<struct<start:int,end:int>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit("\n"))


def _safe(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(?=im_(?:start|end)\|>)", "<| ")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(f"{CLOSE}\n"))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) of characters of render(turns) that are trained on."""
    head, body = lambda t: F.length(_head(t)), lambda t: F.length(_safe(t["text"])) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        end = begin + body(t)
        more = F.when(t["role"] == TRAINED, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """conv_id, n_prompt_turns, prompt, and completion and mask of either side of pairs (conv_id, chosen, rejected: arrays of role, text)."""
    cut = pairs.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    cut = cut.select("conv_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), rest(F.col("chosen")).alias("chosen"), rest(F.col("rejected")).alias("rejected"))
    return cut.select(
        "conv_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.col("prompt")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"),
        mask(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected"),
        mask(F.col("rejected")).alias("rejected_mask"),
    )


def pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected of every conversation."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # one shuffle by block serves the grouping and the window
    rows = rows.withColumn("block", F.floor(F.col("conv_id") / BLOCK)).repartition("block")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = rows.groupBy("block", "conv_id").agg(turns.alias("chosen"))
    last = F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == TRAINED, i)))
    whole = whole.withColumn("last", last).withColumn("reply", F.get("chosen", F.col("last"))["text"])
    order = Window.partitionBy("block").orderBy("conv_id")
    after = F.first("reply", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.first("reply", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.withColumn("other", F.coalesce(after, before, F.lit("")))
    swap = F.transform("chosen", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return whole.select("conv_id", "chosen", F.when(F.col("last").isNull(), F.col("chosen")).otherwise(swap).alias("rejected"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_pairs(pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
