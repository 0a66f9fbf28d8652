"""Preference pairs: a shared prompt and two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns (role and text in order) of each conversation.

    Rows are ordered by turn, then role and text, nulls first; a repeated row is a turn of its own. A conversation is
    one output value, so its turns meet in one row.
    """
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy(key).agg(held.alias("_t")).select(key, F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal (null equals null)."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    differ = F.array_position(same, False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """``<|role|>``, a line break, the text, ``<|end|>`` and a line break for each turn; null parts are empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column, trained: tuple[str, ...] = ("assistant",)) -> Column:
    """[begin, end) in code points of the rendered turns, one for each trained turn: its text and end mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_head(turn))
        end = begin + F.length(_body(turn))
        span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        own = F.coalesce(turn["role"].isin(*trained), F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(own, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """From pair_id, chosen and rejected (arrays of turns): pair_id, n_prompt_turns, prompt, chosen, rejected, and the
    loss spans chosen_mask and rejected_mask.

    The longest common turn prefix is rendered once as the prompt and never trained; each completion is the rest of its
    conversation. Equal conversations have empty completions and masks, and conversations without a common turn an
    empty prompt. A null side counts as a conversation without turns. Further columns of ``pairs`` are kept, whatever
    their names, but for those that the result has itself; repeated rows give repeated rows and an empty table none.
    """
    none = F.lit(None).cast(TURNS)
    made = ("chosen", "rejected", "n_prompt_turns", "prompt", "chosen_mask", "rejected_mask")
    own = [c for c in pairs.columns if c not in made]
    side = lambda c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS), none)
    given = pairs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in own]).alias("_row"), side("chosen").alias("_a"), side("rejected").alias("_b"))
    met = given.withColumn("_n", common_prefix(F.col("_a"), F.col("_b")))
    # behind the prefix the sides no longer meet, so each is cut by itself
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    cut = met.withColumn("_ra", rest(F.col("_a"))).withColumn("_rb", rest(F.col("_b")))
    return cut.select(
        *[F.col("_row").getField(c).alias(c) for c in own],
        F.col("_n").alias("n_prompt_turns"),
        render(F.slice("_a", F.lit(1), F.col("_n"))).alias("prompt"),
        render(F.col("_ra")).alias("chosen"),
        render(F.col("_rb")).alias("rejected"),
        loss_spans(F.col("_ra"), trained).alias("chosen_mask"),
        loss_spans(F.col("_rb"), trained).alias("rejected_mask"),
    )


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected from plain conversations, one pair for each.

    Chosen is the whole conversation. Rejected leaves it at one of its assistant turns, the conv_id's remainder by their
    number, with the assistant's reply before in that place, or an empty one at the first: a reply that ignores what was
    asked last, after which the conversation ends. So prefixes and completions have from none to all turns. Without an
    assistant turn both sides are the whole conversation. Null and empty parts are turns like any other.
    """
    held = conversations(turns)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    named = held.withColumn("_at", places).withColumn("_pick", F.when(F.size("_at") > 0, F.pmod(F.coalesce("conv_id", F.lit(0)).cast("long"), F.size("_at"))).cast("int"))
    spot, before = F.get("_at", F.col("_pick")), F.get("_at", F.col("_pick") - 1)
    wrong = F.struct(F.lit("assistant").alias("role"), F.coalesce(F.get("turns", before - 1)["text"], F.lit("")).alias("text"))
    left = F.concat(F.slice("turns", F.lit(1), F.coalesce(spot, F.lit(1)) - 1), F.array(wrong))
    return named.select(F.col("conv_id").alias("pair_id"), F.col("turns").cast(TURNS).alias("chosen"), F.when(F.size("_at") > 0, left).otherwise(F.col("turns")).cast(TURNS).alias("rejected"))
