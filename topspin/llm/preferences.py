"""Preference formatting of conversations (operator 6); DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the prompt; the
turns behind it are the two completions. A completion is a list of segments, each with a flag that tells whether it counts in the
loss: headers and other speakers' turns are masked, the assistant's words (with the mark that ends them) are not.

Turns are aligned by their number, so both sides of a turn meet by ``(pair, turn)`` and even a pair with most of all turns is
dealt out until its one row of output is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_column: str = "pair_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", speaker: str = "assistant") -> DataFrame:
    """``(pair_column, prompt_turns, prompt, chosen_segments, chosen_loss, rejected_segments, rejected_loss)``, one row for each pair.

    ``chosen`` and ``rejected`` have a row for each turn. Null roles and texts count as empty; rows without a pair or turn number are
    left out. Of rows with one pair and turn number the least (by role, then text) counts, so repeated rows do no harm. A pair
    that is only on one side has an empty prompt and an empty completion on the other; equal conversations are all prompt.
    """

    def turns(df: DataFrame, side: str) -> DataFrame:
        said = F.struct(F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
        return df.select(F.col(pair_column).alias("pair"), F.col(turn_column).alias("turn"), F.lit(side).alias("side"), said.alias("said")).where(F.col("pair").isNotNull() & F.col("turn").isNotNull())

    both = turns(chosen, "c").unionByName(turns(rejected, "r"))
    both = both.groupBy("pair", "turn").agg(F.min(F.when(F.col("side") == "c", F.col("said"))).alias("c"), F.min(F.when(F.col("side") == "r", F.col("said"))).alias("r"))
    pairs = both.groupBy("pair").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("cut"), F.array_sort(F.collect_list(F.struct("turn", "c", "r"))).alias("turns"))
    common = F.when(F.col("cut").isNull(), F.col("turns")).otherwise(F.filter("turns", lambda t: t["turn"] < F.col("cut")))
    pairs = pairs.withColumn("common", common).withColumn("rest", F.when(F.col("cut").isNotNull(), F.filter("turns", lambda t: t["turn"] >= F.col("cut"))).otherwise(F.slice("turns", 1, 0)))

    def completion(side: str) -> list[Column]:
        own = F.filter(F.transform("rest", lambda t: t[side]), lambda t: t.isNotNull())
        name = "chosen" if side == "c" else "rejected"
        return [
            F.flatten(F.transform(own, lambda t: F.array(_header(t), _body(t)))).alias(f"{name}_segments"),
            F.flatten(F.transform(own, lambda t: F.array(F.lit(False), t["role"] == speaker))).alias(f"{name}_loss"),
        ]

    prompt = F.array_join(F.transform("common", lambda t: F.concat(_header(t["c"]), _body(t["c"]))), "")
    return pairs.select(F.col("pair").alias(pair_column), F.size("common").alias("prompt_turns"), prompt.alias("prompt"), *completion("c"), *completion("r"))


def with_swapped_answer(conversations: DataFrame, partner: Column, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", speaker: str = "assistant") -> DataFrame:
    """``conversations`` with the last answer of each replaced by the last answer of its partner: rejected sides for plain dialogues.

    ``partner`` is an expression over ``id_column``. Where the partner has no answer, the last answer is left out. The result has the
    columns ``id_column``, ``turn_column``, ``role_column`` and ``text_column``.
    """
    rows = conversations.select(F.col(id_column), F.col(turn_column), F.col(role_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias(text_column))
    own = rows.where((F.col(role_column) == speaker) & F.col(id_column).isNotNull() & F.col(turn_column).isNotNull())
    last = own.groupBy(id_column).agg(F.max(F.struct(turn_column, text_column)).alias("last"))
    asked = last.select(F.col(id_column), F.col(f"last.{turn_column}").alias(turn_column), partner.alias("partner"))
    given = last.select(F.col(id_column).alias("partner"), F.col(f"last.{text_column}").alias("other"))
    swaps = asked.join(given, "partner", "left").select(id_column, turn_column, "other", F.lit(True).alias("swap"))
    done = rows.join(swaps, [id_column, turn_column], "left")
    swapped = F.col("swap") & (F.col(role_column) == speaker)
    done = done.withColumn(text_column, F.when(swapped, F.col("other")).otherwise(F.col(text_column)))
    return done.where(F.col(text_column).isNotNull()).select(id_column, turn_column, role_column, text_column)
