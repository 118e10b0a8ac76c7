"""Chat examples by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns
before it are the context, and only that reply (with its end mark) is trainable.

Edge cases: rows without a conversation id or turn number have no place in a
conversation and are left out; a null text counts as empty and a null role as
``unknown``; an assistant turn without text gives no example but stays in the
context of later ones; equal turn numbers are ordered by role, then text, and
repeated rows stay repeated; an assistant turn that comes first has the empty
context; very long texts are kept whole; an empty table gives no examples. The
output has fixed columns whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, END = "<|", "|>\n", "<|end|>\n"


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, n_context, prompt, target, trainable_from`` per assistant turn.

    ``prompt + target`` is the training text; the characters from
    ``trainable_from`` (0-based) on carry loss. One shuffle by conversation.
    """
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    said = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(END))
    each = turns.select("conv_id", F.transform("turns", said).alias("said"), F.posexplode("turns").alias("i", "t"))
    each = each.where((F.col("t.role") == "assistant") & (F.length("t.text") > 0))
    prompt = F.concat(F.array_join(F.slice("said", F.lit(1), F.col("i")), ""), F.lit(f"{OPEN}assistant{MID}"))
    return each.select(
        "conv_id", F.col("t.turn").alias("turn"), F.col("i").cast("bigint").alias("n_context"), prompt.alias("prompt"),
        F.concat(F.col("t.text"), F.lit(END)).alias("target"), F.length(prompt).cast("bigint").alias("trainable_from"),
    )
