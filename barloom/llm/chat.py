"""Chat logs: cumulative snapshots collapse into maximal conversations, then rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def collapse(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, n_turns, copies, chat) of maximal conversations.

    A conversation is its rows in the order of turn (nulls first, then role and text). Two
    rolling hashes over its turns, each turn hashed with its place, stand for its prefixes.
    A conversation that equals a proper prefix of another one is dropped (anti-join on
    length and hashes); of equal ones the smallest conv_id stays, `copies` of them counted.
    `chat` holds "<|role|>\\ntext\\n" for each turn and ends with "<|end|>".

    Null role or text counts as empty. Rows without conv_id form one conversation. Repeated
    rows are turns of their own. An empty table returns no rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("i", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    one, two = F.xxhash64("i", "role", "text"), F.xxhash64(F.lit(7), "text", "role", "i")
    rows = rows.withColumns({"h1": F.bit_xor(one).over(running), "h2": F.bit_xor(two).over(running)})
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    prefixes = materialize(rows.select("conv_id", "i", "h1", "h2", "n"), "prefixes")
    whole = prefixes.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = prefixes.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    kept = materialize(whole.join(longer, ["n", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("id"), "n", "copies"), "maximal")
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    full = rows.select("conv_id", "i", said.alias("said")).join(kept, F.col("conv_id").eqNullSafe(F.col("id")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"])
    out = full.groupBy("id", "n", "copies").agg(F.concat(F.array_join(parts, ""), F.lit("<|end|>")).alias("chat"))
    return out.select(F.col("id").alias("conv_id"), F.col("n").alias("n_turns"), "copies", "chat")
