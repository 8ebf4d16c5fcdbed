"""Conversation history: rows of conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Estimate: a token for each 4 bytes, and 2 for the message."""
    return (F.ceil(F.octet_length(text) / 4) + 2).cast("long")


def recent(msgs: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return msgs.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def without_nth(msgs: DataFrame, n: int) -> DataFrame:
    """Without the n-th message (from 0) of each conversation."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return msgs.withColumn("_r", r).filter(F.col("_r") != n).drop("_r")


def by_role(msgs: DataFrame, role: str) -> DataFrame:
    return msgs.filter(F.col("role") == role)


def stats(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("role").agg(F.count("*").alias("n"), F.sum(tokens(F.col("text"))).cast("long").alias("tokens"))


def truncated(msgs: DataFrame, max_tokens: int = 4000, max_messages: int = 50, keep_last: int = 2) -> DataFrame:
    """Oldest messages go until both limits hold; system messages and the last pair stay."""
    fixed = (F.col("role") == "system") | (F.col("_back") <= keep_last)
    by = Window.partitionBy("conv_id")
    x = msgs.withColumn("_back", F.row_number().over(by.orderBy(F.desc("turn")))).withColumn("_tok", tokens(F.col("text"))).withColumn("_fixed", fixed)
    x = x.withColumn("_ft", F.sum(F.when(F.col("_fixed"), F.col("_tok")).otherwise(0)).over(by)).withColumn("_fn", F.sum(F.col("_fixed").cast("int")).over(by))
    newer = by.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_t", F.sum(F.when(F.col("_fixed"), 0).otherwise(F.col("_tok"))).over(newer)).withColumn("_n", F.sum(F.when(F.col("_fixed"), 0).otherwise(1)).over(newer))
    fits = (F.col("_ft") + F.col("_t") <= max_tokens) & (F.col("_fn") + F.col("_n") <= max_messages)
    return x.filter(F.col("_fixed") | fits).drop("_back", "_tok", "_fixed", "_ft", "_fn", "_t", "_n")


def window_prompt(msgs: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each conversation as one text."""
    line = F.concat_ws(": ", "role", "text")
    return recent(msgs, n).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
