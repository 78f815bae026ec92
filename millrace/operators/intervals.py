"""Nearest-interval join: a timed word goes to the turn that holds its midpoint, or to the nearer neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_turn(words: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """(words' columns, turn): ``words`` have start and end, ``turns`` have turn, start and end, disjoint and ordered.

    A word in the gap between two turns goes to the nearer one, to the earlier one on a tie. Both sides are merged in
    one order of key and time: the last turn that has begun is a running value, and so is the first that is to come, in
    the order turned round. Work is linear in a key's rows, and no pair of a word and a turn is built. Words of a
    key without turns get null.
    """
    cols = words.columns
    w = words.select(F.col(key), F.struct(*cols).alias("word"), ((F.col("start") + F.col("end")) / 2).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<turn:long,start:double,end:double>").alias("t"))
    t = turns.select(F.col(key), F.lit(None).cast(w.schema["word"].dataType).alias("word"), F.col("start").cast("double").alias("at"), F.lit(0).alias("side"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).alias("t"))
    order = Window.partitionBy(key).orderBy("at", "side")
    both = t.unionByName(w).withColumn("before", F.last("t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("side"))
    both = both.withColumn("after", F.last("t", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    b, a = F.col("before"), F.col("after")
    nearer = F.when(b.isNull(), a["turn"]).when(F.col("at") <= b["end"], b["turn"]).when(a.isNull(), b["turn"]).when(a["start"] - F.col("at") < F.col("at") - b["end"], a["turn"]).otherwise(b["turn"])
    return both.where("side = 1").select("word.*", nearer.alias("turn"))
