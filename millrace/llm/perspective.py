"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of one part. A part is one row, so rows stay bounded however long a dialogue is.
PART = 256
CONTEXT = "system"
NOBODY = "unknown"
END = "<|end|>"


def _plain(text: Column) -> Column:
    """Text that cannot open a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row for each dialogue, participant and part: rendered text and the spans that are trained on.

    In a participant's view its turns are the assistant's, others are users named by their role, and
    system turns stay the system's (the system is no participant; a dialogue with no other role gives no
    row). ``spans`` are [start, end) in code points of ``rendered``: the assistant's texts with their end mark.

    A part holds the turns whose number is in one interval of ``part`` numbers, ordered by turn, role and
    text; concatenating a view's parts by (part, slot) gives the whole dialogue. Equal rows are all
    kept. Null texts count as empty, null roles as "unknown"; null turns form the last part (null). An interval
    with more than ``part`` turns, which only repeated or null numbers can cause, is dealt over several
    slots by a hash of role, text and the number of a copy. Null dialogue ids form one dialogue. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # Copies of a turn are counted before they are dealt, so that a hot one is one row in the shuffle.
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("part", F.floor(F.col("turn") / part))
    full = rows.groupBy("conv", "part").agg(F.sum("copies").alias("n")).where(F.col("n") > part).select(F.col("conv").alias("c"), F.col("part").alias("p"), F.ceil(F.col("n") / part).alias("slots"))
    rows = rows.join(full, rows["conv"].eqNullSafe(full["c"]) & rows["part"].eqNullSafe(full["p"]), "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("role", "text", "copy"), F.coalesce("slots", F.lit(1)))).drop("c", "p", "slots", "copy", "copies")
    speakers = rows.where(F.col("role") != CONTEXT).select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
    views = rows.join(speakers, rows["conv"].eqNullSafe(speakers["c"]))
    mine = F.col("role") == F.col("speaker")
    head = F.when(F.col("role") == CONTEXT, "<|system|>\n").when(mine, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), _plain(F.col("role")), F.lit("|>\n")))
    piece = F.struct("turn", "role", "text", head.alias("head"), F.concat(_plain(F.col("text")), F.lit(END)).alias("body"), mine.alias("mine"))
    # Null turns share a part of their own, so the order by turn never mixes them with others.
    parts = views.groupBy("conv", "speaker", "part", "slot").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    rendered = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + 1).alias("at"), F.when(x["mine"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step, lambda s: s["spans"])
    return parts.select(F.col("conv").alias(conv_col), "speaker", "part", "slot", F.size("pieces").alias("n_turns"), rendered.alias("rendered"), spans.alias("spans"))
