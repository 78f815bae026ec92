"""Operators over dialogue turns: rendering, first appearances, repeated lines and the checks on a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X

#: Fixed values of the transcript checks: shares of words and of lines.
LEAST_SECOND, MOST_REPEATED, MOST_LONGEST = 0.10, 0.20, 0.25


def render_documents(turns: DataFrame, doc: str, order: list[str], role: str, said: str) -> DataFrame:
    """(doc, n_turns, n_words, text): each document's non-empty turns as "role: said" lines, in order.

    Ties of the order go by role and text, so the result does not depend on how rows arrive. Null roles are "unknown".
    """
    line = F.struct(*order, F.coalesce(role, F.lit("unknown")).alias("r"), F.col(said).alias("s"))
    spoken = turns.where(F.coalesce(said, F.lit("")) != "")
    docs = spoken.groupBy(doc).agg(F.count("*").alias("n_turns"), F.sum(X.word_count(said)).alias("n_words"), F.sort_array(F.collect_list(line)).alias("lines"))
    return docs.select(doc, "n_turns", "n_words", F.array_join(F.transform("lines", lambda x: X.render_turn(x["r"], x["s"])), "\n").alias("text"))


def speakers_in_order(turns: DataFrame, doc: str, order: str, role: str) -> DataFrame:
    """(doc, role, place): roles numbered from one by first appearance."""
    first = turns.groupBy(doc, role).agg(F.min(order).alias("first_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("first_at", role)))


def transcript_checks(turns: DataFrame, doc: str, order: str, role: str, said: str) -> DataFrame:
    """(doc, reason, second_share, repeated_share, longest_share): why a transcript is refused, or null.

    Reasons in order: one speaker; a monologue; repeated adjacent lines; one line with too many of the words. The last two
    compare shares rounded to three places.
    """
    lag = F.lag(said).over(Window.partitionBy(doc).orderBy(order, role, said))
    lines = turns.withColumn("n", X.word_count(said)).withColumn("repeated", (lag.eqNullSafe(F.col(said)) & lag.isNotNull()).cast("int"))
    per_role = lines.groupBy(doc, role).agg(F.sum("n").alias("n"), F.sum("repeated").alias("repeated"), F.max("n").alias("longest"), F.count("*").alias("lines"))
    whole = per_role.groupBy(doc).agg(
        F.sum("n").alias("total"), F.sum("repeated").alias("repeated"), F.max("longest").alias("longest"), F.sum("lines").alias("lines"), F.sort_array(F.collect_list("n"), asc=False).alias("by_role")
    )
    total = F.greatest(F.col("total"), F.lit(1))
    whole = whole.select(
        doc, F.size("by_role").alias("speakers"), (F.get("by_role", F.lit(1)) / total).alias("second"),
        F.bround(F.col("repeated") / F.greatest(F.col("lines"), F.lit(1)), 3).alias("repeated_share"), F.bround(F.col("longest") / total, 3).alias("longest_share"),
    )
    reason = (
        F.when(F.col("speakers") < 2, "one speaker").when(F.col("second") < LEAST_SECOND, "monologue")
        .when(F.col("repeated_share") > MOST_REPEATED, "repetition loop").when(F.col("longest_share") > MOST_LONGEST, "collapsed transcript")
    )
    return whole.select(doc, reason.alias("reason"), F.bround("second", 3).alias("second_share"), "repeated_share", "longest_share")


def join_continuations(lines: DataFrame, doc: str, order: str, line: str, tag: str = r"^\[(\w+)\]\s*(.*)") -> DataFrame:
    """(doc, turn, role, said): untagged lines are appended to the tagged one before; leading ones have turn 0.

    A tag without text starts no turn and is dropped.
    """
    stripped = lines.withColumn("l", F.trim(line)).where("l <> ''")
    parts = stripped.withColumn("role", F.lower(F.regexp_extract("l", tag, 1))).withColumn("said", F.trim(F.regexp_extract("l", tag, 2)))
    parts = parts.withColumn("tagged", F.col("role") != "").where("NOT tagged OR said <> ''")
    island = F.sum(F.col("tagged").cast("int")).over(Window.partitionBy(doc).orderBy(order, "l").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_turn", island)
    piece = F.struct(order, F.when(F.col("tagged"), F.col("said")).otherwise(F.col("l")).alias("s"))
    return parts.groupBy(doc, F.col("_turn").alias("turn")).agg(F.max("role").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["s"]), " ").alias("said"))


def merge_fragments(turns: DataFrame, doc: str, order: str, role: str, said: str) -> DataFrame:
    """(doc, turn, role, said): neighbouring fragments of one role joined, bracketed notes and loops taken out.

    Of a fragment that repeats in a row the third and later copies go, and the second as well if it has
    four words or more.
    """
    clean = turns.withColumn("said_", X.without_non_speech(said)).where("said_ <> ''")
    w = Window.partitionBy(doc).orderBy(order, role, said)
    marked = clean.withColumn("new", (~F.lag(role).over(w).eqNullSafe(F.col(role))).cast("int"))
    marked = marked.withColumn("_turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    again = Window.partitionBy(doc, "_turn").orderBy(order, role, said)
    marked = marked.withColumn("fresh", (~F.lag("said_").over(again).eqNullSafe(F.col("said_"))).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(again.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("copy", F.row_number().over(Window.partitionBy(doc, "_turn", "run").orderBy(order, role, said)))
    kept = marked.where((F.col("copy") == 1) | ((F.col("copy") == 2) & (X.word_count("said_") < 4)))
    piece = F.struct(order, F.col("said_").alias("s"))
    return kept.groupBy(doc, F.col("_turn").alias("turn"), role).agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["s"]), " ").alias("said"))


def over_long(text: Column | str, most: int = 150) -> Column:
    """Text cut into parts of at most ``most`` words, at sentence ends where it can be."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))

    def add(s: Column, sentence: Column) -> Column:
        ws = X.words(sentence)
        flush = (F.size(s["now"]) > 0) & (F.size(s["now"]) + F.size(ws) > most)
        done = F.when(flush, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"])
        now = F.when(flush, F.array().cast("array<string>")).otherwise(s["now"])
        # A sentence over the limit is alone by now: its whole runs are done, its rest goes on.
        runs = F.greatest(F.lit(0), F.ceil(F.size(ws) / most).cast("int") - 1)
        cut = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(runs, F.lit(1)) - 1), lambda i: i < runs), lambda i: F.array_join(F.slice(ws, i * most + 1, most), " "))
        return F.struct(F.concat(done, cut).alias("done"), F.concat(now, F.slice(ws, runs * most + 1, most)).alias("now"))

    return F.aggregate(X.sentences(text), start, add, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]))


def speaker_labels(turns: DataFrame, doc: str, order: str, role: str, hosts: DataFrame, guests: DataFrame) -> DataFrame:
    """(doc, role, label): host_1, host_2, guest_1, ... by first appearance; other roles keep their tag.

    ``hosts`` and ``guests`` have (doc, role); a role in both is a host. A role whose own tag would read as a
    generated label ends the job.
    """
    placed = speakers_in_order(turns, doc, order, role)
    kinds = hosts.select(doc, role, F.lit("host").alias("kind")).unionByName(guests.join(hosts, [doc, role], "left_anti").select(doc, role, F.lit("guest").alias("kind"))).distinct()
    named = placed.join(kinds, [doc, role], "left")
    number = F.row_number().over(Window.partitionBy(doc, "kind").orderBy("place"))
    clash = F.col("kind").isNull() & F.lower(role).rlike("^(host|guest)")
    label = F.when(clash, F.raise_error(F.concat(F.lit("a tag would read as a generated label: "), F.col(role)))).when(F.col("kind").isNull(), F.col(role)).otherwise(F.concat_ws("_", "kind", number.cast("string")))
    return named.withColumn("label", label).select(doc, role, "label")
