"""Selection of spoken turns and of episodes: repeated turns, eligibility in order, first copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import fresh
from millrace.operators.ranks import numbered

#: Codes that make rows of one case.
MOST_CODES = 1000


def spoken_turns(turns: DataFrame, episodes: DataFrame | None = None, least_turns: int = 20, speakers: tuple[int, int] = (2, 7), boiler_tokens: int = 15, boiler_episodes: int = 3) -> DataFrame:
    """Turns of the episodes that qualify, without boilerplate, with n_speakers and the episode's columns.

    ``turns`` has episode_id, podcast_id, speaker, turn_text, token_count and start_time. A turn is boilerplate if
    it has ``boiler_tokens`` or more and its lower-cased text stands in ``boiler_episodes`` or more of its podcast's
    episodes. ``episodes`` adds its columns and keeps English ones (column language). Null podcasts have no boilerplate.
    """
    long = F.col("token_count") >= boiler_tokens
    key = F.xxhash64(F.lower("turn_text"))
    seen = turns.where(long).select("podcast_id", F.lower("turn_text").alias("said"), key.alias("h"), "episode_id").distinct()
    boiler = seen.groupBy("podcast_id", "h", "said").agg(F.count("*").alias("n")).where(F.col("n") >= boiler_episodes).select("podcast_id", "h", "said")
    stats = turns.groupBy("episode_id").agg(F.count_distinct("speaker").alias("n_speakers"), F.count("*").alias("n"))
    keep = stats.where(F.col("n_speakers").between(*speakers) & (F.col("n") >= least_turns)).select("episode_id", "n_speakers")
    if episodes is not None:
        keep = keep.join(episodes.where(F.lower("language").startswith("en")).drop("language", "podcast_id"), "episode_id")
    marked = turns.withColumn("_h", key).withColumn("_long", long)
    b = boiler.select(F.col("podcast_id").alias("_p"), F.col("h").alias("_bh"), F.col("said").alias("_said"))
    same = (F.col("podcast_id") == F.col("_p")) & (F.col("_h") == F.col("_bh")) & (F.lower("turn_text") == F.col("_said")) & F.col("_long")
    return marked.join(b, same, "left_anti").drop("_h", "_long").join(keep, "episode_id")


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(rows' columns, reason): the first step whose condition a row meets; null for rows that pass all."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(steps):
        reason = F.when(condition, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def rebuild_meetings(items: DataFrame, uid: str, order: str, transcript: str, summary: str, part: int = 64) -> DataFrame:
    """(meeting, part, n_items, text, summary): items of one meeting (first two parts of the uid) in order.

    A part has ``part`` items, so no row grows with a meeting; a meeting's parts in order are the whole of it. Empty
    transcripts and summaries are left out of the texts; all items count. Null uids are one meeting (null).
    """
    named = items.select(F.substring_index(F.col(uid), "_", 2).alias("meeting"), F.col(order).alias("at"), F.col(transcript).alias("t"), F.col(summary).alias("s"))
    placed = numbered(named, ["meeting"], "at", "n").withColumn("part", F.floor(F.col("n") / part))
    rows = placed.groupBy("meeting", "part").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.struct("at", "n", "t", "s"))).alias("rows"))
    said = lambda f: F.filter(F.transform("rows", lambda x: F.coalesce(x[f], F.lit(""))), lambda x: x != "")
    return rows.select("meeting", "part", "n_items", F.array_join(said("t"), "\n\n").alias("text"), F.array_join(said("s"), " ||| ").alias("summary"))


def label_rows(cases: DataFrame, labels: str, codes: DataFrame, code: str, held_out: str, benchmark: Column) -> DataFrame:
    """One yes/no row for each case and code; held-out codes only on the benchmark.

    ``codes`` is a dimension table of at most ``MOST_CODES`` rows, which becomes an array in each case's row; a longer
    one is an error. Null labels have no positive code.
    """
    found = codes.select(F.col(code).alias("code"), F.col(held_out).alias("held")).limit(MOST_CODES + 1).collect()
    if len(found) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} codes")
    kind = codes.schema[code].dataType.simpleString()
    all_codes = F.array(*[F.struct(F.lit(r.code).cast(kind).alias("code"), F.lit(r.held).alias("held")) for r in found]) if found else F.array().cast(f"array<struct<code:{kind},held:boolean>>")
    rows = cases.withColumn(x := fresh("code", cases), F.explode(all_codes)).withColumn(code, F.col(f"{x}.code")).withColumn(held_out, F.col(f"{x}.held")).drop(x)
    return rows.withColumn("positive", F.array_contains(labels, F.col(code))).where(benchmark | ~F.col(held_out))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the given columns; rows equal in them go by their text as JSON, the last one stays."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order, F.to_json(F.struct(*rows.columns))))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("r")).select("r.*")
