"""Queries over conversations: documents from turns, transcript checks, speakers and timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import alignment, channel, intervals, ranks, splits, turns
from millrace.operators import podcasts
from millrace.plans.tables import ranks_sql, share_sql, table, words_sql

_DOCS = f"""SELECT conv_id, count(*) AS n_turns, sum({words_sql('text')})::BIGINT AS n_words,
  string_agg(coalesce(role, 'unknown') || ': ' || text, chr(10) ORDER BY turn, coalesce(role, 'unknown'), text) AS text
FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.render_documents(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text")


@query("a3_documents", _DOCS)
def a3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one document of "role: said" lines."""
    return _documents(spark, sf_dir)


@query("s7_split_summary", f"""
WITH d AS ({_DOCS}), s AS (SELECT *, CASE WHEN {share_sql('conv_id::VARCHAR')} < 0.02 THEN 'val' ELSE 'train' END AS split FROM d)
SELECT split, sum(n_words)::BIGINT AS words, sum(n_turns)::BIGINT AS turns, {ranks_sql('n_words')} FROM s GROUP BY split""")
def s7_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and the distribution of lengths on each side of the hash split."""
    docs = _documents(spark, sf_dir).withColumn("split", F.when(X.is_validation("conv_id"), "val").otherwise("train"))
    sums = docs.groupBy("split").agg(F.sum("n_words").alias("words"), F.sum("n_turns").alias("turns"))
    return sums.join(ranks.nearest_ranks(docs, ["split"], "n_words"), "split")


_TURNS = f"SELECT conv_id AS episode_id, conv_id // 10 AS podcast_id, role AS speaker, text AS turn_text, {words_sql('text')} AS token_count, turn AS start_time FROM conversations"


@query("s1_podcast_turns", f"""
WITH t AS ({_TURNS}), boiler AS (
  SELECT podcast_id, lower(turn_text) AS h FROM t WHERE token_count >= 3 GROUP BY 1, 2 HAVING count(DISTINCT episode_id) >= 2
), keep AS (SELECT episode_id, count(DISTINCT speaker) AS n_speakers FROM t GROUP BY episode_id HAVING count(DISTINCT speaker) BETWEEN 2 AND 7 AND count(*) >= 4)
SELECT t.episode_id, t.podcast_id, k.n_speakers, t.speaker, t.turn_text, t.token_count::BIGINT AS token_count, t.start_time FROM t JOIN keep k USING (episode_id)
WHERE NOT EXISTS (SELECT 1 FROM boiler b WHERE b.podcast_id = t.podcast_id AND b.h = lower(t.turn_text) AND t.token_count >= 3)""")
def s1_podcast_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of episodes with two to seven speakers, without a podcast's repeated turns; ten conversations stand for a podcast."""
    t = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.floor(F.col("conv_id") / 10).alias("podcast_id"), F.col("role").alias("speaker"), F.col("text").alias("turn_text"),
        X.word_count("text").cast("long").alias("token_count"), F.col("turn").alias("start_time"),
    )
    return podcasts.spoken_turns(t, least_turns=4, boiler_tokens=3, boiler_episodes=2)


@query("f4_transcript_checks", f"""
WITH l AS (SELECT conv_id, turn, role, text, {words_sql('text')} AS n, (text = lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text))::INT AS again FROM conversations),
r AS (SELECT conv_id, role, sum(n) AS n FROM l GROUP BY 1, 2),
s AS (SELECT conv_id, count(*) AS speakers, list_sort(list(n), 'DESC') AS by_role, greatest(sum(n), 1) AS total FROM r GROUP BY conv_id),
w AS (SELECT conv_id, sum(coalesce(again, 0)) AS again, max(n) AS longest, count(*) AS lines FROM l GROUP BY conv_id),
x AS (SELECT conv_id, speakers, by_role[2] / total::DOUBLE AS second, round_even(again / lines::DOUBLE, 3) AS repeated_share, round_even(longest / total::DOUBLE, 3) AS longest_share FROM s JOIN w USING (conv_id))
SELECT conv_id, CASE WHEN speakers < 2 THEN 'one speaker' WHEN second < 0.10 THEN 'monologue' WHEN repeated_share > 0.20 THEN 'repetition loop' WHEN longest_share > 0.25 THEN 'collapsed transcript' END AS reason,
  round_even(second, 3) AS second_share, repeated_share, longest_share FROM x""")
def f4_transcript_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a transcript is refused, and the shares it was judged by."""
    return turns.transcript_checks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("w4_first_appearance", "SELECT conv_id, role, min(turn) AS first_at, (row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role))::INTEGER AS place FROM conversations GROUP BY conv_id, role")
def w4_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers numbered by their first turn."""
    return turns.speakers_in_order(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("w4_speaker_labels", """
WITH p AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL)
SELECT conv_id, role, CASE role WHEN 'assistant' THEN 'host_1' WHEN 'user' THEN 'guest_1' ELSE role END AS label FROM p""")
def w4_speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by role, with the assistant as host and the user as guest."""
    t = table(spark, sf_dir, "conversations")
    pick = lambda r: t.where(F.col("role") == r).select("conv_id", "role").distinct()
    return turns.speaker_labels(t, "conv_id", "turn", "role", pick("assistant"), pick("user"))


@query("m1_continuations", r"""
WITH l AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 1 THEN '[' || role || '] ' || text ELSE text END) AS l FROM conversations),
p AS (SELECT *, lower(regexp_extract(l, '^\[(\w+)\]\s*((?s:.*))', 1)) AS role, trim(regexp_extract(l, '^\[(\w+)\]\s*((?s:.*))', 2)) AS said FROM l WHERE l <> ''),
q AS (SELECT *, role <> '' AS tagged FROM p WHERE role = '' OR said <> ''),
i AS (SELECT *, sum(tagged::INT) OVER (PARTITION BY conv_id ORDER BY turn, l ROWS UNBOUNDED PRECEDING)::BIGINT AS t FROM q)
SELECT conv_id, t AS turn, max(role) AS role, string_agg(CASE WHEN tagged THEN said ELSE l END, ' ' ORDER BY i.turn) AS said FROM i GROUP BY conv_id, t""")
def m1_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untagged lines joined to the tagged line before; every third turn's line carries its tag."""
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    return turns.join_continuations(table(spark, sf_dir, "conversations").withColumn("line", line), "conv_id", "turn", "line", r"(?s)^\[(\w+)\]\s*(.*)")


@query("w3_merged_fragments", f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN 'a' ELSE 'b' END AS role, CASE WHEN conv_id % 2 = 0 THEN text || ' (laughs)' ELSE text END AS said FROM conversations),
n AS (SELECT *, trim(regexp_replace(regexp_replace(said, '\\([^\\[\\]()]{{1,40}}\\)|\\[[^\\[\\]()]{{1,40}}\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM c),
m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM n WHERE s <> ''),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS t FROM m),
r AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY conv_id, t ORDER BY turn) THEN 0 ELSE 1 END AS other FROM g),
k AS (SELECT *, sum(other) OVER (PARTITION BY conv_id, t ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t, run ORDER BY turn) AS copy FROM k)
SELECT conv_id, t AS turn, role, string_agg(s, ' ' ORDER BY f.turn) AS said FROM f WHERE copy = 1 OR (copy = 2 AND {words_sql('s')} < 4) GROUP BY conv_id, t, role""")
def w3_merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring fragments of one role as one turn; roles and notes are derived from turn and conversation numbers."""
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 < 3, "a").otherwise("b").alias("role"),
        F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" (laughs)"))).otherwise(F.col("text")).alias("said"),
    )
    return turns.merge_fragments(t, "conv_id", "turn", "role", "said")


@query("w3_whole_fragments", f"""
WITH c AS (SELECT conv_id, turn * 4 + k AS turn, CASE WHEN turn % 4 < 3 THEN 'a' ELSE 'b' END AS role, CASE WHEN turn % 3 = 0 THEN text || ' (laughs) so' ELSE text END AS said
  FROM conversations, (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR turn % 5 = 0),
n AS (SELECT *, trim(regexp_replace(regexp_replace(said, '\\([^\\[\\]()]{{1,40}}\\)|\\[[^\\[\\]()]{{1,40}}\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM c),
m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM n WHERE s <> ''),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS t FROM m),
r AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY conv_id, t ORDER BY turn) THEN 0 ELSE 1 END AS other FROM g),
k AS (SELECT *, sum(other) OVER (PARTITION BY conv_id, t ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t, run ORDER BY turn) AS copy FROM k)
SELECT conv_id, t AS turn, role, string_agg(s, ' ' ORDER BY f.turn) AS said FROM f WHERE copy = 1 OR (copy = 2 AND {words_sql('s')} < 4) GROUP BY conv_id, t, role""")
def w3_whole_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As w3_merged_fragments, over whole texts: each third turn has a bracketed note added and each fifth is said three times."""
    copies = F.when(F.col("turn") % 5 == 0, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0)))
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(copies).alias("k"), F.when(F.col("turn") % 4 < 3, "a").otherwise("b").alias("role"),
        F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" (laughs) so"))).otherwise(F.col("text")).alias("said"),
    )
    return turns.merge_fragments(t.withColumn("turn", F.col("turn") * 4 + F.col("k")).drop("k"), "conv_id", "turn", "role", "said")


@query("w1_question_subset", """
SELECT conv_id, turn FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sha1('7|' || conv_id || '|' || turn), turn) <= 3""")
def w1_question_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of each conversation by seeded hash."""
    return ranks.choose_per_key(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3, 7)


@query("m16_cuts", f"""
SELECT conv_id, turn, greatest(1, least(n - 1, floor(share * n)))::INTEGER AS cut FROM (
  SELECT conv_id, turn, {words_sql('text')} AS n, {share_sql("'3|' || conv_id || '|' || turn")} AS share FROM conversations)""")
def m16_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded cut inside each turn's words."""
    t = table(spark, sf_dir, "conversations")
    return splits.cut_points(t, "cut", X.word_count("text"), 3, "conv_id", "turn").select("conv_id", "turn", "cut")


@query("x5_numbered_lines", r"""
SELECT conv_id, string_agg(n::VARCHAR || '. ' || role || ':' || text, chr(10) ORDER BY n) AS numbered FROM (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def x5_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as numbered lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: X.render_turn(x["role"], x["text"]))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines"))
    return docs.select("conv_id", F.array_join(X.numbered("lines", "dotted"), "\n").alias("numbered"))


@query("x33_cited_lines", r"""
WITH l AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg(role || ': ' || CASE WHEN n IN (1, 3) THEN '' ELSE text END, chr(10) ORDER BY n) AS blanked,
  string_agg(CASE WHEN n IN (1, 3) THEN role || ': ' || text END, chr(10) ORDER BY n) AS kept FROM l GROUP BY conv_id""")
def x33_cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without and with only their first and third lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: X.render_turn(x["role"], x["text"]))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines"))
    cited = F.array(F.lit(1), F.lit(3))
    return docs.select("conv_id", F.array_join(X.blank_cited("lines", cited), "\n").alias("blanked"), F.array_join(X.keep_cited("lines", cited), "\n").alias("kept"))


@query("j11_nearest_turn", """
WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS start, epoch(ts)::DOUBLE + value / 100 AS stop FROM events),
t AS (SELECT user_id, event_id AS turn, start, lead(start, 1, start + 60) OVER (PARTITION BY user_id ORDER BY start, event_id) AS nxt FROM e WHERE event_id % 5 = 0),
tt AS (SELECT user_id, turn, start, start + (nxt - start) / 3 AS stop FROM t),
w AS (SELECT event_id, user_id, (start + stop) / 2 AS mid FROM e WHERE event_id % 5 <> 0),
b AS (SELECT w.*, tt.turn AS bt, tt.stop AS bs FROM w ASOF LEFT JOIN tt ON w.user_id = tt.user_id AND w.mid >= tt.start),
a AS (SELECT b.*, tt.turn AS aturn, tt.start AS astart FROM b ASOF LEFT JOIN tt ON b.user_id = tt.user_id AND b.mid < tt.start)
SELECT event_id, CASE WHEN bt IS NULL THEN aturn WHEN mid <= bs THEN bt WHEN aturn IS NULL THEN bt WHEN astart - mid < mid - bs THEN aturn ELSE bt END AS turn FROM a""")
def j11_nearest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a user's intervals for each other event; every fifth event opens an interval."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), "value")
    e = e.withColumn("end", F.col("start") + F.col("value") / 100)
    following = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    t = e.where("event_id % 5 = 0").withColumn("next", F.coalesce(following, F.col("start") + 60))
    t = t.select("user_id", F.col("event_id").alias("turn"), "start", (F.col("start") + (F.col("next") - F.col("start")) / 3).alias("end"))
    return intervals.nearest_turn(e.where("event_id % 5 <> 0").select("user_id", "event_id", "start", "end"), t, "user_id").select("event_id", "turn")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words as reference; every sixth is lost and every ninth said twice in the stand-in for recogniser output."""
    ref = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.alignment_words("text").alias("ref"))
    heard = F.flatten(F.transform("ref", lambda w, i: F.when(i % 6 == 5, F.array().cast("array<string>")).when(i % 9 == 8, F.array(w, w)).otherwise(F.array(w))))
    return ref.withColumn("hyp", heard)


@query("a22_error_rates")
def a22_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates by role; tests hold the alignment against a plain one."""
    return alignment.error_rates(_pairs(spark, sf_dir), ["role"])


@query("a21_edit_counts")
def a21_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of edits by role."""
    return alignment.alignment_counts(_pairs(spark, sf_dir), ["role"])


@query("a21_pooled_counts")
def a21_pooled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of edits by role and of both together, from one alignment."""
    return alignment.pooled_counts(_pairs(spark, sf_dir), ["role"])


@query("p2_noise")
def p2_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with seeded errors of the fitted kind; tests hold it against a plain loop."""
    pairs = _pairs(spark, sf_dir).withColumn("key", F.concat_ws("-", "conv_id", "turn", "role"))
    made = channel.noise(pairs, "key", "ref", channel.fit(pairs), seed=11)
    return made.select("key", F.array_join("noisy", " ").alias("noisy"))


@query("p3_neighbours")
def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest word of the conversations for each word of the benchmark; tests hold it against a plain search."""
    said = table(spark, sf_dir, "conversations").select(F.explode(X.alignment_words("text")).alias("word"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(X.alignment_words("text")).alias("word"))
    return channel.neighbours(asked, said)


@query("p4_calibration")
def p4_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted error rate and the factor with which noise makes it."""
    pairs = _pairs(spark, sf_dir).withColumn("key", F.concat_ws("-", "conv_id", "turn", "role"))
    fitted = channel.fit(pairs)
    return spark.createDataFrame([(fitted.wer, channel.calibrated(fitted, pairs, "key", "ref", 3))], "wer double, factor double")
