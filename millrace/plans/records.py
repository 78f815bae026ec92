"""Queries over records with rules: validators, refusals, states, enrichment, gates, exclusions and roll-ups.

Fields that the tables lack (kinds of variants, cached identifications, call logs) are derived from ids, alike in
Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import records
from millrace.plans.scores import PAIRS_SQL, pairs
from millrace.plans.tables import table, words_sql

_RULES_SQL = """list_filter([
  CASE WHEN NOT coalesce(answer IN ('pass', 'fail', 'none'), false) THEN 'answer is an option' END,
  CASE WHEN NOT coalesce(evidence = list_sort(list_distinct(evidence)), false) THEN 'evidence ascends' END,
  CASE WHEN NOT coalesce(len(list_filter(evidence, lambda e: e < 1)) = 0, false) THEN 'evidence from one' END,
  CASE WHEN NOT coalesce(len(list_filter(evidence, lambda e: e > n_lines)) = 0, false) THEN 'evidence in lines' END,
  CASE WHEN h = 2 THEN 'known kinds' END, CASE WHEN h = 4 THEN 'aligned' END, CASE WHEN doc_id % 11 = 0 THEN 'speakers declared' END], lambda x: x IS NOT NULL)"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Labelled pairs with two variants of their lines, and the rules of records and transcripts."""
    p = pairs(spark, sf_dir)
    line = lambda i: F.concat(F.when(F.col("doc_id") % 11 == 0, "stranger").otherwise("guest"), F.lit(": line "), i.cast("string"))
    lines = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_lines")), line)
    kind = F.when(F.col("h") == 2, "rough").otherwise("messy")
    second = F.when(F.col("h") == 4, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    p = p.withColumn("variants", F.array(F.struct(F.lit("clean").alias("kind"), lines.alias("lines")), F.struct(kind.alias("kind"), second.alias("lines"))))
    p = p.withColumn("speakers", F.array(F.lit("host"), F.lit("guest")))
    return p, records.record_rules("options", "answer", "evidence", "n_lines") | records.transcript_rules("variants", "speakers")


@query("p7_violations", f"WITH {PAIRS_SQL} SELECT doc_id, array_to_string({_RULES_SQL}, ',') AS violations FROM scored")
def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of records and transcripts that each labelled pair breaks."""
    rows, rules = _records(spark, sf_dir)
    return records.violations(rows, rules).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("f6_refusals", f"WITH {PAIRS_SQL} SELECT rule, count(*) AS n FROM (SELECT unnest({_RULES_SQL}) AS rule FROM scored) GROUP BY rule")
def f6_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each rule refuses; ``records.refuse`` ends the job instead."""
    return records.refusals(*_records(spark, sf_dir))


_KINDS = ("call", "task", "show")
_LEAST, _SHOWS = {"call": 3, "task": 2}, {"show": (2, 3, 2, 4)}


@query("f5_case_reasons", """
WITH c AS (SELECT conv_id, ['call', 'task', 'show', 'other'][conv_id % 4 + 1] AS kind, count(*) AS turns, count(DISTINCT role) AS speakers, count(*) FILTER (role = 'system' AND conv_id % 3 = 0) AS un FROM conversations GROUP BY conv_id)
SELECT conv_id, kind, CASE WHEN un > 0 THEN 'unattributed' WHEN kind = 'call' AND turns < 3 OR kind = 'task' AND turns < 2 THEN 'short' WHEN kind = 'show' AND speakers NOT BETWEEN 2 AND 3 THEN 'speakers'
  WHEN kind = 'show' AND turns NOT BETWEEN 2 AND 4 THEN 'turns' WHEN kind = 'other' THEN 'unknown kind' END AS reason FROM c""")
def f5_case_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a conversation makes no case, by kind; system turns of every third conversation stand for unattributed ones."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_distinct("role").alias("speakers"), F.count_if((F.col("role") == "system") & (F.col("conv_id") % 3 == 0)).alias("un")
    )
    c = c.withColumn("kind", F.get(F.array(*map(F.lit, (*_KINDS, "other"))), (F.col("conv_id") % 4).cast("int")))
    return c.select("conv_id", "kind", records.case_reason(F.col("kind"), F.col("turns"), F.col("speakers"), F.col("un"), _LEAST, _SHOWS).alias("reason"))


_FIELDS = ("kind", "hosts", "guests")


@query("f9_states", f"""
WITH d AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS stratum, doc_id % 7 AS r FROM documents)
SELECT doc_id, coalesce(r NOT IN (0, 3), false) AS current, CASE WHEN r IN (0, 3) THEN NULL ELSE r <> 1 AND r <> 2 END AS buildable, coalesce(stratum = 'short' AND n_chars <= 1200 AND doc_id % 5 <> 0, false) AS usable,
  doc_id % 2 = 0 AND r IN (0, 3) AS pending FROM d""")
def f9_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's cached record is current, makes it buildable (true, false or unknown), and what is pending.

    By id modulo seven: no record, another kind, no hosts, a record without guests (an earlier version), else good ones.
    """
    r = F.col("doc_id") % 7
    hosts = F.when(r == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    record = F.when(r != 0, F.struct(F.when(r == 1, "play").otherwise("conversation").alias("kind"), hosts.alias("hosts"), F.when(r != 3, F.array(F.lit("b"))).alias("guests")))
    d = table(spark, sf_dir, "documents").withColumn("record", record)
    build = records.is_buildable(F.col("record"), _FIELDS)
    stratum = F.when(F.col("n_chars") < 1500, "short").otherwise("long")
    usable = records.is_usable(F.col("n_chars"), stratum, F.lit("short"), 1200, F.when(F.col("doc_id") % 5 == 0, "checks"))
    return d.select("doc_id", records.is_current(F.col("record"), _FIELDS).alias("current"), build.alias("buildable"), usable.alias("usable"), ((F.col("doc_id") % 2 == 0) & build.isNull()).alias("pending"))


@query("j4_enriched", "SELECT d.doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def j4_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels or defaults; labels cover some documents, so a tenth is enough here."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return records.enrich(d, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": 0}, least=0.1)


_ASKED = """e AS (SELECT doc_id AS episode, 'g' || k::VARCHAR AS question, ['pass', 'fail', 'none'][(doc_id + k) % 3 + 1] AS answer FROM documents, range(3) t(k))"""


@query("j12_gated", f"WITH {_ASKED} SELECT a.episode, a.question, a.answer, a.question = 'g1' AND g.answer = 'none' AS gated FROM e a JOIN e g ON g.episode = a.episode AND g.question = 'g0'")
def j12_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to one of three questions that another answer of the same episode settles."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    answer = F.get(F.array(*map(F.lit, ("pass", "fail", "none"))), ((F.col("episode") + F.col("k")) % 3).cast("int"))
    e = e.select("episode", F.concat(F.lit("g"), F.col("k")).alias("question"), answer.alias("answer"))
    return records.gate(e, "episode", "question", "g1", "g0", "answer", "none")


@query("j14_unused", "WITH u AS (SELECT doc_id, left(text, 12) AS t FROM documents WHERE doc_id % 20 = 0) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u) AND left(text, 12) NOT IN (SELECT t FROM u WHERE t <> '')")
def j14_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an earlier use took neither by id nor by title (their first twelve characters)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(12)).alias("title"))
    return records.excluded(d, d.where("doc_id % 20 = 0"), "doc_id", "title").select("doc_id")


@query("j15_done_by_all", f"WITH {PAIRS_SQL}, l AS (SELECT doc_id, unnest(list_filter(['a', CASE WHEN h <> 3 THEN 'b' END, CASE WHEN h < 8 THEN 'c' END], lambda x: x IS NOT NULL)) AS labeller FROM scored) SELECT doc_id FROM l GROUP BY doc_id HAVING count(DISTINCT labeller) = 3")
def j15_done_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all of three labellers have labelled."""
    who = F.array_compact(F.array(F.lit("a"), F.when(F.col("h") != 3, "b"), F.when(F.col("h") < 8, "c")))
    return records.done_by_all(pairs(spark, sf_dir).select("doc_id", F.explode(who).alias("labeller")), "doc_id", "labeller")


@query("u5_differences", """
WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT doc_id, 'one' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT doc_id, 'two' FROM (FROM b EXCEPT FROM a)""")
def u5_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two sets has: documents labelled good, and English ones."""
    return records.symmetric_difference(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("x22_lineages", """
WITH q AS (SELECT doc_id, ['tm-' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-x', 'tm-vul-' || doc_id::VARCHAR, 'gen-' || doc_id::VARCHAR, 'tm-other-1'][doc_id % 4 + 1] AS id FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(id, '^tm-[0-9][0-9]-') THEN 'gen-' || id[4:] WHEN regexp_matches(id, '^tm-(vul|cmp|eod)-') THEN id[4:] ELSE id END AS lineage FROM q""")
def x22_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base question of ids in four forms."""
    i = F.col("doc_id")
    forms = F.array(F.concat(F.lit("tm-"), F.lpad((i % 100).cast("string"), 2, "0"), F.lit("-x")), F.concat(F.lit("tm-vul-"), i), F.concat(F.lit("gen-"), i), F.lit("tm-other-1"))
    return table(spark, sf_dir, "documents").select("doc_id", X.lineage(F.get(forms, (i % 4).cast("int"))).alias("lineage"))


def _swap_sql(text: str) -> str:
    for word, other in X._SWAPS:
        text = f"""regexp_replace({text}, '\\b{word.replace("'", "''")}\\b', '{other.replace("'", "''")}', 'g')"""
    return text


_ASK = "'Agent ' || role || ': the customer''s call to an agent''s agents? Customer, recall: ' || coalesce(text, '')"


@query("x23_swapped_words", f"SELECT conv_id, turn, role, {_swap_sql(_ASK)} AS asked FROM conversations")
def x23_swapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn behind a sentence with the words that another dataset's wording swaps."""
    asked = F.concat(F.lit("Agent "), "role", F.lit(": the customer's call to an agent's agents? Customer, recall: "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.swapped_words(asked).alias("asked"))


_RAW = """'[1, "2", true, ' || (doc_id % 9)::VARCHAR || ', 3.0, 2.5, " 4 ", "x", null, 40, 2]'"""


@query("x16_line_numbers", f"""
WITH r AS (SELECT doc_id, 3 + doc_id % 5 AS n_lines, json_extract(({_RAW})::JSON, '$[*]') AS items FROM documents),
v AS (SELECT doc_id, n_lines, len(items) AS n, list_filter(list_transform(items, lambda x: CASE WHEN json_type(x) IN ('BIGINT', 'UBIGINT') THEN (x->>'$')::BIGINT
  WHEN json_type(x) = 'VARCHAR' AND regexp_full_match(x->>'$', '\\s*[0-9]+\\s*') THEN trim(x->>'$')::BIGINT WHEN json_type(x) = 'DOUBLE' AND (x->>'$')::DOUBLE = floor((x->>'$')::DOUBLE) THEN (x->>'$')::DOUBLE::BIGINT END),
  lambda e: e IS NOT NULL AND e BETWEEN 1 AND n_lines) AS good FROM r)
SELECT doc_id, list_sort(list_distinct(good)) AS evidence, (n - len(good))::INTEGER AS dropped FROM v""")
def x16_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers coerced from a JSON list of numbers, digits, truth values and others."""
    raw = F.concat(F.lit('[1, "2", true, '), F.col("doc_id") % 9, F.lit(', 3.0, 2.5, " 4 ", "x", null, 40, 2]'))
    evidence, dropped = X.line_numbers(raw, 3 + F.col("doc_id") % 5)
    return table(spark, sf_dir, "documents").select("doc_id", evidence.alias("evidence"), dropped.alias("dropped"))


_REPLY = """['User (3 turns), "assistant".', 'system; and', 'usr', 'NONE', 'USER user'][conv_id % 5 + 1]"""


@query("x31_tags", f"""
WITH c AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS tags, {_REPLY} AS reply FROM conversations GROUP BY conv_id),
n AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(reply, '\\s*\\([^)]*\\)', '', 'g'), '[,;\\s]+'), lambda x: lower(trim(x, '"''.'))), lambda x: x <> '') AS named FROM c)
SELECT conv_id, array_to_string(list_filter(tags, lambda t: list_contains(named, t)), ',') AS matched, len(list_filter(named, lambda x: NOT list_contains(tags, x) AND x NOT IN ('none', 'n/a', 'null', 'and', '-', 'no', 'host', 'hosts', 'guest', 'guests')))::INTEGER AS unmatched FROM n""")
def x31_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers that a free reply names, and how many names are no speaker's."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("tags"))
    reply = F.get(F.array(*map(F.lit, ('User (3 turns), "assistant".', "system; and", "usr", "NONE", "USER user"))), (F.col("conv_id") % 5).cast("int"))
    return c.select("conv_id", F.array_join(X.matched_tags(reply, "tags"), ",").alias("matched"), F.size(X.unmatched_tags(reply, "tags")).alias("unmatched"))


@query("m3_precedence", """
WITH d AS (SELECT doc_id, doc_id % 6 AS r, doc_id % 4 AS m FROM documents), x AS (SELECT doc_id, r <> 0 AS has, r IN (1, 2) AS ours, r <> 2 AS whole, CASE WHEN r = 3 THEN 'play' ELSE 'conversation' END AS kind,
  CASE WHEN r = 1 THEN 'a' ELSE 'z' END AS host, m <> 0 AS given, 'a' AS new_host FROM d)
SELECT doc_id, CASE WHEN has AND NOT ours AND whole AND kind <> 'conversation' THEN 'keep' WHEN NOT given THEN CASE WHEN has AND ours AND whole THEN 'revoke' ELSE 'keep' END
  WHEN has AND ours AND whole AND host = new_host THEN 'unchanged' ELSE 'replace' END AS action FROM x""")
def m3_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the metadata rule does to cached records of five kinds."""
    r = F.col("doc_id") % 6
    d = table(spark, sf_dir, "documents").select("doc_id")
    record = lambda kind, host, guests: F.struct(kind.alias("kind"), F.array(host).alias("hosts"), guests.alias("guests"))
    old = record(F.when(r == 3, "play").otherwise("conversation"), F.when(r == 1, "a").otherwise("z"), F.when(r != 2, F.array().cast("array<string>")))
    cache = d.where(r != 0).select("doc_id", F.when(r.isin(1, 2), "metadata").otherwise("model").alias("source"), old.alias("record"))
    new = F.when(F.col("doc_id") % 4 != 0, record(F.lit("conversation"), F.lit("a"), F.array().cast("array<string>")))
    return records.precedence(cache, d.select("doc_id", new.alias("record")), "doc_id", _FIELDS).select("doc_id", "action")


@query("m8_shortcut_pairs", "WITH s AS (SELECT doc_id, 'q' || (doc_id % 6)::VARCHAR || '|' || source || '|b' AS x FROM documents) SELECT DISTINCT x[:instr(x, '|') - 1] AS question, x[instr(x, '|') + 1:] AS band FROM s")
def m8_shortcut_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and band of a report's joined names, parted at the first bar."""
    x = table(spark, sf_dir, "documents").select(F.concat(F.lit("q"), F.col("doc_id") % 6, F.lit("|"), "source", F.lit("|b")).alias("x"))
    return x.select(F.substring_index("x", "|", 1).alias("question"), F.substring(F.col("x"), F.instr("x", "|") + 1, F.length("x")).alias("band")).distinct()


@query("m12_unseen_questions", f"WITH {PAIRS_SQL}, bank AS (SELECT * FROM (VALUES ('q0', -1), ('q4', -1)) v(question, doc_id)) SELECT question, doc_id FROM bank UNION ALL SELECT question, min(doc_id) FROM scored WHERE question NOT IN (SELECT question FROM bank) GROUP BY question")
def m12_unseen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of two questions with the first record of each further question of the ledger."""
    bank = spark.createDataFrame([("q0", -1), ("q4", -1)], "question string, doc_id long")
    return records.unseen(bank, pairs(spark, sf_dir).select("question", "doc_id"), "question", "doc_id")


@query("m13_measured_again", f"""
WITH m AS (SELECT doc_id, {words_sql('text')} AS tokens, n_chars FROM documents WHERE doc_id % 3 <> 0), o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 700 END::BIGINT AS tokens, 's' || (doc_id % 2)::VARCHAR AS stratum FROM documents)
SELECT o.doc_id, coalesce(o.tokens, m.tokens) AS tokens, CASE WHEN coalesce(o.tokens, m.tokens) <= 600 THEN stratum END AS stratum, m.n_chars FROM o LEFT JOIN m USING (doc_id)""")
def m13_measured_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool that keeps its old counts and takes new ones where it has none; rows over the ceiling lose their stratum."""
    d = table(spark, sf_dir, "documents")
    old = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(700).cast("long")).alias("tokens"), F.concat(F.lit("s"), F.col("doc_id") % 2).alias("stratum"))
    new = d.where("doc_id % 3 <> 0").select("doc_id", X.word_count("text").cast("long").alias("tokens"), "n_chars")
    return records.measured_again(old, new, "doc_id", 600)


@query("m20_roles", "SELECT conv_id, turn, CASE coalesce(role, '') WHEN 'assistant' THEN 'SPEAKER_00' WHEN 'user' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker, count(*) AS n FROM conversations GROUP BY ALL")
def m20_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by mapped speaker; other roles are the third."""
    speaker = records.mapped_role(F.col("role"), {"assistant": "SPEAKER_00", "user": "SPEAKER_01"}, "SPEAKER_02")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", speaker.alias("speaker")).agg(F.count("*").alias("n"))


@query("m21_divisors", "WITH n AS (SELECT DISTINCT 1 + n_chars % 600 AS n FROM documents) SELECT n, arg_min(d, (abs(n / d::DOUBLE - 8), d)) AS every FROM n, range(1, 601) t(d) WHERE n % d = 0 GROUP BY n")
def m21_divisors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divisor that cuts a number of steps into nearly eight parts."""
    n = table(spark, sf_dir, "documents").select((1 + F.col("n_chars") % 600).alias("n")).distinct()
    return n.select("n", records.nearest_divisor(F.col("n"), 8).alias("every"))


@query("a25_costs", """
WITH c AS (SELECT source, (n_chars % 1000) / 10000::DOUBLE AS cost, doc_id % 13 = 0 AS failed, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS cached, n_chars AS tokens FROM documents)
SELECT source, count(*) AS calls, count(*) FILTER (failed) AS failed_calls, round(sum(cost), 2) AS cost, coalesce(sum(cached), 0)::BIGINT AS cache_read_tokens, sum(tokens)::BIGINT AS input_tokens, count(*) FILTER (cached > 0) AS calls_with_cache_reads FROM c GROUP BY source""")
def a25_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures, spend and cache reads by source; a document stands for a call."""
    d = table(spark, sf_dir, "documents")
    calls = d.select("source", ((F.col("n_chars") % 1000) / 10000).alias("cost"), (F.col("doc_id") % 13 == 0).alias("failed"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("cached"), F.col("n_chars").alias("tokens"))
    return records.cost_summary(calls, ["source"], "cost", "failed", "cached", "tokens")
