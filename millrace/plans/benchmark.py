"""Queries of the benchmark's score card over labelled answers; flags and tags are derived from ids, alike in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.operators import benchmarks, scoring
from millrace.plans.scores import PAIRS_SQL, _f1_sql, pairs

_CARD_SQL = f"""{PAIRS_SQL},
v AS (SELECT *, CASE WHEN question IN ('q1', 'q2') THEN ['t1', 't2', 't3'] ELSE [] END AS vocabulary, [[], ['t1'], ['t1', 't2']][doc_id % 3 + 1] AS gold_tags,
  CASE WHEN h = 9 THEN NULL WHEN h < 6 THEN [[], ['t1'], ['t1', 't2']][doc_id % 3 + 1] ELSE ['t2', 'x'] END AS tags, h <> 5 AS summed, h <> 9 AS parsed FROM scored),
y AS (SELECT *, CASE WHEN len(vocabulary) > 0 THEN CASE WHEN tags IS NULL THEN 0.0 WHEN len(list_distinct(list_concat(tags, gold_tags))) = 0 THEN 1.0 ELSE len(list_intersect(tags, gold_tags)) / len(list_distinct(list_concat(tags, gold_tags)))::DOUBLE END END::DOUBLE AS tag_jaccard,
  status = 'exact' AND ev_valid AND summed AS format_valid FROM v),
card AS (SELECT *, CASE WHEN question IN ('q4', 'q5') THEN 'unseen_q' ELSE 'seen_q' END AS cell, CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END END AS band,
  question = 'q5' AND doc_id % 4 = 1 AS gated, question = 'q1' AND n_chars < 1500 AS shortcut, CASE WHEN h <> 3 THEN n_chars > 3000 END AS over_cap, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS difficult FROM y)"""


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with tags, formats and the flags that a card is sliced by."""
    p, i, h = pairs(spark, sf_dir), F.col("doc_id"), F.col("h")
    words = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    gold_tags = F.when(i % 3 == 0, words()).when(i % 3 == 1, words("t1")).otherwise(words("t1", "t2"))
    p = p.withColumns({
        "vocabulary": F.when(F.col("question").isin("q1", "q2"), words("t1", "t2", "t3")).otherwise(words()), "gold_tags": gold_tags,
        "tags": F.when(h < 6, gold_tags).when(h < 9, words("t2", "x")), "summary": F.when(h != 5, "said"), "parsed": h != 9,
    })
    p = benchmarks.format_scores(scoring.score_pairs(p), "vocabulary", "tags", "gold_tags", "summary")
    return p.withColumns({
        "cell": F.when(F.col("question").isin("q4", "q5"), "unseen_q").otherwise("seen_q"), "band": F.when(i % 9 != 0, F.when(F.col("n_chars") < 1500, "short").otherwise("long")),
        "gated": (F.col("question") == "q5") & (i % 4 == 1), "shortcut": (F.col("question") == "q1") & (F.col("n_chars") < 1500), "over_cap": F.when(h != 3, F.col("n_chars") > 3000), "difficult": F.when(i % 2 == 0, i % 4 == 0),
        "dataset": F.col("source"), "family": F.col("lang"), "qid": F.col("question"), "prompt_tokens": F.col("n_chars"),
    })


@query("x19_formats", f"WITH {_CARD_SQL} SELECT doc_id, round(tag_jaccard, 9) AS tag_jaccard, format_valid FROM card")
def x19_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag overlap and valid format of every answer."""
    return _card(spark, sf_dir).select("doc_id", F.round("tag_jaccard", 9).alias("tag_jaccard"), "format_valid")


_LENGTH = "CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 'unknown' WHEN n_chars <= 2048 THEN '<=2k' WHEN n_chars <= 4096 THEN '2-4k' WHEN n_chars <= 8192 THEN '4-8k' WHEN n_chars <= 16384 THEN '8-16k' ELSE '>16k' END"
_SLICES_SQL = f"""{_CARD_SQL}, maj AS (SELECT question, gold AS majority FROM (SELECT question, gold, count(*) AS n FROM card GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, gold) = 1),
x AS (SELECT *, unnest(list_filter(['overall', 'dataset=' || source, 'family=' || lang, 'cell=' || cell, 'qid=' || question, 'difficult=' || difficult::VARCHAR, 'over_cap=' || over_cap::VARCHAR,
  CASE WHEN question = 'q5' THEN 'cell=unseen_q_no_twin' END, CASE WHEN question = 'q5' AND NOT gated THEN 'cell=unseen_q_ungated' END, CASE WHEN format_valid THEN 'cell=' || cell || '/valid_only' END,
  'band=' || band, 'band=' || band || '/cell=' || cell, CASE WHEN format_valid THEN 'band=' || band || '/cell=' || cell || '/valid_only' END, CASE WHEN NOT shortcut THEN 'band=' || band || '/cell=' || cell || '/no_shortcut' END,
  'length=' || {_LENGTH}, CASE WHEN lang = 'en' THEN 'priority=en/' || source END], lambda s: s IS NOT NULL)) AS slice FROM card JOIN maj USING (question))"""


def _named(spark: SparkSession, sf_dir: str):
    c = _card(spark, sf_dir)
    c = c.join(scoring.majority(c, ["question"], "gold"), "question")
    return c, benchmarks.card_slices(c, twinned=("q4",), priority=("en",))


_METRICS = ("answer_exact", "answer_recovered", "answer_invalid", "answer_credit", "accuracy", "ev_valid", "ev_f1", "ev_exact", "gold_empty_share", "parsed", "format_valid", "tag_jaccard", "macro_f1", "majority_macro_f1")


@query("a10_summaries", f"""
WITH {_SLICES_SQL}, m AS (SELECT slice, count(*) AS n, avg((status = 'exact')::INT) AS answer_exact, avg((status = 'recovered')::INT) AS answer_recovered, avg((status = 'invalid')::INT) AS answer_invalid, avg(credit) AS answer_credit,
  avg((status = 'exact' AND pred = gold)::INT) AS accuracy, avg(ev_valid::INT) AS ev_valid, avg(ev_f1) AS ev_f1, avg(ev_exact) AS ev_exact, avg(gold_empty::INT) AS gold_empty_share, avg(parsed::INT) AS parsed, avg(format_valid::INT) AS format_valid, avg(tag_jaccard) AS tag_jaccard FROM x GROUP BY slice)
SELECT slice, n, {', '.join(f'round({c}, 8) AS {c}' for c in _METRICS)}, preds, golds
FROM m JOIN {_f1_sql('x', 'slice')} USING (slice) JOIN (SELECT slice, macro_f1 AS majority_macro_f1 FROM {_f1_sql('x', 'slice', 'majority')}) USING (slice)
JOIN (SELECT slice, string_agg(pred || ':' || n::VARCHAR, ',' ORDER BY pred) AS preds FROM (SELECT slice, pred, count(*) AS n FROM x GROUP BY ALL) GROUP BY slice) USING (slice)
JOIN (SELECT slice, string_agg(gold || ':' || n::VARCHAR, ',' ORDER BY gold) AS golds FROM (SELECT slice, gold, count(*) AS n FROM x GROUP BY ALL) GROUP BY slice) USING (slice)""")
def a10_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics and both distributions of every slice of the card."""
    rows, slices = _named(spark, sf_dir)
    out = benchmarks.summaries(rows, slices, majority="majority")
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("slice", "n", *[F.round(c, 8).alias(c) for c in _METRICS], said("pred_distribution").alias("preds"), said("gold_distribution").alias("golds"))


@query("a12_card_slices", f"WITH {_SLICES_SQL} SELECT slice, count(*) AS n FROM x GROUP BY slice")
def a12_card_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each slice of the card has."""
    rows, slices = _named(spark, sf_dir)
    return rows.select(F.explode(slices).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))


_BLIND = """sum((maj = gold)::INT)::BIGINT AS hits, count(*) AS n, round(avg(CASE WHEN gold_empty THEN 1.0 ELSE 0.0 END::DOUBLE), 8) AS ev_f1"""


@query("a13_band_floors", f"""
WITH {_CARD_SQL}, g AS (SELECT * EXCLUDE (question), CASE WHEN doc_id = (SELECT min(doc_id) FROM card) THEN 'once' ELSE question END AS question, CASE WHEN h < 8 THEN gold ELSE 'fail' END AS teacher FROM card),
f AS (SELECT question, gold, teacher, coalesce(band, '') AS b, gold_empty FROM g),
m1 AS (SELECT question, b, gold AS maj FROM (SELECT question, b, gold, count(*) AS n FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question, b ORDER BY n DESC, gold) = 1),
m2 AS (SELECT question, teacher AS maj FROM (SELECT question, teacher, count(*) AS n FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, teacher) = 1),
all1 AS (SELECT arg_min(gold, (-n, gold)) AS w FROM (SELECT gold, count(*) AS n FROM f GROUP BY ALL)), all2 AS (SELECT arg_min(teacher, (-n, teacher)) AS w FROM (SELECT teacher, count(*) AS n FROM f GROUP BY ALL)),
once AS (SELECT question, count(*) = 1 AS o FROM f GROUP BY question),
z AS (SELECT 'band:' || b AS floor, gold, gold_empty, CASE WHEN o THEN w ELSE m1.maj END AS maj FROM f JOIN m1 USING (question, b) JOIN once USING (question), all1
  UNION ALL SELECT 'teacher', gold, gold_empty, CASE WHEN o THEN w ELSE m2.maj END FROM f JOIN m2 USING (question) JOIN once USING (question), all2)
SELECT floor, {_BLIND} FROM z GROUP BY floor""")
def a13_band_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of blind answers: each question's majority in its band, and a teacher's majority; a lone question takes that of its options.

    The first document's question stands for a lone one; the teacher says "fail" for a fifth of the documents.
    """
    c = _card(spark, sf_dir)
    first = F.broadcast(c.agg(F.min("doc_id").alias("first")))  # one row
    g = c.join(first).withColumn("question", F.when(F.col("doc_id") == F.col("first"), "once").otherwise(F.col("question")))
    g = g.select("doc_id", "question", "options", "gold", "gold_evidence", "n_lines", F.coalesce("band", F.lit("")).alias("band"), F.when(F.col("h") < 8, F.col("gold")).otherwise("fail").alias("teacher"))
    own = benchmarks.floors(g, ["question", "band"]).withColumn("floor", F.concat(F.lit("band:"), "band"))
    teacher = benchmarks.floors(g, ["question"], answer="teacher").withColumn("floor", F.lit("teacher"))
    rows = benchmarks.blind(own.unionByName(teacher), "majority")
    return rows.groupBy("floor").agg(F.count_if(F.col("pred") == F.col("gold")).alias("hits"), F.count("*").alias("n"), F.round(F.avg("ev_f1"), 8).alias("ev_f1"))


_TWO = "two AS (SELECT question, gold, CASE WHEN h < 8 THEN gold ELSE 'fail' END AS other, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS stratum FROM scored)"


@query("a15_rare_rule", f"""
WITH {PAIRS_SQL}, {_TWO}, st AS (SELECT question, count(*) FILTER (stratum = 'short') AS ns, count(*) FILTER (stratum = 'long') AS nl, round_even(avg((gold = other)::INT) FILTER (stratum = 'short'), 3) AS s, round_even(avg((gold = other)::INT) FILTER (stratum = 'long'), 3) AS l,
  count(*) FILTER (gold <> 'none') AS positives, round_even(avg((gold = other)::INT) FILTER (gold <> 'none'), 3) AS positive_agreement FROM two GROUP BY question)
SELECT question, positives, positive_agreement, ns >= 20 AND nl >= 20 AND positives >= 3 AS measurable, CASE WHEN ns >= 20 AND nl >= 20 AND positives >= 3 THEN coalesce((s < 0.8)::INT, 0) + coalesce((l < 0.8)::INT, 0) ELSE 0 END::INTEGER AS reasons FROM st""")
def a15_rare_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions judged as rare events: agreement by stratum, and on the rows where the event happened."""
    two = pairs(spark, sf_dir).select("question", "gold", F.when(F.col("h") < 8, F.col("gold")).otherwise("fail").alias("other"), F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("stratum"))
    return benchmarks.rare_rule(two, "question", "gold", "other", "stratum", ["short", "long"]).withColumn("reasons", F.size("reasons"))


@query("a17_costs", f"""
WITH {PAIRS_SQL}, l AS (SELECT 'm' || (doc_id % 3)::VARCHAR AS labeller, (n_chars % 100) / 1000::DOUBLE AS cost, doc_id * 7 AS moment, evidence, coalesce(answer, '') AS answer, gold FROM scored)
SELECT labeller, count(*) AS labels, round(avg(cost), 9) AS cost_per_label, round(count(*) / ((max(moment) - min(moment)) / 60::DOUBLE), 9) AS labels_per_minute, round(avg((coalesce(len(evidence), 0) = 0)::INT), 9) AS empty_evidence,
  count(*) FILTER (answer = 'none' AND gold = 'fail') AS a_for_b, count(*) FILTER (answer = 'fail' AND gold = 'none') AS b_for_a FROM l GROUP BY labeller""")
def a17_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and speed of three labellers, and how often they swap "none" and "fail"."""
    p = pairs(spark, sf_dir).select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("labeller"), ((F.col("n_chars") % 100) / 1000).alias("cost"), (F.col("doc_id") * 7).alias("at"), "evidence", F.coalesce("answer", F.lit("")).alias("answer"), "gold")
    costs = benchmarks.labeller_costs(p, "labeller", "cost", "at", "evidence")
    out = costs.join(benchmarks.swapped_answers(p, "labeller", "answer", "gold", "none", "fail"), "labeller")
    return out.select("labeller", "labels", *[F.round(c, 9).alias(c) for c in ("cost_per_label", "labels_per_minute", "empty_evidence")], "a_for_b", "b_for_a")


_AUDIT = """lv AS (SELECT question, lang, unnest(['a', 'b', 'c']) AS labeller, unnest([gold, pred_raw, CASE WHEN h < 7 THEN 'none' ELSE 'pass' END]) AS answer FROM scored),
ct AS (SELECT question, lang, labeller, answer, count(*) AS n FROM lv GROUP BY ALL), sh AS (SELECT question, lang, labeller, max(n) / sum(n)::DOUBLE AS top, coalesce(sum(n) FILTER (answer = 'none'), 0) / sum(n)::DOUBLE AS nn FROM ct GROUP BY ALL),
fl AS (SELECT question, lang, count(*) AS labellers, count(*) FILTER (nn >= 0.4) AS x, count(*) FILTER (nn < 0.4 AND top >= 0.6) AS y FROM sh GROUP BY ALL)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.score_pairs(pairs(spark, sf_dir))
    said = {"a": F.col("gold"), "b": F.col("pred_raw"), "c": F.when(F.col("h") < 7, "none").otherwise("pass")}
    votes = s.select("question", "lang", F.explode(F.array(*[F.struct(F.lit(n).alias("labeller"), c.alias("answer")) for n, c in said.items()])).alias("v")).select("question", "lang", "v.*")
    return benchmarks.bank_audit(votes, "question", "lang", "labeller", "answer", "none", none_cut=0.4, top_cut=0.6)


@query("a19_bank_audit", f"WITH {PAIRS_SQL}, {_AUDIT} SELECT question, lang, labellers, x * 2 > labellers AS none_dominant, y * 2 > labellers AS skewed, x > 0 AND x < labellers OR y > 0 AND y < labellers AS disputed FROM fl")
def a19_bank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by language that most of three labellers find dominated by "none" or skewed to one answer."""
    return _audit(spark, sf_dir)


@query("a19_allow_list", f"""
WITH {PAIRS_SQL}, {_AUDIT}, al AS (SELECT question, lang, NOT (x * 2 > labellers) AS allow, question IN ('q0', 'q1') OR lang = 'en' AS now FROM fl)
SELECT question, array_to_string(list_sort(list(lang) FILTER (allow AND NOT now)), ',') AS add, array_to_string(list_sort(list(lang) FILTER (now AND NOT allow)), ',') AS drop FROM al GROUP BY question""")
def a19_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that the audit would add to or drop from a question's list."""
    current = pairs(spark, sf_dir).where(F.col("question").isin("q0", "q1") | (F.col("lang") == "en")).select("question", "lang")
    out = benchmarks.allow_list_changes(_audit(spark, sf_dir), current, "question", "lang")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return out.select("question", joined("add").alias("add"), joined("drop").alias("drop"))
