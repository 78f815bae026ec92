"""Queries over labelled answers. Gold and answers are derived from labels and ids, alike here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import agreement, podcasts, ranks, scoring, splits
from millrace.plans.tables import table

_OPTIONS = "['pass', 'fail', 'none']"
PAIRS_SQL = _PAIRS = """pairs AS (SELECT doc_id, source, lang, 'q' || (doc_id % 6)::VARCHAR AS question, n_chars, 3 + doc_id % 5 AS n_lines,
    CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'none' ELSE 'fail' END AS gold, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 6))::BIGINT % 10 AS h
  FROM labels JOIN documents USING (doc_id)),
a AS (SELECT *, CASE WHEN h < 6 THEN gold WHEN h = 6 THEN ' Pass' WHEN h = 7 THEN 'no such' WHEN h = 8 THEN 'fail' END AS answer,
    CASE WHEN doc_id % 4 = 0 THEN []::BIGINT[] ELSE [1 + doc_id % 3] END AS gold_evidence FROM pairs),
b AS (SELECT *, CASE WHEN h < 5 THEN gold_evidence WHEN h = 5 THEN [1, 2]::BIGINT[] WHEN h = 6 THEN [2, 1]::BIGINT[] WHEN h = 7 THEN [9]::BIGINT[] WHEN h = 8 THEN []::BIGINT[] END AS evidence FROM a),
s AS (SELECT *, CASE WHEN answer IN ('pass', 'fail', 'none') THEN 'exact' WHEN lower(trim(answer)) IN ('pass', 'fail', 'none') THEN 'recovered' ELSE 'invalid' END AS status,
    coalesce(evidence = list_sort(list_distinct(evidence)) AND len(list_filter(evidence, lambda e: e < 1 OR e > n_lines)) = 0, false) AS ev_valid FROM b),
t AS (SELECT *, CASE WHEN status = 'exact' THEN answer ELSE 'invalid' END AS pred, CASE status WHEN 'exact' THEN answer WHEN 'recovered' THEN lower(trim(answer)) ELSE 'invalid' END AS pred_raw,
    CASE status WHEN 'exact' THEN 1.0 WHEN 'recovered' THEN 0.3 ELSE 0.0 END::DOUBLE AS credit, len(gold_evidence) = 0 AS gold_empty, len(list_intersect(evidence, gold_evidence)) AS i, len(evidence) AS ne, len(gold_evidence) AS ng FROM s),
u AS (SELECT *, (CASE WHEN NOT ev_valid THEN 0 WHEN ne > 0 THEN i / ne::DOUBLE WHEN ng = 0 THEN 1 ELSE 0 END)::DOUBLE AS ev_precision,
    (CASE WHEN NOT ev_valid THEN 0 WHEN ng > 0 THEN i / ng::DOUBLE WHEN ne = 0 THEN 1 ELSE 0 END)::DOUBLE AS ev_recall, (ev_valid AND i = ne AND i = ng)::INT::DOUBLE AS ev_exact FROM t),
scored AS (SELECT *, CASE WHEN ev_precision + ev_recall > 0 THEN 2 * ev_precision * ev_recall / (ev_precision + ev_recall) ELSE 0 END::DOUBLE AS ev_f1 FROM u)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    p = table(spark, sf_dir, "labels").join(d, "doc_id")
    p = p.withColumn("gold", F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "none").otherwise("fail"))
    p = p.withColumn("h", F.conv(F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 10)
    h, none = F.col("h"), F.array().cast("array<bigint>")
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    p = p.withColumn("gold_evidence", F.when(F.col("doc_id") % 4 == 0, none).otherwise(F.array(1 + F.col("doc_id") % 3)))
    return p.select(
        "doc_id", "source", "lang", "n_chars", F.concat(F.lit("q"), F.col("doc_id") % 6).alias("question"), (3 + F.col("doc_id") % 5).alias("n_lines"), "gold", "h",
        F.when(h < 6, F.col("gold")).when(h == 6, " Pass").when(h == 7, "no such").when(h == 8, "fail").alias("answer"), "gold_evidence",
        F.when(h < 5, F.col("gold_evidence")).when(h == 5, longs(1, 2)).when(h == 6, longs(2, 1)).when(h == 7, longs(9)).when(h == 8, none).alias("evidence"),
        F.array(*[F.lit(o) for o in ("pass", "fail", "none")]).alias("options"),
    )


pairs = _pairs


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pairs(_pairs(spark, sf_dir))


@query("x19_pair_scores", f"WITH {_PAIRS} SELECT doc_id, status, pred, pred_raw, credit, ev_valid, ev_precision, ev_recall, round(ev_f1, 9) AS ev_f1, ev_exact FROM scored")
def x19_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, credit and evidence scores of every answer."""
    return _scored(spark, sf_dir).select("doc_id", "status", "pred", "pred_raw", "credit", "ev_valid", "ev_precision", "ev_recall", F.round("ev_f1", 9).alias("ev_f1"), "ev_exact")


def _f1_sql(rows: str, keys: str, pred: str = "pred") -> str:
    k = f"{keys}, " if keys else ""
    return f"""(SELECT {k}coalesce(avg(CASE WHEN g + p > 0 THEN 2 * tp / (g + p)::DOUBLE END), 0) AS macro_f1 FROM (
  SELECT {k}class, sum(tp) AS tp, sum(g) AS g, sum(p) AS p FROM (
    SELECT {k}gold AS class, (gold = {pred})::INT AS tp, 1 AS g, 0 AS p, true AS named FROM {rows} UNION ALL
    SELECT {k}{pred}, 0, 0, 1, false FROM {rows} UNION ALL SELECT DISTINCT {k}unnest({_OPTIONS}), 0, 0, 0, true FROM {rows}) GROUP BY {k}class HAVING bool_or(named)) {f'GROUP BY {keys}' if keys else ''})"""


_SLICED = """x AS (SELECT *, unnest(list_filter(['overall', 'source:' || source, 'lang:' || lang, 'question:' || question,
  'length:' || CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 'unknown' WHEN n_chars <= 2048 THEN '<=2k' WHEN n_chars <= 4096 THEN '2-4k' WHEN n_chars <= 8192 THEN '4-8k' WHEN n_chars <= 16384 THEN '8-16k' ELSE '>16k' END,
  CASE WHEN status = 'exact' THEN 'valid_only' END, CASE WHEN lang = 'en' THEN 'source x en:' || source END], lambda v: v IS NOT NULL)) AS slice FROM scored)"""


@query("a12_slice_scores", f"""
WITH {_PAIRS}, {_SLICED}, m AS (SELECT slice, count(*) AS n, avg((status = 'exact')::INT) AS answer_exact, avg((status = 'recovered')::INT) AS answer_recovered, avg((status = 'invalid')::INT) AS answer_invalid,
  avg(credit) AS answer_credit, avg((status = 'exact' AND pred = gold)::INT) AS accuracy, avg(ev_valid::INT) AS ev_valid, avg(ev_precision) AS ev_precision, avg(ev_recall) AS ev_recall, avg(ev_f1) AS ev_f1, avg(ev_exact) AS ev_exact,
  avg(gold_empty::INT) AS gold_empty_share, avg(ev_exact) FILTER (gold_empty) AS gold_empty_matched, avg(ev_precision) FILTER (NOT gold_empty) AS ev_precision_nonempty, avg(ev_recall) FILTER (NOT gold_empty) AS ev_recall_nonempty FROM x GROUP BY slice)
SELECT slice, n, {', '.join(f'round({c}, 8) AS {c}' for c in ('answer_exact', 'answer_recovered', 'answer_invalid', 'answer_credit', 'accuracy', 'ev_valid', 'ev_precision', 'ev_recall', 'ev_f1', 'ev_exact', 'gold_empty_share', 'gold_empty_matched', 'ev_precision_nonempty', 'ev_recall_nonempty', 'macro_f1'))}
FROM m JOIN {_f1_sql('x', 'slice')} USING (slice)""")
def a12_slice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of overlapping slices: overall, by source, language, question and length, valid answers only, English by source."""
    name = lambda p, c: F.concat(F.lit(p + ":"), c)
    slices = F.array_compact(F.array(
        F.lit("overall"), name("source", F.col("source")), name("lang", F.col("lang")), name("question", F.col("question")), name("length", X.length_bucket("n_chars")),
        F.when(F.col("status") == "exact", "valid_only"), F.when(F.col("lang") == "en", name("source x en", F.col("source"))),
    ))
    out = scoring.slice_scores(_scored(spark, sf_dir), slices)
    return out.select("slice", "n", *[F.round(c, 8).alias(c) for c in out.columns[2:]])


@query("a11_confusion", f"WITH {_PAIRS} SELECT lang, gold, pred, count(*) AS n FROM scored GROUP BY ALL")
def a11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted answers by language."""
    return scoring.confusion(_scored(spark, sf_dir), ["lang"])


_MAJORITY = "maj AS (SELECT question, gold AS majority FROM (SELECT question, gold, count(*) AS n FROM scored GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, gold) = 1)"


@query("a8_majority", f"WITH {_PAIRS}, {_MAJORITY} SELECT question, majority FROM maj")
def a8_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent gold answer of each question."""
    return scoring.majority(_pairs(spark, sf_dir), ["question"], "gold")


@query("a13_floors", f"""
WITH {_PAIRS}, {_MAJORITY}, f AS (SELECT question, lang, gold, majority FROM scored JOIN maj USING (question))
SELECT lang, round(avg((majority = gold)::INT), 8) AS accuracy, round(any_value(macro_f1), 8) AS macro_f1 FROM f JOIN {_f1_sql('f', 'lang', 'majority')} USING (lang) GROUP BY lang""")
def a13_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answering every question with its majority would score, by language."""
    rows = _pairs(spark, sf_dir)
    rows = rows.join(scoring.majority(rows, ["question"], "gold"), "question")
    accuracy = rows.groupBy("lang").agg(F.round(F.avg((F.col("majority") == F.col("gold")).cast("double")), 8).alias("accuracy"))
    return accuracy.join(scoring.macro_f1(rows, ["lang"], pred="majority"), "lang").withColumn("macro_f1", F.round("macro_f1", 8))


_KAPPA = """j AS (SELECT question, stratum, gold AS x, other AS y, count(*) AS n FROM two GROUP BY ALL), w AS (SELECT question, stratum, sum(n) AS pairs, sum(n) FILTER (x = y) AS same FROM j GROUP BY ALL),
l AS (SELECT question, stratum, x, sum(n) AS na FROM j GROUP BY ALL), r AS (SELECT question, stratum, y AS x, sum(n) AS nb FROM j GROUP BY ALL),
c AS (SELECT question, stratum, sum(na * nb)::DOUBLE AS chance FROM l JOIN r USING (question, stratum, x) GROUP BY ALL),
v AS (SELECT question, stratum, pairs::BIGINT AS pairs, coalesce(same, 0) / pairs::DOUBLE AS agreement, coalesce(chance, 0) / (pairs * pairs)::DOUBLE AS e FROM w LEFT JOIN c USING (question, stratum)),
k AS (SELECT question, stratum, pairs, agreement, CASE WHEN e >= 1 THEN CASE WHEN agreement = 1 THEN 1.0 END ELSE (agreement - e) / (1 - CASE WHEN e >= 1 THEN 0 ELSE e END) END AS kappa FROM v)"""
_TWO = "two AS (SELECT doc_id, question, gold, CASE WHEN h < 8 THEN gold ELSE 'fail' END AS other, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS stratum FROM scored)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellers: the gold label, and one that says "fail" for a fifth of the documents."""
    other = F.when(F.col("h") < 8, F.col("gold")).otherwise("fail")
    return _pairs(spark, sf_dir).select("doc_id", "question", "gold", other.alias("other"), F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("stratum"))


def _kappas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa(_two(spark, sf_dir), ["question", "stratum"], "gold", "other")


@query("a14_kappa", f"WITH {_PAIRS}, {_TWO}, {_KAPPA} SELECT question, stratum, pairs, round(agreement, 9) AS agreement, round(kappa, 9) AS kappa FROM k")
def a14_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two labellers by question and stratum."""
    return _kappas(spark, sf_dir).withColumn("agreement", F.round("agreement", 9)).withColumn("kappa", F.round("kappa", 9))


_CUT = """p AS (SELECT question, coalesce(max(pairs) FILTER (stratum = 'short'), 0) >= 20 AND coalesce(max(pairs) FILTER (stratum = 'long'), 0) >= 20 AS measurable,
  list_filter([CASE WHEN round_even(max(kappa) FILTER (stratum = 'short'), 3) < 0.4 THEN 'short' END, CASE WHEN round_even(max(kappa) FILTER (stratum = 'long'), 3) < 0.4 THEN 'long' END], lambda z: z IS NOT NULL) AS low FROM k GROUP BY question),
n AS (SELECT question, sum(n) AS n, max(n) AS top, coalesce(sum(n) FILTER (gold = 'none'), 0) AS none FROM (SELECT question, gold, count(*) AS n FROM two GROUP BY ALL) GROUP BY question),
cut AS (SELECT question, measurable, (CASE WHEN measurable THEN len(low) ELSE 0 END + (none / n::DOUBLE > 0.75)::INT + (top / n::DOUBLE > 0.9)::INT)::INTEGER AS reasons FROM p JOIN n USING (question))"""


@query("a15_cut_rules", f"WITH {_PAIRS}, {_TWO}, {_KAPPA}, {_CUT} SELECT question, measurable, reasons FROM cut")
def a15_cut_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that the rules of the pilot cut: how many reasons each has."""
    cut = agreement.cut_rules(_kappas(spark, sf_dir), _two(spark, sf_dir).select("question", F.col("gold").alias("answer")), "question", ["short", "long"])
    return cut.withColumn("reasons", F.size("reasons"))


@query("a15_stop_rule", f"""
WITH {_PAIRS}, {_TWO}, {_KAPPA}, {_CUT}, m AS (SELECT stratum, round_even(avg(round_even(kappa, 3)), 3) AS mean_kappa FROM k JOIN cut USING (question) WHERE measurable GROUP BY stratum)
SELECT stratum, mean_kappa, coalesce(stratum = 'long' AND (mean_kappa < 0.4 OR (SELECT mean_kappa FROM m WHERE stratum = 'short') - mean_kappa > 0.2), false) AS stops FROM m""")
def a15_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean kappa of the measurable questions by stratum, and whether the long one stops the study."""
    k = _kappas(spark, sf_dir)
    cut = agreement.cut_rules(k, _two(spark, sf_dir).select("question", F.col("gold").alias("answer")), "question", ["short", "long"])
    return agreement.stop_rule(k, cut, "question", "short", "long")


@query("a16_evidence_thirds", f"""
WITH {_PAIRS}, e AS (SELECT lang, n_lines, unnest(gold_evidence) AS line FROM scored), th AS (SELECT lang, least(2, greatest(0, (line - 1) * 3 // greatest(1, n_lines))) AS t FROM e)
SELECT lang, count(*) AS cited, round_even(avg((t = 0)::INT), 4) AS first, round_even(avg((t = 1)::INT), 4) AS middle, round_even(avg((t = 2)::INT), 4) AS last FROM th GROUP BY lang""")
def a16_evidence_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the lines the gold evidence lies, by language."""
    cites = _pairs(spark, sf_dir).select("lang", "n_lines", F.explode("gold_evidence").alias("line"))
    return agreement.evidence_thirds(cites, ["lang"], X.third_of("line", "n_lines"))


@query("a17_labeller_report", f"""
WITH {_PAIRS}, l AS (SELECT 'm' || (doc_id % 3)::VARCHAR AS labeller, gold, coalesce(answer, '') AS answer, list_distinct([lang, source]) AS gold_tags, CASE WHEN h < 7 THEN [lang, source] ELSE [lang] END AS tags FROM scored)
SELECT labeller, count(*) AS n, round(avg((answer = gold)::INT), 9) AS accuracy, round(avg((answer = gold)::INT) FILTER (gold <> 'none'), 9) AS rare_recall,
  round(avg(len(list_intersect(tags, gold_tags)) / len(list_distinct(list_concat(tags, gold_tags)))::DOUBLE), 9) AS tag_jaccard FROM l GROUP BY labeller""")
def a17_labeller_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, recall of rare events and tag overlap of three labellers (by document number)."""
    p = _pairs(spark, sf_dir)
    rows = p.select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("labeller"), "gold", F.coalesce("answer", F.lit("")).alias("answer"), F.array("lang", "source").alias("gold_tags"), F.when(F.col("h") < 7, F.array("lang", "source")).otherwise(F.array("lang")).alias("tags"))
    out = agreement.labeller_report(rows, "labeller", "answer", "gold", "tags", "gold_tags")
    return out.select("labeller", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "rare_recall", "tag_jaccard")])


@query("a18_grades", f"""
WITH {_PAIRS}, g AS (SELECT lang, 1 + h % 5 AS judge, 1 + doc_id % 5 AS person FROM scored)
SELECT lang, count(*) AS n, round(avg((judge = person)::INT), 9) AS exact, round(avg((abs(judge - person) <= 1)::INT), 9) AS within_one FROM g GROUP BY lang""")
def a18_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two derived grades by language."""
    rows = _pairs(spark, sf_dir).select("lang", (1 + F.col("h") % 5).alias("judge"), (1 + F.col("doc_id") % 5).alias("person"))
    out = agreement.grade_agreement(rows, ["lang"], "judge", "person")
    return out.select("lang", "n", F.round("exact", 9).alias("exact"), F.round("within_one", 9).alias("within_one"))


@query("a19_disputes", f"""
WITH {_PAIRS}, v AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS labeller, unnest([gold, pred_raw, CASE WHEN h % 2 = 0 THEN 'pass' ELSE 'none' END]) AS answer FROM scored),
n AS (SELECT doc_id, answer, count(*) AS n FROM v GROUP BY ALL), best AS (SELECT doc_id, sum(n)::BIGINT AS voters, max(n) AS top, arg_min(answer, (-n, answer)) AS best FROM n GROUP BY doc_id)
SELECT doc_id, voters, CASE WHEN top * 2 > voters THEN best END AS answer, NOT (top * 2 > voters) AS disputed FROM best""")
def a19_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that over half of three labellers give."""
    s = _scored(spark, sf_dir)
    votes = s.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("l"), c.alias("a")) for n, c in (("a", F.col("gold")), ("b", F.col("pred_raw")), ("c", F.when(F.col("h") % 2 == 0, "pass").otherwise("none")))])).alias("v"))
    return agreement.strict_majority(votes.select("doc_id", F.col("v.l").alias("labeller"), F.col("v.a").alias("answer")), "doc_id", "labeller", "answer")


@query("a20_answer_shares", f"""
WITH {_PAIRS}, n AS (SELECT question, gold, count(*) AS n FROM scored GROUP BY ALL), sh AS (SELECT *, n / (sum(n) OVER (PARTITION BY question))::DOUBLE AS share FROM n)
SELECT question, gold, n, round(share, 9) AS share, max(share) OVER (PARTITION BY question) >= 0.8 AS skewed FROM sh""")
def a20_answer_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the gold answers of each question."""
    return agreement.answer_shares(_pairs(spark, sf_dir), ["question"], "gold").withColumn("share", F.round("share", 9))


@query("j5_filled_outputs", f"""
WITH {_PAIRS}, g AS (SELECT doc_id AS id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['clean'] ELSE ['clean', 'messy'] END) AS variant FROM scored),
o AS (SELECT doc_id AS id, CASE WHEN k % 2 = 0 THEN 'clean' ELSE 'messy' END AS variant, k, coalesce(answer, '-') || k::VARCHAR AS text FROM scored, range(4) r(k) WHERE h <> 3),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id, variant ORDER BY k) = 1)
SELECT id, variant, coalesce(text, '') AS text FROM g LEFT JOIN f USING (id, variant)""")
def j5_filled_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output for each record and variant: the first, or an empty one."""
    s = _pairs(spark, sf_dir)
    gold = s.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("clean"))).otherwise(F.array(F.lit("clean"), F.lit("messy"))).alias("variants"))
    out = s.where("h <> 3").withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(3))))
    out = out.select(F.col("doc_id").alias("id"), F.when(F.col("line") % 2 == 0, "clean").otherwise("messy").alias("variant"), "line", F.concat(F.coalesce("answer", F.lit("-")), F.col("line")).alias("text"))
    return scoring.fill_outputs(gold, out).select("id", "variant", "text")


@query("j6_latest_labels", f"""
WITH {_PAIRS}, r AS (SELECT doc_id, h AS file, n_chars AS line, gold FROM scored UNION ALL SELECT doc_id, doc_id % 10, 0, answer FROM scored)
SELECT doc_id, file, line, gold FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY file DESC, line DESC) = 1""")
def j6_latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the last file and line for each document."""
    s = _pairs(spark, sf_dir)
    rows = s.select("doc_id", F.col("h").alias("file"), F.col("n_chars").alias("line"), "gold").unionByName(s.select("doc_id", (F.col("doc_id") % 10).alias("file"), F.lit(0).cast("long").alias("line"), F.col("answer").alias("gold")))
    return podcasts.latest(rows, "doc_id", ["file", "line"])


@query("j16_disagreements", f"WITH {_PAIRS} SELECT doc_id, gold, answer FROM scored WHERE gold IS DISTINCT FROM answer")
def j16_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose answer is missing or other than the gold one."""
    return _pairs(spark, sf_dir).where(~F.col("gold").eqNullSafe(F.col("answer"))).select("doc_id", "gold", "answer")


@query("u6_shared_variants", f"""
WITH {_PAIRS} SELECT question FROM (SELECT DISTINCT question, gold FROM scored) GROUP BY question HAVING count(*) = 3""")
def u6_shared_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that have every answer."""
    return scoring.shared_items(_pairs(spark, sf_dir), "question", "gold", 3)


@query("f7_complete", f"""
WITH {_PAIRS} SELECT source FROM (SELECT DISTINCT source, question FROM scored) GROUP BY source HAVING count(*) = (SELECT count(DISTINCT question) FROM scored)""")
def f7_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a label on every question."""
    p = _pairs(spark, sf_dir)
    return splits.complete(p, "source", "question", p)


@query("f7_complete_languages", f"WITH {_PAIRS} SELECT lang FROM (SELECT DISTINCT lang, question FROM scored) GROUP BY lang HAVING count(*) = (SELECT count(DISTINCT question) FROM scored)")
def f7_complete_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with a label on every question."""
    p = _pairs(spark, sf_dir)
    return splits.complete(p, "lang", "question", p)


@query("ps8_sides", f"""
WITH {_PAIRS}, sd AS (SELECT DISTINCT source, CASE WHEN source IN ('src1', 'src2') THEN 'benchmark' WHEN source = 'src3' THEN 'val' ELSE 'train' END AS side FROM scored)
SELECT CASE WHEN side <> 'benchmark' AND question = 'q5' THEN 'drop' ELSE side END AS side, CASE WHEN side = 'benchmark' THEN CASE WHEN question = 'q5' THEN 'unseen_q' ELSE 'seen_q' END END AS cell, count(*) AS n
FROM scored JOIN sd USING (source) GROUP BY ALL""")
def ps8_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on each side and cell when sources are split and one question is held out."""
    p = _pairs(spark, sf_dir)
    split = p.select("source").distinct().withColumn("side", F.when(F.col("source").isin("src1", "src2"), "benchmark").when(F.col("source") == "src3", "val").otherwise("train"))
    return splits.assign_sides(p, split, "source", F.col("question") == "q5").groupBy("side", "cell").agg(F.count("*").alias("n"))


@query("a26_composite_counts", f"WITH {_PAIRS} SELECT source, gold, status, count(*) AS n FROM scored GROUP BY ALL")
def a26_composite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, gold answer and status."""
    return _scored(spark, sf_dir).groupBy("source", "gold", "status").agg(F.count("*").alias("n"))


@query("m19_cost_shares", f"WITH {_PAIRS} SELECT doc_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY source, question), 9) AS cost FROM scored")
def m19_cost_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even share of a call's cost; a call is a source and question."""
    p = _pairs(spark, sf_dir)
    n = p.groupBy("source", "question").agg(F.count("*").alias("n"))
    return p.join(n, ["source", "question"]).select("doc_id", F.round(1.0 / F.col("n"), 9).alias("cost"))
