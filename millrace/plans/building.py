"""Queries that build datasets: population samples, draws, selections, splits, examples, orders and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import examples, ranks, reviews, scans, search, selection, splits, strata
from millrace.plans.corpus import _CELLS, _GROUPS, _cells, _groups
from millrace.plans.scores import PAIRS_SQL, pairs
from millrace.plans.tables import ranks_sql, share_sql, table, words_sql
from millrace.sources import files

_D = f"SELECT doc_id, source, lang, n_chars, text, {words_sql('text')} AS n_words FROM documents"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("n_words", X.word_count("text"))


def _hash(seed: int, item: str = "doc_id") -> str:
    return f"sha1('{seed}|' || {item}::VARCHAR)"


_BANDS = [("a", 0, 150), ("b", 150, 400), ("c", 400, 1200)]


@query("ps1_population", f"""
WITH d AS ({_D}), s AS (SELECT * FROM (VALUES ('a', 0, 150), ('b', 150, 400), ('c', 400, 1200)) v(s, a, b)), w AS (SELECT doc_id, s, doc_id % 5 <> 0 AND n_words >= a AND n_words < b AS good FROM d JOIN s ON n_chars // 7 >= 0.8 * a AND n_chars // 7 < 1.25 * b),
r AS (SELECT *, coalesce(sum(good::INT) OVER (PARTITION BY s ORDER BY {_hash(3)}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, string_agg(s, ',' ORDER BY s) AS windows FROM r WHERE before < 10 GROUP BY doc_id""")
def ps1_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the walks of three bands reach until ten good ones each; an estimate of words opens the windows."""
    d = _docs(spark, sf_dir).select("doc_id", F.floor(F.col("n_chars") / 7).alias("estimate"), "n_words", F.when(F.col("doc_id") % 5 == 0, "checks").alias("reject"))
    return strata.population_sample(d, "doc_id", _BANDS, "estimate", "n_words", "reject", 10, 3).select("doc_id", F.array_join("windows", ",").alias("windows"))


@query("ps3_gap_draw", f"""
WITH d AS (SELECT *, least(n_words // 200, 4) AS cell FROM ({_D})), h AS (SELECT * FROM d WHERE doc_id % 20 = 0), u AS (SELECT source, count(*) AS used FROM h GROUP BY source),
f AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY {_hash(4)}, doc_id) AS own, coalesce(used, 0) AS used FROM d LEFT JOIN u USING (source) WHERE doc_id % 20 <> 0) WHERE own + used <= 8),
t AS (SELECT DISTINCT lang, cell FROM d), w AS (SELECT t.lang, t.cell, ceil(greatest(0, 6 - count(h.doc_id)) * 1.06::DOUBLE) AS want FROM t LEFT JOIN h ON h.lang = t.lang AND h.cell = t.cell GROUP BY t.lang, t.cell)
SELECT doc_id, lang, cell FROM f JOIN w USING (lang, cell) QUALIFY row_number() OVER (PARTITION BY lang, cell ORDER BY {_hash(4)}, doc_id) <= want""")
def ps3_gap_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for cells of language and length that every twentieth document leaves short of six."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.least(F.floor(F.col("n_words") / 200), F.lit(4)).alias("cell"))
    seats = d.select("lang", "cell").distinct().withColumn("seats", F.lit(6))
    return strata.gap_draw(d, seats, d.where("doc_id % 20 = 0"), ["lang", "cell"], "doc_id", "source", 8, 4).select("doc_id", "lang", "cell")


def _scan_sql(seed: int) -> str:
    """The rows of ``o`` (doc_id, keys a and b from 1, their seats la and lb) taken one by one: counts of both keys go along."""
    return f"""line AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_hash(seed)}, doc_id) AS p FROM o),
z AS (SELECT 0::BIGINT AS p, list_transform(range(64), lambda i: 0::BIGINT) AS x, list_transform(range(64), lambda i: 0::BIGINT) AS y, NULL::BIGINT AS doc_id
  UNION ALL SELECT line.p, CASE WHEN x[a] < la AND y[b] < lb THEN list_transform(x, lambda v, j: v + (j = a)::BIGINT) ELSE x END,
    CASE WHEN x[a] < la AND y[b] < lb THEN list_transform(y, lambda v, j: v + (j = b)::BIGINT) ELSE y END, CASE WHEN x[a] < la AND y[b] < lb THEN line.doc_id END FROM z JOIN line ON line.p = z.p + 1)"""


@query("w5_scanned_draw", f"""
WITH RECURSIVE {_CELLS}, o AS (SELECT doc_id, source, stratum, dense_rank() OVER (ORDER BY source) AS a, dense_rank() OVER (ORDER BY stratum) AS b, 20 AS la, 40 AS lb FROM c), {_scan_sql(5)}
SELECT doc_id, source, stratum FROM z JOIN o USING (doc_id)""")
def w5_scanned_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents of each stratum and at most 20 of a source, as one scan by seeded hash takes them."""
    return scans.greedy_scan(_cells(spark, sf_dir), "doc_id", [(["source"], 20, None), (["stratum"], 40, None)], 5)


@query("ps3_scanned_draw", f"""
WITH RECURSIVE d AS (SELECT *, least(n_words // 200, 4) AS cell FROM ({_D})), h AS (SELECT * FROM d WHERE doc_id % 20 = 0), u AS (SELECT source, count(*) AS used FROM h GROUP BY source),
w AS (SELECT t.lang, t.cell, ceil(greatest(0, 6 - count(h.doc_id)) * 1.06::DOUBLE) AS want FROM (SELECT DISTINCT lang, cell FROM d) t LEFT JOIN h ON h.lang = t.lang AND h.cell = t.cell GROUP BY t.lang, t.cell),
o AS (SELECT d.doc_id, d.source, lang, cell, dense_rank() OVER (ORDER BY d.source) AS a, dense_rank() OVER (ORDER BY lang, cell) AS b, 8 - coalesce(used, 0) AS la, want AS lb FROM d JOIN w USING (lang, cell) LEFT JOIN u ON u.source = d.source WHERE doc_id % 20 <> 0), {_scan_sql(4)}
SELECT doc_id, lang, cell FROM z JOIN o USING (doc_id)""")
def ps3_scanned_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ps3_gap_draw``'s cells and caps in one scan: a source's seats go to documents that their cell still needs."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.least(F.floor(F.col("n_words") / 200), F.lit(4)).alias("cell"))
    seats = d.select("lang", "cell").distinct().withColumn("seats", F.lit(6))
    return scans.gap_scan(d, seats, d.where("doc_id % 20 = 0"), ["lang", "cell"], "doc_id", "source", 8, 4).select("doc_id", "lang", "cell")


_PLACED = f"""d AS (SELECT doc_id, source, lang, least(n_words // 150, 3) AS r, doc_id % 3 AS c, doc_id % 4 = 0 AS reused FROM ({_D})),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, r, c ORDER BY reused DESC, {_hash(5)}, doc_id) AS place FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY reused DESC, {_hash(5)}, doc_id) <= 12)),
t AS (SELECT lang, r, c FROM (SELECT DISTINCT lang FROM d), range(4) a(r), range(3) b(c)), n AS (SELECT t.lang, t.r, t.c, count(k.doc_id) AS n FROM t LEFT JOIN k ON k.lang = t.lang AND k.r = t.r AND k.c = t.c GROUP BY ALL),
i AS (SELECT *, 4 - n AS short, least(4, n) AS own, row_number() OVER (PARTITION BY lang ORDER BY r, c) AS x FROM n),
p AS (SELECT a.lang, a.x AS "to", b.x AS "of", b.own - b.short AS whole, row_number() OVER (PARTITION BY a.lang ORDER BY a.x, 2 * abs(a.r - b.r) + abs(a.c - b.c), b.x) AS p FROM i a JOIN i b ON a.lang = b.lang AND a.short > 0 AND b.short < 0),
z AS (SELECT lang, 0::BIGINT AS p, list(short ORDER BY x) AS lft, NULL::BIGINT AS o, NULL::BIGINT AS t, NULL::BIGINT AS after, 0::BIGINT AS n FROM i GROUP BY lang
  UNION ALL SELECT z.lang, p.p, list_transform(z.lft, lambda v, j: CASE WHEN j = p."of" THEN v + greatest(0, least(-z.lft[p."of"], z.lft[p."to"])) WHEN j = p."to" THEN v - greatest(0, least(-z.lft[p."of"], z.lft[p."to"])) ELSE v END),
    p."of", p."to", p.whole + z.lft[p."of"], greatest(0, least(-z.lft[p."of"], z.lft[p."to"])) FROM z JOIN p ON p.lang = z.lang AND p.p = z.p + 1),
m AS (SELECT z.lang, a.r, a.c, b.r AS to_row, b.c AS to_column, z.after, z.n FROM z JOIN i a ON a.lang = z.lang AND a.x = z.o JOIN i b ON b.lang = z.lang AND b.x = z.t WHERE z.n > 0)"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A pool in cells of length and id by language, and four seats for each of a language's twelve cells."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.least(F.floor(F.col("n_words") / 150), F.lit(3)).cast("long").alias("r"), (F.col("doc_id") % 3).alias("c"), (F.col("doc_id") % 4 == 0).alias("reused"))
    seats = d.select("lang").distinct().withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("seats", F.lit(4))
    return d, seats


@query("ps4_selection", f"""WITH RECURSIVE {_PLACED} SELECT doc_id, NULL AS fills FROM k WHERE place <= 4
UNION ALL SELECT doc_id, to_row::VARCHAR || ',' || to_column::VARCHAR FROM k JOIN m USING (lang, r, c) WHERE place > after AND place <= after + n""")
def ps4_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for every cell, reused ones first, with fills from near cells where one is short."""
    d, seats = _pool(spark, sf_dir)
    return strata.select_cells(d, seats, "lang", "r", "c", "doc_id", "reused", "source", 12, 5).select("doc_id", "fills")


@query("ps4_scanned_selection")
def ps4_scanned_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ps4_selection``'s cells in two scans, the source's cap kept over both; tests hold the operator against a plain scan."""
    d, seats = _pool(spark, sf_dir)
    got = scans.filled_scan(d, seats, "lang", "r", "c", "doc_id", "reused", "source", 12, 5)
    return got.select("doc_id", F.when(F.col("to_row").isNotNull(), F.concat_ws(",", F.col("to_row").cast("string"), F.col("to_column").cast("string"))).alias("fills"))


@query("w11_near_fills", f"WITH RECURSIVE {_PLACED} SELECT lang, r, c, to_row, to_column, after, n FROM m")
def w11_near_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell gives to which short one, nearest first."""
    d, seats = _pool(spark, sf_dir)
    order = [F.desc(F.col("reused").cast("int")), ranks.seeded_hash(5, "doc_id"), F.col("doc_id")]
    capped = d.withColumn("own", F.row_number().over(strata.Window.partitionBy("source").orderBy(*order))).where("own <= 12")
    n = capped.groupBy("lang", "r", "c").agg(F.count("*").alias("n"))
    return strata.near_fills(seats.join(n, ["lang", "r", "c"], "left").fillna({"n": 0}), "lang", "r", "c", "seats", "n")


@query("ps5_ceilings", f"WITH d AS ({_D}), b AS (SELECT lang, max(n_words + 7) AS frame_tokens, arg_min(doc_id, (-n_words, doc_id)) AS frame_question FROM d GROUP BY lang) SELECT lang, frame_tokens, frame_question, 16384 - 2 - 700 - frame_tokens AS ceiling FROM b")
def ps5_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room for a document under the longest prompt frame; a document stands for a question, words for tokens."""
    return strata.prompt_ceiling(_docs(spark, sf_dir), ["lang"], "doc_id", F.col("n_words") + 7, 16_384, 700)


@query("ps6_floored_draw", """
WITH g AS (SELECT doc_id // 4 AS grp, min(lang) AS lang, count(*) FILTER (n_chars % 10 = 0) AS pos, max(n_chars) > 4000 AS lng FROM documents GROUP BY 1),
t AS (SELECT draw, grp, lang, pos, lng FROM g, range(25) d(draw) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY sha1('21|' || draw::VARCHAR || '|' || grp::VARCHAR), grp) <= 12),
m AS (SELECT draw, greatest(0, 8 - sum(pos)) + greatest(0, 5 - count(*) FILTER (lng)) AS missing FROM t GROUP BY draw), w AS (SELECT lang, count(*) / (SELECT count(*) FROM g)::DOUBLE AS share FROM g GROUP BY lang),
k AS (SELECT draw, lang, count(*) AS k FROM t GROUP BY ALL), gp AS (SELECT draw, round(sum(abs(coalesce(k, 0) / 12::DOUBLE - share)), 9) AS gap FROM (SELECT draw, lang, share FROM w, range(25) d(draw)) LEFT JOIN k USING (draw, lang) GROUP BY draw),
b AS (SELECT draw FROM gp JOIN m USING (draw) ORDER BY missing, gap, draw LIMIT 1)
SELECT grp, lang FROM t JOIN b USING (draw)""")
def ps6_floored_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve groups of four documents, the best of 25 draws with enough positives and long documents."""
    g = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 4).alias("grp")).agg(F.min("lang").alias("lang"), F.count_if(F.col("n_chars") % 10 == 0).alias("pos"), (F.max("n_chars") > 4000).alias("lng"))
    return selection.floored_draw(g, "grp", "lang", "pos", "lng", 12, 25, 21, 8, 5)


@query("t6_local_search")
def t6_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve groups of four documents from which no swap comes nearer to languages and lengths, or to the floors of sources."""
    length = F.concat(F.lit("length "), F.least(F.floor(F.col("n_chars") / 1000), F.lit(3)))
    g = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 4).alias("grp")).agg(F.array(F.min("lang"), F.min(length)).alias("cells"), F.collect_set("source").alias("sources"))
    return search.local_search(g, "grp", "cells", "sources", 12, 2, 21)


@query("ps7_split", f"""
WITH RECURSIVE {_GROUPS}, el AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_hash(6)}, doc_id) <= 5), bn AS (SELECT DISTINCT root FROM gr JOIN el USING (doc_id))
SELECT doc_id, root, CASE WHEN root IN (SELECT root FROM bn) THEN 'benchmark' WHEN ('0x' || substr({_hash(6, 'root')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'val' ELSE 'train' END AS side FROM gr""")
def ps7_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of documents: whole groups, five labelled documents of each language on the benchmark, a tenth of the rest val."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    eligible = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return strata.build_split(_groups(spark, sf_dir), "doc_id", "root", eligible, "lang", 5, 0.1, 6)


_ORDER = ["src0", "src1", "src2", "src3"]


def _lineages_sql() -> str:
    parts = ["q AS (SELECT DISTINCT 'l' || (doc_id % 23)::VARCHAR AS lineage, source FROM documents)", "h0 AS (SELECT '' AS lineage WHERE false)"]
    for k, name in enumerate(_ORDER):
        more = f"SELECT lineage, row_number() OVER (ORDER BY {_hash(9, 'lineage')}, lineage) AS p FROM q WHERE source = '{name}' AND lineage NOT IN (SELECT lineage FROM h{k})"
        rest = f"(SELECT floor(0.3::DOUBLE * count(*) + 0.5) FROM q WHERE source = '{name}') - (SELECT count(*) FROM q JOIN h{k} USING (lineage) WHERE source = '{name}')"
        parts.append(f"h{k + 1} AS (SELECT lineage FROM h{k} UNION ALL SELECT lineage FROM ({more}) WHERE p <= {rest})")
    return f"WITH {', '.join(parts)} SELECT lineage FROM h{len(_ORDER)}"


@query("ps10_held_out", _lineages_sql())
def ps10_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question lineages held out so that four sources each lose nearly a third; lineages are derived from ids."""
    q = table(spark, sf_dir, "documents").select(F.concat(F.lit("l"), F.col("doc_id") % 23).alias("lineage"), "source")
    return strata.held_out_lineages(q, "lineage", "source", _ORDER, 0.3, 9)


@query("ps11_top_up", f"""
WITH u AS (SELECT source, count(*) AS used FROM documents WHERE doc_id % 10 = 0 GROUP BY source),
f AS (SELECT * FROM (SELECT d.doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY {_hash(2)}, doc_id) AS own, coalesce(used, 0) AS used FROM documents d LEFT JOIN u USING (source) WHERE doc_id % 10 <> 0) WHERE own + used <= 9)
SELECT doc_id, lang, source, 2 AS seed FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_hash(2)}, doc_id) <= 7""")
def ps11_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven further documents of each language for a pool of every tenth, from a new seed; a source has nine at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(1).alias("seed"))
    quotas = d.select("lang").distinct().withColumn("quota", F.lit(7))
    return strata.top_up(d.where("doc_id % 10 = 0"), d, "doc_id", "lang", "source", "seed", quotas, 9, 2)


@query("ps12_bank", f"WITH {PAIRS_SQL} SELECT question, question = 'q5' AS held_out, 3 AS options, string_agg(DISTINCT lang, ',' ORDER BY lang) AS allowed, count(*) AS records FROM scored GROUP BY question")
def ps12_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank of questions as a table: options, where each is asked, and whether it is held out."""
    p = pairs(spark, sf_dir).groupBy("question").agg(F.first("options").alias("o"), F.array_sort(F.collect_set("lang")).alias("l"), F.count("*").alias("records"))
    return p.select("question", (F.col("question") == "q5").alias("held_out"), F.size("o").alias("options"), F.array_join("l", ",").alias("allowed"), "records")


@query("p5_token_counts", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')) AS tokens FROM documents")
def p5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the plain counter; any other is passed as a function."""
    return table(spark, sf_dir, "documents").select("doc_id", examples.plain_tokens(F.col("text")).alias("tokens"))


_LINES = f"""r AS (SELECT doc_id, lang, list_transform(string_split(text, chr(10)), lambda x: {words_sql('x')} + 1) AS counts, 5 + doc_id % 7 AS target, CASE WHEN doc_id % 2 = 0 THEN ['clean'] WHEN doc_id % 4 = 1 THEN ['messy', 'clean'] ELSE ['clean'] END AS v FROM documents),
w AS (SELECT *, 12 + coalesce(list_sum(counts), 0)::BIGINT AS whole FROM (SELECT * EXCLUDE (v), unnest(v) AS variant FROM r)),
kept AS (SELECT *, CASE WHEN whole + target + 1 <= 300 THEN len(counts) ELSE len(list_filter(range(1, len(counts) + 1), lambda k: list_sum(counts[1:k]) <= 299 - target - 12)) END::INTEGER AS kept FROM w),
ex AS (SELECT doc_id, lang, variant, len(counts)::INTEGER AS n_lines, kept, 12 + coalesce(list_sum(counts[1:kept]), 0)::BIGINT AS n_prompt, target AS n_target, CASE WHEN whole + target + 1 <= 300 THEN 'whole' WHEN kept > 0 THEN 'truncated' ELSE 'dropped' END AS fate FROM kept)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of one or two variants of their lines."""
    lines = F.split("text", "\n")
    messy = F.create_map(F.lit("clean"), lines, F.lit("messy"), F.transform(lines, F.lower))
    d = table(spark, sf_dir, "documents").withColumn("variants", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("clean"), lines)).otherwise(messy))
    return d.withColumn("labelled", F.when(F.col("doc_id") % 4 == 1, "messy").otherwise("clean"))


def _line_tokens(line):
    return X.word_count(line) + 1


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return examples.build_examples(r, "doc_id", "variants", "labelled", ["labelled", "clean"], F.lit(12), 5 + F.col("doc_id") % 7, _line_tokens, 300, "truncate")


@query("m4_examples", f"WITH {_LINES} SELECT doc_id, variant, n_lines, kept, n_prompt, n_target, fate FROM ex")
def m4_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of every document and variant, cut to 300 tokens; words with a line end stand for tokens."""
    return _examples(spark, sf_dir)


@query("m4_stats", f"""WITH {_LINES} SELECT variant, count(*) FILTER (fate <> 'dropped') AS examples, count(*) FILTER (fate = 'dropped') AS dropped, count(*) FILTER (fate = 'truncated') AS truncated,
  coalesce(sum(n_prompt) FILTER (fate <> 'dropped'), 0)::BIGINT AS prompt_tokens, coalesce(sum(n_target) FILTER (fate <> 'dropped'), 0)::BIGINT AS target_tokens, coalesce(max(n_prompt + n_target + 1) FILTER (fate <> 'dropped'), 0) AS max_len FROM ex GROUP BY variant""")
def m4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the built examples by variant."""
    return examples.example_stats(_examples(spark, sf_dir), ["variant"])


@query("m7_over_cap", f"WITH d AS (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['clean'] ELSE ['clean', 'messy'] END) AS variant, 12 + list_sum(list_transform(string_split(text, chr(10)), lambda x: {words_sql('x')} + 1))::BIGINT AS n_prompt FROM documents) SELECT doc_id, variant, n_prompt, n_prompt > 400 AS over_cap FROM d")
def m7_over_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each variant's prompt is over 400 tokens."""
    return examples.over_cap(_records(spark, sf_dir), "doc_id", "variants", F.lit(12), _line_tokens, 400)


@query("m14_longer", f"WITH d AS ({_D}) SELECT doc_id, n_words AS sized, n_words + CASE WHEN doc_id % 20 = 0 THEN 3 ELSE -1 END AS trained FROM d WHERE doc_id % 20 = 0")
def m14_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose training rendering is longer than the sizing one: here every twentieth has three words more."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("n_words").alias("sized"))
    return examples.longer_in_training(d, "doc_id", "sized", F.col("sized") + F.when(F.col("doc_id") % 20 == 0, 3).otherwise(-1))


@query("m6_numbered_documents", r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_split(t, chr(10)) ELSE string_split(regexp_replace(t, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) END AS l FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents))
SELECT doc_id, array_to_string(list_transform(list_filter(l, lambda x: regexp_replace(x, '\s+', '', 'g') <> ''), lambda x, i: i::VARCHAR || ': ' || x), chr(10)) AS body FROM d""")
def m6_numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered lines: their own, or one a sentence (odd ids stand for documents without speakers)."""
    lines = examples.document_lines(F.col("text"), F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.numbered(lines), "\n").alias("body"))


@query("p8_target_counts", f"WITH c AS (SELECT lang, n_chars + 2 AS n, greatest(1, least(n_chars + 1, floor({share_sql(chr(39) + '5|' + chr(39) + ' || doc_id::VARCHAR')} * (n_chars + 2))))::BIGINT AS cut FROM documents) SELECT lang, sum(least(n - cut, 900))::BIGINT AS targets, sum(cut - 1)::BIGINT AS encoder FROM c GROUP BY lang")
def p8_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised and encoder tokens when every document is cut once; characters stand for tokens."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars") + 2)
    return examples.target_counts(splits.cut_points(d, "cut", F.col("n"), 5, "doc_id"), ["lang"], "n", "cut", 900)


@query("t1_ordered_turns", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role")
def t1_ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns in the order of conversation and turn: a range shuffle and sorted partitions."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn", "role")


@query("t2_first_dialogues", "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 10)")
def t2_first_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the first ten conversations."""
    return reviews.first_groups(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", 10)


@query("w6_one_each", f"""
WITH o AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_hash(8)}, doc_id) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_hash(8)}, doc_id) AS turn, count(*) OVER (PARTITION BY lang) AS size FROM o)
SELECT doc_id, lang, turn, row_number() OVER (ORDER BY turn, size DESC, lang) AS place FROM t QUALIFY place <= 12""")
def w6_one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents in turns over languages, one of each source."""
    d = reviews.one_of_each(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source", "doc_id", 8)
    return ranks.round_robin(d.select("doc_id", "lang"), "lang", "doc_id", 12, 8)


@query("w7_interleaved", f"WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY {_hash(7)}, doc_id) - 1 AS number FROM documents) SELECT doc_id, q, number // 4 AS chunk, q AS step, number FROM n, range(3) t(q)")
def w7_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs of every document in the order in which four workers take them: (chunk, step, number)."""
    n = ranks.shuffled_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, "number")
    jobs = n.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return reviews.interleaved(jobs, "doc_id", "q", "number", 4)


@query("w8_turns_sample", f"""
WITH d AS (SELECT doc_id, lang, n_chars > 3000 AS i FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY {_hash(11)}, doc_id) AS turn FROM d),
a AS (SELECT doc_id FROM t WHERE i ORDER BY turn, lang LIMIT 10)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM a), turn, lang, i) AS p FROM t) WHERE p <= 21""")
def w8_turns_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-one documents in turns over languages, half of them long ones first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return reviews.turns_sample(d, "doc_id", ["lang"], F.col("n_chars") > 3000, 21, 11).select("doc_id", "lang")


_SHEETS = f"""c AS (SELECT doc_id, gold, coalesce(answer, '') AS answer FROM scored ORDER BY {_hash(12)}, doc_id LIMIT 15), e AS (SELECT doc_id, unnest(['one', 'two']) AS who, unnest([gold, answer]) AS said FROM c),
o AS (SELECT *, chr((64 + row_number() OVER (PARTITION BY doc_id ORDER BY sha1('12|' || doc_id::VARCHAR || '|' || who)))::INTEGER) AS letter FROM e)"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("doc_id", F.create_map(F.lit("one"), "gold", F.lit("two"), F.coalesce("answer", F.lit(""))).alias("labels"))
    return reviews.review_sheet(p, "doc_id", "labels", 15, 12)


@query("m9_sheets", f"""WITH {PAIRS_SQL}, {_SHEETS} SELECT doc_id, '# pair ' || doc_id::VARCHAR || chr(10) || string_agg(letter || ': {{answer: ' || said || ', correct: , evidence: , summary: }}', chr(10) ORDER BY letter) AS sheet, string_agg(letter || '=' || who, ',' ORDER BY letter) AS key FROM o GROUP BY doc_id""")
def m9_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind review sheets of fifteen pairs of labels, and their keys."""
    return _sheets(spark, sf_dir)


@query("m9_grades", f"WITH {PAIRS_SQL}, {_SHEETS} SELECT doc_id, who AS labeller, letter = 'A' AS correct, CASE WHEN letter = 'A' THEN 2 END AS evidence, NULL::INTEGER AS summary FROM o WHERE letter = 'A' OR doc_id % 2 = 0")
def m9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades read back from sheets: A is right with evidence 2; B is wrong on even ids and not graded on odd ones."""
    filled = F.regexp_replace("sheet", r"(?m)^(A: .*)correct: , evidence: ,", "$1correct: Y, evidence: 2,")
    filled = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(filled, r"(?m)^(B: .*)correct: ,", "$1correct: n,")).otherwise(filled)
    return reviews.read_review(_sheets(spark, sf_dir).withColumn("sheet", filled), "doc_id", "sheet", "key")


@query("m11_batches", f"WITH s AS (SELECT DISTINCT source FROM documents) SELECT source, (row_number() OVER (ORDER BY {_hash(13, 'source')}, source) - 1) // 6 AS batch FROM s")
def m11_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in seeded batches of six."""
    n = ranks.shuffled_number(table(spark, sf_dir, "documents").select("source").distinct(), "source", 13, "n")
    return n.select("source", F.floor(F.col("n") / 6).alias("batch"))


@query("m15_stratum_summary", f"""
WITH d AS ({_D}), a AS (SELECT lang, {ranks_sql('n_words')} FROM d GROUP BY lang), b AS (UNPIVOT (SELECT lang, n::BIGINT AS n, min::BIGINT AS min, p50::BIGINT AS p50, p90::BIGINT AS p90, p99::BIGINT AS p99, max::BIGINT AS max FROM a) ON n, min, p50, p90, p99, max INTO NAME name VALUE v)
SELECT lang, 'words' AS what, name, v FROM b UNION ALL SELECT lang, 'speakers', (1 + doc_id % 5)::VARCHAR, count(*) FROM d GROUP BY ALL UNION ALL SELECT lang, 'source', source, count(*) FROM d GROUP BY ALL""")
def m15_stratum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of lengths and counts by speakers and source of each language."""
    d = _docs(spark, sf_dir)
    names = ["n", "min", "p50", "p90", "p99", "max"]
    a = ranks.nearest_ranks(d, ["lang"], "n_words").select("lang", F.lit("words").alias("what"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("long") for c in names]))).alias("name", "v"))
    count = lambda what, c: d.groupBy("lang", c.cast("string").alias("name")).agg(F.count("*").alias("v")).select("lang", F.lit(what).alias("what"), "name", "v")
    return a.unionByName(count("speakers", 1 + F.col("doc_id") % 5)).unionByName(count("source", F.col("source")))


@query("m22_report", "SELECT '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n::VARCHAR || ' |', chr(10) ORDER BY lang) || chr(10) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def m22_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as a Markdown table."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(reviews.markdown(n, ["lang"]),)], "report string")


@query("s2_by_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s2_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the documents whose id a set has."""
    return files.read_by_ids(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", ["doc_id", "source"])


@query("s8_side_summary", f"""
WITH {PAIRS_SQL}, r AS (SELECT CASE WHEN source IN ('src1', 'src2') THEN 'benchmark' WHEN {share_sql('source')} < 0.2 THEN 'val' ELSE 'train' END AS side, source, n_lines, gold FROM scored),
d AS (SELECT side, source, min(n_lines) AS n_lines FROM r GROUP BY ALL), ra AS (SELECT side, {ranks_sql('n_lines')} FROM d GROUP BY side), un AS (UNPIVOT (SELECT side, min, p50, p90, p99, max FROM ra) ON min, p50, p90, p99, max INTO NAME name VALUE n)
SELECT side, 'records' AS what, '' AS name, count(*) AS n FROM r GROUP BY side UNION ALL SELECT side, 'docs', '', count(*) FROM d GROUP BY side UNION ALL SELECT side, 'lines', name, n FROM un UNION ALL SELECT side, 'answer', gold, count(*) FROM r GROUP BY ALL""")
def s8_side_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer of three sides reports: records, documents, lines and answers; a source stands for a document."""
    p = pairs(spark, sf_dir)
    side = F.when(F.col("source").isin("src1", "src2"), "benchmark").when(X.is_validation("source", 0.2), "val").otherwise("train")
    return files.side_summary(p.withColumn("side", side), "side", "source", "n_lines", "gold")
