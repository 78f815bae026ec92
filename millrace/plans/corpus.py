"""Queries over documents, events and embeddings: funnels, strata, draws, grouping and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import grouping, moments, podcasts, ranks, splits
from millrace.operators.components import written
from millrace.plans.tables import ranks_sql, share_sql, table, words_sql

_META = f"""SELECT doc_id, source, lang, n_chars, text, {words_sql('text')} AS n_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, 1 + doc_id % 5 AS n_speakers,
  ({words_sql('text')} * (20 + doc_id % 50))::DOUBLE / 60 AS duration FROM documents"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with counts; speakers and duration stand in for metadata that the table lacks."""
    d = table(spark, sf_dir, "documents").withColumn("n_words", X.word_count("text"))
    return d.withColumns({
        "n_lines": F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, "n_speakers": 1 + F.col("doc_id") % 5,
        "duration": (F.col("n_words") * (20 + F.col("doc_id") % 50)).cast("double") / 60,
    })


@query("f3_funnel", f"""
WITH m AS ({_META}), r AS (SELECT source, CASE WHEN n_speakers NOT IN (2, 3, 4) THEN 'speakers' WHEN n_lines < 3 THEN 'turns'
  WHEN source IN ('src3', 'src4') THEN 'used before' WHEN coalesce(duration, 0) <= 0 THEN 'partial' WHEN n_words / (duration / 60) < 90 THEN 'partial'
  WHEN n_words * 1.3 >= 16000 THEN 'length' END AS reason FROM m)
SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def f3_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each step of the eligibility funnel drops, in order."""
    steps = [
        ("speakers", ~F.col("n_speakers").isin(2, 3, 4)), ("turns", F.col("n_lines") < 3), ("used before", F.col("source").isin("src3", "src4")),
        ("partial", F.coalesce("duration", F.lit(0.0)) <= 0), ("partial", F.col("n_words") / (F.col("duration") / 60) < 90), ("length", F.col("n_words") * F.lit(1.3) >= 16000),
    ]
    return podcasts.funnel(_meta(spark, sf_dir), steps).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("f2_min_words", f"""
SELECT source, count(*) AS docs, count(*) FILTER (n < 50) AS under_50, count(*) FILTER (n < 500) AS under_500 FROM (SELECT source, {words_sql('text')} AS n FROM documents) GROUP BY source""")
def f2_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that the two word limits drop."""
    d = table(spark, sf_dir, "documents").withColumn("n", X.word_count("text"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("n") < 50).alias("under_50"), F.count_if(F.col("n") < 500).alias("under_500"))


@query("a4_lengths_by_source", f"SELECT source, {ranks_sql('n_chars')} FROM documents GROUP BY source")
def a4_lengths_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank distribution of lengths by source."""
    return ranks.nearest_ranks(table(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("a5_rebuilt_meetings", """
WITH i AS (SELECT source || '_' || lang || '_' || doc_id AS uid, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ' ' || doc_id::VARCHAR END AS s FROM documents),
n AS (SELECT *, split_part(uid, '_', 1) || '_' || split_part(uid, '_', 2) AS meeting FROM i), k AS (SELECT *, (row_number() OVER (PARTITION BY meeting ORDER BY doc_id) - 1) // 64 AS part FROM n)
SELECT meeting, part, count(*) AS n_items, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY doc_id) FILTER (t <> ''), '') AS text,
  coalesce(string_agg(s, ' ||| ' ORDER BY doc_id) FILTER (s <> ''), '') AS summary FROM k GROUP BY meeting, part""")
def a5_rebuilt_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings from items that share the first two parts of a uid; a source and language stand for a meeting.

    A meeting comes in parts of 64 items. Summaries, which the table lacks, are derived from ids.
    """
    i = table(spark, sf_dir, "documents").select(
        F.concat_ws("_", "source", "lang", "doc_id").alias("uid"), "doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("t"),
        F.when(F.col("doc_id") % 3 != 0, F.concat_ws(" ", "source", "doc_id")).alias("s"),
    )
    return podcasts.rebuild_meetings(i, "uid", "doc_id", "t", "s")


@query("a6_first_copies", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1""")
def a6_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text by source and id, found by aggregation so that hot texts need no window."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("source", "doc_id")).alias("r")).select("r.doc_id", "r.source")


@query("a7_placeholders", r"""
SELECT lang, sum(len(regexp_extract_all(replace(text, 'The', '[THE_' || upper(lang) || ']'), '\[[A-Z_]+\]')))::BIGINT AS n FROM documents GROUP BY lang""")
def a7_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders by language; a word is made one, as the table has none."""
    marked = F.replace(F.col("text"), F.lit("The"), F.concat(F.lit("[THE_"), F.upper("lang"), F.lit("]")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.placeholders(marked)).alias("n"))


@query("x7_normal_forms", r"""
WITH t AS (SELECT doc_id, lower(left(text, 40)) || CASE WHEN doc_id % 2 = 0 THEN ' (live) ' ELSE ' Podcast' END AS raw FROM documents),
c AS (SELECT doc_id, lower(raw) AS low, regexp_replace(lower(raw), '\s*[(\[][^()\[\]]*[)\]]\s*$', '') AS cut FROM t),
p AS (SELECT doc_id, low, trim(regexp_replace(CASE WHEN cut = '' THEN low ELSE cut END, '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM c),
k AS (SELECT *, trim(regexp_replace(regexp_replace(plain, '(\s+the)?\s+podcast$', ''), '^the\s+', '')) AS core FROM p)
SELECT doc_id, CASE WHEN core = '' THEN plain ELSE core END AS show, trim(regexp_replace(low, '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM k""")
def x7_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of titles and show names; the start of a text stands for a title."""
    raw = F.concat(F.lower(F.left("text", F.lit(40))), F.when(F.col("doc_id") % 2 == 0, " (live) ").otherwise(" Podcast"))
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_show(raw).alias("show"), X.normal_title(raw).alias("title"))


_STRATA = "CASE WHEN tokens < 4000 THEN '0-4k' WHEN tokens < 8000 THEN '4-8k' WHEN tokens < 12000 THEN '8-12k' WHEN tokens < 16000 THEN '12-16k' END"
_CELLS = f"""t AS (SELECT doc_id, source, {words_sql('text')} * 13 // 2 AS tokens, n_chars FROM documents), s AS (SELECT *, {_STRATA} AS stratum, n_chars::DOUBLE / greatest(tokens, 1) AS ratio FROM t),
q AS (SELECT stratum, list_transform([1, 2, 3, 4], lambda i: list_sort(list(ratio))[floor(count(*) * i / 5)::BIGINT + 1]) AS cuts FROM s WHERE stratum IS NOT NULL GROUP BY stratum),
c AS (SELECT s.*, len(list_filter(cuts, lambda x: x <= ratio)) AS bin FROM s JOIN q USING (stratum))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").withColumn("tokens", F.floor(X.word_count("text") * 13 / 2))
    s = t.withColumn("stratum", X.stratum("tokens")).withColumn("ratio", F.col("n_chars").cast("double") / F.greatest("tokens", F.lit(1))).where("stratum IS NOT NULL")
    return s.join(ranks.quantile_cuts(s, ["stratum"], "ratio", 5), "stratum").withColumn("bin", ranks.bin_right(F.col("ratio"), F.col("cuts")))


@query("w10_strata_cells", f"WITH {_CELLS} SELECT stratum, bin, count(*) AS n FROM c GROUP BY stratum, bin")
def w10_strata_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each stratum by quintile of characters for a token."""
    return _cells(spark, sf_dir).groupBy("stratum", "bin").agg(F.count("*").alias("n"))


@query("w9_allocation", f"""
WITH {_CELLS}, n AS (SELECT stratum, bin, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, 57 * n / (sum(n) OVER (PARTITION BY stratum))::DOUBLE AS raw FROM n),
f AS (SELECT *, floor(raw)::BIGINT AS s, row_number() OVER (PARTITION BY stratum ORDER BY raw - floor(raw) DESC, bin) AS k FROM r)
SELECT stratum, bin, n, (s + (k <= 57 - sum(s) OVER (PARTITION BY stratum))::INT)::BIGINT AS seats FROM f""")
def w9_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """57 seats of each stratum over its cells by largest remainder."""
    cells = _cells(spark, sf_dir).groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    return ranks.allocate(cells, 57, ["stratum"], "bin", "n")


@query("w5_capped_draw", f"""
WITH {_CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('5|' || source || '|' || doc_id), doc_id) AS a FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1('5|' || stratum || '|' || doc_id), doc_id) AS b FROM k WHERE a <= 20)
SELECT doc_id, source, stratum FROM d WHERE b <= 40""")
def w5_capped_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents of each stratum by seeded hash, after at most 20 of each source."""
    few = ranks.capped(_cells(spark, sf_dir), "source", "doc_id", 20, 5)
    return ranks.choose_per_key(few, "stratum", "doc_id", 40, 5).select("doc_id", "source", "stratum")


@query("w6_round_robin", """
WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('9|' || doc_id), doc_id) AS turn FROM documents)
SELECT doc_id, source, turn::INTEGER AS turn, (row_number() OVER (ORDER BY turn, size DESC, source))::INTEGER AS place FROM t JOIN s USING (source) QUALIFY place <= 70""")
def w6_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 documents, one source after the other."""
    return ranks.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 70, 9).select("doc_id", "source", "turn", "place")


@query("m10_chunks", "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7 AS chunk FROM documents")
def m10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in chunks of seven."""
    return ranks.chunks(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7)


@query("t4_seeded_order", "SELECT doc_id, row_number() OVER (ORDER BY sha1('2|' || doc_id), doc_id) - 1 AS place FROM documents")
def t4_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a seeded shuffle, numbered without one global sort."""
    return ranks.shuffled_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 2, "place")


@query("w12_batch_plan")
def w12_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of documents by words; tests hold it against a plain plan."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.word_count("text").cast("long").alias("n"))
    return ranks.batch_plan(d, "doc_id", "n", 16, 2, 2048, 1)


@query("u1_repeated_union", """
SELECT source, count(*) AS n FROM (SELECT source, unnest(range(CASE WHEN lang = 'en' THEN 1 ELSE 3 END)) FROM documents) GROUP BY source""")
def u1_repeated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source after a union that repeats other languages three times."""
    d = table(spark, sf_dir, "documents")
    en, rest = d.where("lang = 'en'"), d.where("lang <> 'en'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("k")
    return en.unionByName(rest).groupBy("source").agg(F.count("*").alias("n"))


@query("u4_set_differences", """
WITH l AS (SELECT doc_id FROM labels), e AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM l INTERSECT SELECT * FROM e) UNION ALL SELECT 'labels only', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM e)
UNION ALL SELECT 'english only', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM l)""")
def u4_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and English documents: in both, and in one only."""
    a, b = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    named = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "labels only")).unionByName(named(b.subtract(a), "english only"))


@query("ps9_hash_sample", f"SELECT doc_id FROM documents WHERE {share_sql(chr(39) + '4|' + chr(39) + ' || doc_id')} < 0.1")
def ps9_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents by seeded hash."""
    return splits.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 4)


_PASSAGES = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 8),
p AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM g) WHERE h % 8 = 0)"""
_PAIRS = """f AS (SELECT h FROM p GROUP BY h HAVING count(*) BETWEEN 2 AND 50), z AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM p a JOIN f USING (h) JOIN p b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
o AS (SELECT a, b, shared, shared / least(za.n, zb.n)::DOUBLE AS share FROM x JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE shared / least(za.n, zb.n)::DOUBLE >= 0.25)"""


def _md5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, h): a fixed eighth of the 8-word passages by MD5, which DuckDB has too."""
    digits = F.transform(X.shingles("text"), lambda s: F.substring(F.md5(s.cast("binary")), 1, 8))
    kept = F.array_distinct(F.filter(digits, lambda m: F.substring(m, 8, 1).isin("0", "8")))  # those divisible by eight
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(kept).alias("m"))
    return m.select("doc_id", F.conv("m", 16, 10).cast("long").alias("h")).distinct()


@query("j10_overlap_pairs", f"WITH {_PASSAGES}, {_PAIRS} SELECT a, b, shared, round(share, 9) AS share FROM o")
def j10_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a quarter of the smaller one's sampled passages."""
    return grouping.overlap_pairs(_md5_passages(spark, sf_dir), "doc_id", "h").withColumn("share", F.round("share", 9))


@query("x14_passage_counts")
def x14_passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many CRC-32 passages each document keeps; tests hold the hashes against zlib."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.passages("text")).alias("n"))


_TITLES = "t AS (SELECT doc_id, trim(regexp_replace(lower(left(text, 30)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k, n_chars::DOUBLE AS x FROM documents)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("x", F.col("n_chars").cast("double"))
    overlap = grouping.overlap_pairs(_md5_passages(spark, sf_dir), "doc_id", "h").select(F.col("b").alias("u"), F.col("a").alias("v"))
    return grouping.groups(d, "doc_id", grouping.band_links(d, "doc_id", X.normal_title(F.left("text", F.lit(30))), "x"), overlap)


_GROUPS = f"""{_PASSAGES}, {_PAIRS}, {_TITLES}, e AS (SELECT a AS u, b AS v FROM o UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b USING (k) WHERE a.doc_id <> b.doc_id AND abs(a.x - b.x) <= 2),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, s.v FROM r JOIN s ON s.u = r.v), gr AS (SELECT u AS doc_id, min(v) AS root FROM r GROUP BY u)"""


@query("j9_groups", f"WITH RECURSIVE {_GROUPS} SELECT doc_id, root FROM gr")
def j9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by near lengths under one title, and by shared passages."""
    return _groups(spark, sf_dir)


@query("j13_untainted", f"""
WITH RECURSIVE {_GROUPS}, bad AS (SELECT DISTINCT root FROM gr WHERE doc_id % 10 = 0), one AS (SELECT root FROM gr GROUP BY root HAVING count(*) = 1)
SELECT doc_id FROM gr WHERE root IN (FROM one) AND root NOT IN (FROM bad) AND doc_id IN (SELECT doc_id FROM labels)""")
def j13_untainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, alone in their group, whose group has no document that an earlier use (ids ending in zero) taints."""
    d = table(spark, sf_dir, "documents")
    return grouping.untainted(_groups(spark, sf_dir), "doc_id", d.where("doc_id % 10 = 0"), table(spark, sf_dir, "labels"))


_LINKS = f"""{_PASSAGES}, {_PAIRS}, {_TITLES}, n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'f' || (doc_id // 40)::VARCHAR END AS feed, CASE WHEN doc_id % 7 = 0 THEN 'The ' || left(source, 4) || ' (' || lang || ') ' || (doc_id // 90)::VARCHAR || ' Podcast' ELSE '' END AS title_,
  CASE WHEN doc_id % 13 = 0 THEN ['Ann Lee ' || chr((97 + doc_id // 100 % 26)::INTEGER), 'Solo'] ELSE [] END AS hosts, CASE WHEN doc_id % 17 = 0 THEN ['studio ' || (doc_id // 130)::VARCHAR] ELSE [] END AS owners FROM documents),
ky AS (SELECT doc_id, 'feed|' || feed AS k FROM n WHERE feed IS NOT NULL UNION ALL SELECT doc_id, 'show|' || trim(regexp_replace(lower(title_), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) FROM n WHERE title_ <> ''
  UNION ALL SELECT doc_id, 'host|' || lower(unnest(list_filter(hosts, lambda h: contains(h, ' ')))) FROM n UNION ALL SELECT doc_id, 'owner|' || unnest(owners) FROM n),
ps AS (SELECT doc_id, list_sort(list(h)) AS hs FROM p GROUP BY doc_id),
e AS (SELECT a AS u, b AS v FROM o UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b USING (k) WHERE a.doc_id <> b.doc_id AND abs(a.x - b.x) <= 2 UNION SELECT a.doc_id, b.doc_id FROM ky a JOIN ky b USING (k) WHERE a.doc_id <> b.doc_id
  UNION SELECT a.doc_id, b.doc_id FROM ps a JOIN ps b USING (hs) WHERE a.doc_id <> b.doc_id),
sl AS (SELECT u, v FROM e UNION SELECT v, u FROM e), rl(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT rl.u, sl.v FROM rl JOIN sl ON sl.u = rl.v)"""


@query("j9_six_links", f"WITH RECURSIVE {_LINKS} SELECT u AS doc_id, min(v) AS root FROM rl GROUP BY u")
def j9_six_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by feed, show, title and near length, host, owner and shared passages.

    Feeds, shows, hosts and owners are derived from ids. Documents with one set of passages are linked whatever their number.
    """
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("x", F.col("n_chars").cast("double"))
    feed = F.when(i % 10 == 0, F.concat(F.lit("f"), F.floor(i / 40)))
    show = F.when(i % 7 == 0, F.concat(F.lit("The "), F.left("source", F.lit(4)), F.lit(" ("), "lang", F.lit(") "), F.floor(i / 90), F.lit(" Podcast")))
    none = F.array().cast("array<string>")
    hosts = F.when(i % 13 == 0, F.array(F.concat(F.lit("Ann Lee "), F.char(97 + F.floor(i / 100) % 26)), F.lit("Solo"))).otherwise(none)
    owners = F.when(i % 17 == 0, F.array(F.concat(F.lit("studio "), F.floor(i / 130)))).otherwise(none)
    passages = written(_md5_passages(spark, sf_dir), "md5-passages")[0]  # two kinds of links read it
    overlap = grouping.overlap_pairs(passages, "doc_id", "h").select(F.col("b").alias("u"), F.col("a").alias("v"))
    named = lambda kind, c: F.concat(F.lit(kind), F.nullif(c, F.lit("")))
    return grouping.groups(
        d, "doc_id", grouping.key_links(d, "doc_id", named("feed|", feed)), grouping.key_links(d, "doc_id", named("show|", X.normal_title(show))),
        grouping.band_links(d, "doc_id", X.normal_title(F.left("text", F.lit(30))), "x"), grouping.set_links(d, "doc_id", F.transform(hosts, X.normal_name)), grouping.set_links(d, "doc_id", owners),
        overlap, grouping.copy_links(passages, "doc_id", "h"),
    )


@query("m17_token_windows", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(range(0, len(w) - 100, 200)) AS windows FROM w""")
def m17_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of 200 words a document has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(splits.token_windows(X.words("text"), 200)).cast("long").alias("windows"))


@query("m18_label_rows", """
WITH c AS (SELECT code, code IN (7, 8) AS held_out FROM range(10) t(code)), d AS (SELECT doc_id, [doc_id % 10, doc_id % 7] AS labels, doc_id % 5 = 0 AS bench FROM documents)
SELECT doc_id, code, held_out, list_contains(labels, code) AS positive FROM d, c WHERE bench OR NOT held_out""")
def m18_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten yes/no rows for each document, two codes only on the benchmark; label sets are derived from ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("doc_id") % 10, F.col("doc_id") % 7).alias("labels"), (F.col("doc_id") % 5 == 0).alias("bench"))
    codes = spark.range(10).select(F.col("id").alias("code"), F.col("id").isin(7, 8).alias("held_out"))
    return podcasts.label_rows(d, "labels", codes, "code", "held_out", F.col("bench")).select("doc_id", "code", "held_out", "positive")


@query("a23_moments", """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT i::INTEGER AS i, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM e GROUP BY i""")
def a23_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and sums of squares of every component of the embeddings."""
    return moments.component_sums(table(spark, sf_dir, "embeddings"), "embedding")


@query("a23_ridge")
def a23_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge weights of the label on the embedding from summed moments; tests hold them against a direct solution."""
    return moments.ridge(table(spark, sf_dir, "embeddings"), "embedding", F.col("label").cast("double"), 1e-3)


@query("b_event_json", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY event_type""")
def b_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, users and well-formed properties by type."""
    valid = F.try_parse_json("props").isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(valid).alias("valid"))
