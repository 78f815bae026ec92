"""Queries of the column functions over texts, of labels, and of readers and writers in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as X
from millrace.operators import examples, labels, ranks, splits, turns
from millrace.operators.components import scratch
from millrace.plans.scores import PAIRS_SQL, pairs
from millrace.plans.tables import table, words_sql
from millrace.sources import files, frozen, packing


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("x2_seeds", "SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR || '|' || lang), 1, 8))::BIGINT AS seed FROM documents")
def x2_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable seed of each document and its language."""
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_seed("doc_id", "lang").alias("seed"))


@query("x8_alignment_words", r"""
SELECT conv_id, turn, role, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(lower('(Um) ' || text || ' wor~ "end".'), '\((\w+)\)', '\1', 'g'), '\s+'), lambda w: regexp_replace(regexp_replace(w, '~+$', ''), '^[^\p{L}\p{N}_'']+|[^\p{L}\p{N}_'']+$', '', 'g')), lambda w: w <> ''), ' ') AS words FROM conversations""")
def x8_alignment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's words as the aligner compares them, with a hesitation, a cut word and quotes added."""
    text = F.concat(F.lit("(Um) "), "text", F.lit(' wor~ "end".'))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", F.array_join(X.alignment_words(text), " ").alias("words"))


@query("x9_single_spaces", r"SELECT conv_id, turn, role, trim(regexp_replace('  ' || replace(text, ' ', chr(9) || ' ') || chr(10), '\s+', ' ', 'g')) AS text FROM conversations")
def x9_single_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with doubled white space made single again."""
    text = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("\t ")), F.lit("\n"))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", X.collapse_space(text).alias("text"))


@query("x10_unmarked", r"SELECT conv_id, turn, role, regexp_replace(CASE WHEN turn % 2 = 0 THEN '>> >>' || text ELSE text || ' >> on' END, '^(>>\s*)+', '') AS text FROM conversations")
def x10_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without the marks of a new speaker that even ones have in front."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(">> >>"), "text")).otherwise(F.concat("text", F.lit(" >> on")))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", X.without_change_marks(text).alias("text"))


_ASCII = "lower(regexp_replace('i ' || text, '[^ -~]', '', 'g'))"


@query("x12_surface", rf"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(trim({_ASCII}), '\bi\b', 'I', 'g') AS t FROM conversations)
SELECT conv_id, turn, role, upper(t[1]) || t[2:] || CASE WHEN t = '' OR t[-1] IN ('.', '?', '!') THEN '' ELSE '.' END AS text FROM t""")
def x12_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII turns in lower case with their surface restored."""
    text = F.lower(F.regexp_replace(F.concat(F.lit("i "), "text"), "[^ -~]", ""))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", X.surface(text).alias("text"))


@query("x13_sentences", r"SELECT doc_id, string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS sentences FROM documents")
def x13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", X.sentences("text").alias("sentences"))


@query("x17_strict_labels", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 5 = 4 THEN 'b' END AS answer, CASE WHEN doc_id % 5 = 0 THEN [2, doc_id] END AS evidence,
  CASE WHEN doc_id % 5 = 0 THEN lang END AS summary, CASE WHEN doc_id % 5 = 0 THEN 1.0 WHEN doc_id % 5 = 4 THEN 0.25 END::DOUBLE AS confidence FROM documents""")
def x17_strict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of strict JSON objects: whole, with more text after, a list, cut, and with fields of the wrong kind."""
    i = F.col("doc_id").cast("string")
    whole = F.concat(F.lit(' {"answer": "'), "source", F.lit('", "evidence": [2, '), i, F.lit('], "summary": "'), "lang", F.lit('", "confidence": 3} '))
    forms = F.array(whole, F.concat(whole, F.lit("so")), F.lit('[{"answer": "a"}]'), F.lit('{"answer": "a"'), F.lit('{"answer": "b", "evidence": [true], "summary": 4, "confidence": 0.25}'))
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(forms, (F.col("doc_id") % 5).cast("int")).alias("t"))
    return d.select("doc_id", labels.strict_label("t").alias("l")).select("doc_id", "l.*")


@query("x24_filled", "SELECT doc_id, 'No. ' || doc_id::VARCHAR || ' (' || lang || '), from ' || source || ': ' || lang AS filled FROM documents")
def x24_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled for every document."""
    filled = labels.fill_template("No. {id} ({lang}), from {source}: {lang}", {"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")})
    return table(spark, sf_dir, "documents").select("doc_id", filled.alias("filled"))


@query("x25_targets", """
SELECT conv_id, turn, role, '{"evidence": [1, ' || turn::VARCHAR || '], "answer": ' || to_json(role)::VARCHAR || ', "summary": ' || to_json(text)::VARCHAR || CASE WHEN turn % 2 = 0 THEN ', "tags": ["t", ' || to_json(role)::VARCHAR || ']' ELSE '' END || '}' AS target FROM conversations""")
def x25_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of every turn; even ones have tags."""
    tags = F.when(F.col("turn") % 2 == 0, F.array(F.lit("t"), F.col("role")))
    return _said(spark, sf_dir).select("conv_id", "turn", "role", labels.target_text(F.array(F.lit(1).cast("long"), F.col("turn")), F.col("role"), F.col("text"), tags).alias("target"))


_TEMPLATE = "Speakers: {speakers}\n{transcript}\n{question}{context}\n{options}{tags_rule}\n{values}"


@query("x25_prompts", r"""
SELECT conv_id, turn, role, 'Speakers: ' || role || ', other' || chr(10) || '1: ' || role || ': ' || text || chr(10) || '2: end' || chr(10) || 'Is it?' || CASE WHEN turn % 3 = 0 THEN chr(10) || 'Context: c' ELSE '' END || chr(10) || '- yes: it is' || chr(10) || '- no: not'
  || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Tags, from this list only (none may apply): a; b' ELSE '' END || chr(10) || 'yes, no' AS prompt FROM conversations""")
def x25_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's prompt over every turn, with a context for each third and tags for each second."""
    lit = F.lit
    options = F.array(F.struct(lit("yes").alias("value"), lit("it is").alias("criteria")), F.struct(lit("no").alias("value"), lit("not").alias("criteria")))
    tags = F.when(F.col("turn") % 2 == 0, F.array(lit("a"), lit("b"))).otherwise(F.array().cast("array<string>"))
    prompt = labels.task_prompt(_TEMPLATE, F.array(X.render_turn("role", "text"), lit("end")), F.array(F.col("role"), lit("other")), lit("Is it?"), F.when(F.col("turn") % 3 == 0, "c").otherwise(""), options, tags)
    return _said(spark, sf_dir).select("conv_id", "turn", "role", prompt.alias("prompt"))


@query("x26_literals", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [source, 'x \"y\"'] WHEN 1 THEN [lang, 'k'] ELSE [] END AS names FROM documents")
def x26_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from Python literals: a list, a map's keys, and text that is none."""
    forms = F.array(F.concat(F.lit("['"), "source", F.lit("', 'x \"y\"']")), F.concat(F.lit("{'"), "lang", F.lit("': 1, 'k': [2]}")), F.lit("not [a literal"))
    return table(spark, sf_dir, "documents").select("doc_id", labels.literal_names(F.get(forms, (F.col("doc_id") % 3).cast("int"))).alias("names"))


@query("x30_hosts", f"""
WITH n AS (SELECT conv_id, role, sum({words_sql('text')}) AS n FROM conversations GROUP BY ALL), s AS (SELECT *, n / greatest(sum(n) OVER (PARTITION BY conv_id), 1)::DOUBLE AS share FROM n)
SELECT conv_id, role, round(share, 9) AS share, role <> 'assistant' AND share >= 0.3 AS host FROM s""")
def x30_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of words, and named speakers (all but the assistant) with three tenths of them."""
    said = _said(spark, sf_dir)
    named = said.where("role <> 'assistant'").select("conv_id", "role").distinct()
    return labels.host_coverage(said, "conv_id", "role", "text", named, 0.3).withColumn("share", F.round("share", 9))


@query("x32_excerpts", """
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), w AS (SELECT *, i <= 1 OR i > n - 1 AS shown FROM t),
s AS (SELECT *, bool_or(shown) OVER (PARTITION BY conv_id, role) AS seen, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS own FROM w)
SELECT conv_id, turn, role FROM s WHERE shown OR NOT seen AND own <= 1""")
def x32_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last turn of each conversation, and the first of roles that neither shows."""
    return labels.cited_window(_said(spark, sf_dir).select("conv_id", "turn", "role"), "conv_id", "turn", "role", 1, 1, 1)


@query("f10_applicable", "WITH q AS (SELECT 'q' || k::VARCHAR AS question, unnest(['src' || k::VARCHAR, 'src' || (k + 3)::VARCHAR, 'src' || k::VARCHAR]) AS source FROM range(6) t(k)) SELECT DISTINCT doc_id, question FROM documents JOIN q USING (source)")
def f10_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the questions whose list of sources names theirs."""
    bank = spark.range(6).select(F.concat(F.lit("q"), "id").alias("question"), F.array(F.concat(F.lit("src"), "id"), F.concat(F.lit("src"), F.col("id") + 3), F.concat(F.lit("src"), "id")).alias("dataset_allow_list"))
    return labels.applicable(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset")), bank).select("doc_id", "question")


@query("f11_open_jobs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f11_open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j7_same_questions", f"WITH {PAIRS_SQL} SELECT doc_id, gold AS answer, coalesce(answer, '') AS other FROM scored WHERE doc_id % 4 <> 0")
def j7_same_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two labellers to one wording; every fourth question was worded otherwise for the second."""
    p = pairs(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    one = p.select("doc_id", F.col("gold").alias("answer"), F.col("question").alias("text"), "description", "options")
    two = p.select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("question")).alias("text"), "description", "options")
    return labels.same_question_pairs(one, two, "doc_id")


@query("a27_first_seen", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS speakers FROM (SELECT conv_id, role, min((turn, role)) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def a27_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of each conversation in the order in which they first speak."""
    placed = turns.speakers_in_order(_said(spark, sf_dir), "conv_id", "turn", "role")
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("speakers"))


@query("a28_distributions", f"""
WITH r AS (SELECT role, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM conversations), s AS (SELECT role, 'ref' AS side, w FROM r UNION ALL SELECT role, 'hyp', list_concat(['um'], w[2:]) FROM r),
x AS (SELECT role, side, unnest(w) AS w FROM s), a AS (SELECT role, side, count(*) AS words, count(DISTINCT w) AS distinct_words, round_even(1000 * avg((w IN ('um', 'uh', 'er'))::INT), 3) AS fillers_per_1000 FROM x GROUP BY ALL)
SELECT a.role, a.side, a.words, a.distinct_words, a.fillers_per_1000, round_even(a.words / b.words::DOUBLE, 4) AS length_ratio FROM a JOIN a b ON b.role = a.role AND b.side = 'ref'""")
def a28_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, distinct words and fillers of turns, and of turns whose first word is a filler."""
    p = _said(spark, sf_dir).select("role", X.words("text").alias("ref"))
    return labels.distribution_table(p.withColumn("hyp", F.concat(F.array(F.lit("um")), F.slice("ref", F.lit(2), F.size("ref")))), ["role"], "ref", "hyp")


@query("a29_repeated_ids", "SELECT doc_id // 3 * 2 AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a29_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, derived by threes, that several documents have."""
    return splits.repeated_ids(table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 3) * 2).alias("id")), "id")


@query("t5_heads", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT *, 5 + sum({words_sql('line')} + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l)
SELECT doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY i) AS text FROM s WHERE upto <= 200 GROUP BY doc_id""")
def t5_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of every document that fit 200 tokens with a frame of five; words with a line end stand for tokens."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return labels.truncate_head(lines, "doc_id", "i", "line", F.lit(5), 200, X.word_count("line") + 1)


@query("t5_longest_heads", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, unnest(list_distinct(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> ''))) AS word FROM l), f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY doc_id, word),
n AS (SELECT doc_id, i, count(*) AS new FROM f GROUP BY doc_id, i), u AS (SELECT l.doc_id, l.i, sum(coalesce(new, 0)) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS upto FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.i = l.i)
SELECT doc_id, count(*) FILTER (upto <= 60)::INTEGER AS kept FROM u GROUP BY doc_id""")
def t5_longest_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many first lines of every document hold at most 60 distinct words: a count that does not add up over lines."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"), F.lit("").alias("frame"))
    return examples.longest_heads(rows, "lines", "frame", 60, lambda texts: [len(set(t.split())) for t in texts]).select("doc_id", "kept")


_IDS = "list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), lambda x: len(x) + 7)"


@query("p8_masked_positions", f"""
WITH d AS (SELECT doc_id, list_concat({_IDS}[1:200], [0, 0, 0]) AS ids FROM documents), r AS (SELECT doc_id, ids, len(ids) - 3 AS n FROM d),
m AS (SELECT doc_id, ids, list_transform(ids, lambda x, i: i > greatest(1, doc_id % 9) AND i <= n AND ('0x' || substr(sha1('3|' || doc_id::VARCHAR || '|' || (i - 1)::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2) AS mark FROM r)
SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN mark[i] THEN 4 ELSE x END::BIGINT) AS masked_ids, list_transform(ids, lambda x, i: CASE WHEN mark[i] THEN x ELSE -100 END::BIGINT) AS labels FROM m""")
def p8_masked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the places of windows of 200 tokens masked, prompts (of up to eight tokens) and three places of padding never."""
    ids = F.transform(X.words("text"), lambda w: F.length(w) + 7)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.slice(ids, 1, 200), F.array(F.lit(0), F.lit(0), F.lit(0))).alias("ids"))
    return examples.masked_positions(rows, ["doc_id"], "ids", F.size("ids") - 3, 0.2, 4, 3, F.col("doc_id") % 9).select("doc_id", "masked_ids", "labels")


@query("m5_first_examples", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def m5_first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example of each call and variant: a source and a language, the first by id."""
    return ranks.first_wins(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")])


@query("s13_release", "SELECT doc_id, 'train' AS split, 'm' || (doc_id % 3)::VARCHAR AS name FROM documents WHERE lang = 'en'")
def s13_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released records of a track (English) without billing fields."""
    info = F.struct(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("name"), F.lit(0.1).alias("cost"), F.lit("acc").alias("account"))
    out = files.export_release(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("track"), info.alias("generation_info")), "train", "en", ["cost", "account"])
    return out.select("doc_id", "split", "generation_info.*")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("s3_json_lines", "SELECT doc_id, text FROM documents")
def s3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as line-JSON and read back."""
    path = _folder(spark, "lines")
    d = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    d.write.text(path)
    return files.read_json_lines(spark, path, "doc_id long, text string")


@query("s5_wide_csv", "SELECT doc_id, text FROM documents WHERE text <> ''")
def s5_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV, line ends and quotes inside fields, and read back."""
    path = _folder(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "text").where("text <> ''").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_wide_csv(spark, path, "doc_id long, text string")


@query("s6_json_arrays", "SELECT conv_id, turn, role, text FROM conversations")
def s6_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one JSON array each file and read back."""
    path = _folder(spark, "arrays")
    rows = _said(spark, sf_dir).groupBy((F.col("conv_id") % 4).alias("part")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("value"))
    rows.repartition(4, "part").sortWithinPartitions("part").write.partitionBy("part").text(path)  # a file for each part
    return files.read_json_array(spark, f"{path}/part=*", "conv_id long, turn long, role string, text string")


@query("s9_ledger", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def s9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that a second run fills up: rows of the first stay."""
    path = _folder(spark, "ledger")
    d = table(spark, sf_dir, "documents").select("doc_id")
    files.append_new(path, d.where("doc_id % 2 = 0").withColumn("run", F.lit("first")), "doc_id")
    files.append_new(path, d.withColumn("run", F.lit("second")), "doc_id")
    return spark.read.parquet(path)


@query("s11_packed", f"WITH n AS (SELECT {words_sql('text')} + 1 AS n FROM documents) SELECT sum(n)::BIGINT AS tokens, count(*) AS documents FROM n")
def s11_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and end marks in the packed rows of all documents; a document's ids are one a word."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(X.words("text"), lambda w: F.length(w) + 7).alias("ids"))
    rows = files.pack_tokens(d, "ids", 0, 4096, ["doc_id"])
    ends = F.regexp_count(F.regexp_replace(F.hex("tokens"), "(.{8})", "$1 "), F.lit("00000000"))
    return rows.agg(F.sum("n_tokens").alias("tokens"), F.sum(ends).cast("long").alias("documents"))


_STREAM = f"""d AS (SELECT doc_id, source, unnest(range(CASE WHEN lang = 'en' THEN 2 ELSE 1 END)) + 1 AS copy, list_append({_IDS}, 0) AS ids FROM documents)"""


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(X.words("text"), lambda w: F.length(w) + 7).alias("ids"), F.when(F.col("lang") == "en", 2).otherwise(1).alias("repeat"))


@query("s11_blocks", f"""
WITH {_STREAM}, t AS (SELECT sha1('7|' || doc_id::VARCHAR || '|' || copy::VARCHAR) AS mark, doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM d),
n AS (SELECT t, row_number() OVER (ORDER BY mark, doc_id, i) - 1 AS pos FROM t)
SELECT pos // 4096 AS block, count(*)::INTEGER AS n_tokens, sha256(string_agg(printf('%02X000000', t), '' ORDER BY pos)) AS sha256 FROM n GROUP BY block""")
def s11_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of all documents (English ones twice) in blocks of exactly 4,096 tokens; a document's ids are one a word."""
    blocks = packing.token_blocks(_streamed(spark, sf_dir), "doc_id", "ids", "source", 0, 4096, 7, "repeat")
    return blocks.select("block", "n_tokens", F.sha2(F.hex("tokens"), 256).alias("sha256"))


@query("s11_totals", f"WITH {_STREAM} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS copies, sum(len(ids))::BIGINT AS tokens FROM d GROUP BY source")
def s11_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gives to that stream."""
    return packing.stream_totals(_streamed(spark, sf_dir), "doc_id", "ids", "source", "repeat")


@query("s12_frozen_split", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS side, text FROM documents")
def s12_frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sides written with a manifest, checked and read back."""
    path = _folder(spark, "frozen")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    frozen.freeze_split(path, {"train": d.where("doc_id % 10 <> 0"), "val": d.where("doc_id % 10 = 0")}, table(spark, sf_dir, "benchmark"), "plan-1")
    sides = frozen.frozen_split(spark, path, ["train", "val"], "plan-1")
    return sides["train"].withColumn("side", F.lit("train")).unionByName(sides["val"].withColumn("side", F.lit("val"))).select("doc_id", "side", "text")
