"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from millrace.llm import bytebpe, chunkprint, langid, lexical, lmscore, mixing, perspective, resample, shards, simhash, styletree, tokencount, topk
from millrace.llm.shared import read_table, scratch_path, small_batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(f):
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(small_batches(spark), sf_dir)
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query
def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's view of every conversation; spans as start-end, joined by commas."""
    views = perspective.perspectives(read_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return views.withColumn("spans", spans)


_SQL["op1_perspectives"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), x AS (
  SELECT t.conv_id, p.speaker, floor(t.turn / 256)::BIGINT AS part, t.turn, t.role, t.text,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
         ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), y AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS stop FROM x
)
SELECT conv_id, speaker, part, 0::BIGINT AS slot, count(*)::INTEGER AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(body))::VARCHAR || '-' || stop::VARCHAR END, ',' ORDER BY turn, role, text), '') AS spans
FROM y GROUP BY conv_id, speaker, part
"""


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; the cache starts empty, so that each run encodes every distinct text."""
    docs = read_table(spark, sf_dir, "documents")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), tokencount.fresh_cache(docs))


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


ARRIVALS = 4


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after four arrivals (by ranges of ids) and a compaction after every second.

    The shards are read back from the files that the last manifest names.
    """
    docs = read_table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    edges = [low + -(-i * (high - low + 1) // ARRIVALS) for i in range(ARRIVALS + 1)]
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    store = shards.ShardStore(spark, scratch_path(spark, "shards"))
    for i in range(ARRIVALS):
        arrived = F.col("doc_id").between(edges[i], edges[i + 1] - 1)  # the scan can skip row groups
        store.append(docs.where(arrived if i else arrived | F.col("doc_id").isNull()), key, label=f"a{i}")
        if i % 2:
            store.compact(label=f"m{i // 2}")
            store.vacuum()
    return store.read().select("doc_id", "millrace_shard.shard", F.col("millrace_shard.n_docs").alias("shard_docs"), F.col("millrace_shard.n_bytes").alias("shard_bytes"))


def _merge_sql(name: str, given: str, label: str) -> str:
    return f"""
{name}_runs AS (SELECT shard, sum(n_bytes)::BIGINT AS b FROM {given} GROUP BY shard),
{name}_tiers AS (SELECT *, (length(bin(b)) + 1) // 2 AS tier FROM {name}_runs WHERE b < {shards.TARGET * shards.NEAR}),
{name}_groups AS (SELECT *, floor((sum(b) OVER (PARTITION BY tier ORDER BY shard ROWS UNBOUNDED PRECEDING) - b)::BIGINT // {shards.TARGET})::BIGINT AS grp FROM {name}_tiers),
{name}_plan AS (SELECT shard, '{label}-t' || lpad(tier::VARCHAR, 2, '0') || 'g' || lpad(grp::VARCHAR, 8, '0') AS merged
  FROM {name}_groups QUALIFY count(*) OVER (PARTITION BY tier, grp) >= {shards.FAN_IN}),
{name} AS (SELECT doc_id, n_bytes, arrival, coalesce(merged, shard) AS shard FROM {given} LEFT JOIN {name}_plan USING (shard))"""


_SQL["op4_sharding"] = f"""
WITH r AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS n_bytes,
    floor((coalesce(doc_id, low) - low) * {ARRIVALS} // (high - low + 1))::BIGINT AS arrival,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key
  FROM documents, r
), s AS (
  SELECT doc_id, n_bytes, arrival,
    'a' || arrival::VARCHAR || '-s' || lpad((key % ((sum(n_bytes) OVER (PARTITION BY arrival) + {shards.SMALL - 1})::BIGINT // {shards.SMALL}))::VARCHAR, 8, '0') AS shard
  FROM d
), early AS (SELECT * FROM s WHERE arrival < 2),{_merge_sql("first", "early", "m0")},
later AS (SELECT * FROM first UNION ALL SELECT * FROM s WHERE arrival >= 2),{_merge_sql("second", "later", "m1")}
SELECT doc_id, shard, count(*) OVER (PARTITION BY shard) AS shard_docs, sum(n_bytes) OVER (PARTITION BY shard)::BIGINT AS shard_bytes FROM second
"""


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``simhash.simhash_components``."""
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page (main text, html language, address and host) and of every document.

    A document declares its ``lang`` and its ``source`` stands for the host; rows carry doc_id or page_id.
    The model is fitted on at most ``langid.SAMPLE`` distinct texts of each label of ``documents``.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = langid.fit(docs)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html", langid.declared_language("html").alias("declared"))
    none = F.lit(None).cast("long")
    of_pages = langid.identify(pages, model, "html", F.col("declared"), styletree.host_of(F.col("url")), styletree.page_text, keep=["page_id", "declared"])
    of_docs = langid.identify(docs, model, "text", F.col("lang"), F.col("source"), keep=["doc_id", "lang"])
    return of_docs.select("doc_id", none.alias("page_id"), "found.*", F.col("lang").alias("declared")).unionByName(
        of_pages.select(none.alias("doc_id"), "page_id", "found.*", "declared")
    )


@_query
def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return chunkprint.compare_with_edits(read_table(spark, sf_dir, "documents"))


@_query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return styletree.main_text(read_table(spark, sf_dir, "pages"))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn when tokens are raked to tempered targets of source, language and topic.

    ``documents`` has no topic; the form of a text stands for it (``mixing.form_topic``).
    """
    docs = read_table(spark, sf_dir, "documents")
    tokens = mixing.word_count(F.col("text"))
    drawn = mixing.mix(docs, F.col("source"), F.col("lang"), mixing.form_topic(F.col("text"), tokens), tokens)
    return drawn.select("doc_id", "mix.source", F.col("mix.language").alias("lang"), "mix.topic", "mix.n_tokens", F.round("mix.probability", 6).alias("probability"))


_SQL["op9_mixing"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n,
    length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS lines
  FROM documents
), t AS (
  SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN lines * 12 >= n THEN 'list' WHEN n < 120 THEN 'note' WHEN n < 600 THEN 'article' ELSE 'long' END AS topic FROM d
), cells AS (
  SELECT source, lang, topic, sum(n)::DOUBLE AS w FROM t GROUP BY ALL HAVING sum(n) > 0
), targets AS (
  SELECT *, s / (SELECT sum(v) FROM (SELECT sum(w) ^ {mixing.POWER} AS v FROM cells GROUP BY source)) AS ts,
    l / (SELECT sum(v) FROM (SELECT sum(w) ^ {mixing.POWER} AS v FROM cells GROUP BY lang)) AS tl,
    o / (SELECT sum(v) FROM (SELECT sum(w) ^ {mixing.POWER} AS v FROM cells GROUP BY topic)) AS tt
  FROM (SELECT *, (sum(w) OVER (PARTITION BY source)) ^ {mixing.POWER} AS s, (sum(w) OVER (PARTITION BY lang)) ^ {mixing.POWER} AS l, (sum(w) OVER (PARTITION BY topic)) ^ {mixing.POWER} AS o FROM cells)
), raked AS (
  SELECT source, lang, topic, w, ts, tl, tt, w AS f, 0 AS round FROM targets
  UNION ALL
  SELECT source, lang, topic, w, ts, tl, tt, f * tt / sum(f) OVER (PARTITION BY topic) AS f, round + 1 FROM (
    SELECT * REPLACE (f * tl / sum(f) OVER (PARTITION BY lang) AS f) FROM (
      SELECT * REPLACE (f * ts / sum(f) OVER (PARTITION BY source) AS f) FROM raked WHERE round < {mixing.ROUNDS}))
), chances AS (
  SELECT source, lang, topic, (f / w) / max(f / w) OVER () AS p FROM raked WHERE round = {mixing.ROUNDS}
)
SELECT doc_id, source, lang, topic, n AS n_tokens, round(p, 6) AS probability
FROM t JOIN chances USING (source, lang, topic)
WHERE n > 0 AND ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT::DOUBLE / {1 << 48} < p
"""


@_query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector over all others."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


_SQL["op10_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and score of every document, and the ranks of those drawn towards ``benchmark``.

    DuckDB's SQL has no crc32, so the query is held against a brute-force version.
    """
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole document by word frequencies and by the attention model."""
    return lmscore.score(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_SQL["op13_ranked_search"] = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents
), g AS (
  SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
), i AS (
  SELECT item_id, row_number() OVER () AS q, {_TERMS} AS ts FROM benchmark
), a AS (
  SELECT q, item_id, term, count(*) AS repeats FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY ALL
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM a) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs
), s AS (
  SELECT q, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM a JOIN p USING (term) JOIN f USING (term), g GROUP BY ALL
), t AS (
  SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 20
"""
