"""The pipeline's stages, one after the other, and what each decides."""

import hashlib

import numpy as np
import tiktoken
import xxhash

import corpus_pipeline
from millrace.llm import bytebpe, neardup, simhash


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "汉字汉字汉字汉字", "en", "src0", 8)], docs.schema)
    first = docs.limit(1).selectExpr("doc_id + 2000000 AS doc_id", "text", "lang", "source", "n_chars")
    given = docs.unionByName(extra).unionByName(first)
    kept = given
    counts = [given.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        counts.append(kept.count())
    at = dict(zip([n for n, _ in corpus_pipeline.STAGES], counts[1:]))
    assert at["language_id"] == counts[0] - 2  # the two that are no language's
    assert at["simhash_dedup"] < at["language_id"] and at["mixing"] < at["simhash_dedup"] and at["byte_bpe"] == at["mixing"]
    texts = {r.doc_id: r.text for r in given.collect()}
    vocabulary = open(corpus_pipeline.VOCABULARY, "rb").read()
    enc = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(vocabulary), special_tokens={})
    for r in kept.collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == kept.columns and run.count() > 0


def test_odd_documents(spark, tmp_path):
    """An empty table, nulls in every column, a very long text, repeated rows and columns with the stages' own names."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where("doc_id = 3").selectExpr("900001L AS doc_id", "repeat(concat(text, ' '), 300) AS text", "lang", "source", "n_chars")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema)
    given = docs.limit(60).unionByName(long).unionByName(nulls).unionByName(docs.limit(3)).selectExpr("*", "1 AS fp", "'x' AS mix", "2 AS ids", "'y' AS host")
    for start in (docs.where("false"), given):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, sf)
            path = f"{tmp_path}/{name}-{start is given}"
            out.write.parquet(path)
            kept = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == start.columns
        assert (kept.count() > 20) == (start is given)
    assert kept.where("n_tokens = 0").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_through_once_in_a_stage(spark):
    """A filter on what was found in a text neither scores it nor counts its words again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert _plan(corpus_pipeline.language(spark, docs, "")).count("ArrowEvalPython") == 1
    assert _plan(corpus_pipeline.mixing_stage(spark, docs, "")).count("regexp_extract_all") == 1


def test_buckets_stay_in_as_many_tasks_as_a_shuffle_has(spark):
    """Little data that is much work: adaptive plans would join all of it into one task."""
    keyed = spark.range(64).selectExpr("id AS fp", "0 AS block", "id div 2 AS value")
    links = simhash.linked(keyed, 16)
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(i, i + 1) for i in range(0, 64, 2)]


def test_shingles_equal_joined_words():
    """Hashes of slices are those of the words joined by a space; bands are least hashes, in pieces too."""
    for text in (b"", b"  ", b"One", b"a b  c\td", b" a b c d e ", b"w " * 40 + b"x y z w v u", "é ü 日 ß a b".encode(), b" ".join(b"%d" % i for i in range(70_000))):
        words = text.lower().split()
        want = sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), simhash.SEED) for i in range(max(1, len(words) - 4)) if words})
        got = neardup.shingles(text)
        assert got.tolist() == want
        if want:
            least = np.array([((got ^ x) * t).min() for x, t in zip(neardup._XOR, neardup._TIMES)], np.uint64).reshape(neardup.BANDS, neardup.ROWS)
            assert neardup.bands(got) == [xxhash.xxh64_intdigest(r.tobytes(), simhash.SEED) - (1 << 63) for r in least]
