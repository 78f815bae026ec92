"""The registered corpus queries over the whole smallest tables: against DuckDB's rows, libraries and brute force."""

import hashlib
import html
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bytebpe, chunkprint, queries
from test_simhash import _brute as simhash_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def _rows(spark, name):
    return queries.queries()[name](spark, SF)


def _plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = _rows(spark, name)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in out.fetchall())


def test_op2(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs)
    assert sorted(map(tuple, _rows(spark, "op2_token_counts").collect())) == want


def test_op3(spark, docs):
    ranks = bytebpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, _rows(spark, "op3_byte_bpe").collect())) == sorted(want)


def test_op5(spark, docs):
    assert sorted(map(tuple, _rows(spark, "op5_simhash").collect()), key=str) == simhash_brute(docs, 2)


def test_op6(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = _rows(spark, "op6_language_id").collect()
    of_docs = [r for r in rows if r.page_id is None]
    assert len(of_docs) == len(lang) and sum(r.lang == lang[r.doc_id] for r in of_docs) / len(lang) > 0.97
    assert len(rows) - len(of_docs) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_op6_equals_a_plain_fusion(spark):
    """The whole query over documents and pages against the fusion in plain Python."""
    from test_langid import _plain as fused

    from millrace.llm import langid, styletree

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html", langid.declared_language("html").alias("said"), styletree.host_of(F.col("url")).alias("host")).collect()
    want = {("d", r.doc_id): x for r, x in zip(rows, fused([(r.text, r.lang, r.source) for r in rows], model))}
    want |= {("p", r.page_id): x for r, x in zip(pages, fused([(styletree.page_text(r.html or ""), (r.said or "").lower().split("-")[0] or None, r.host) for r in pages], model))}
    got = {("d", r.doc_id) if r.page_id is None else ("p", r.page_id): r for r in _rows(spark, "op6_language_id").collect()}
    assert got.keys() == want.keys()
    for k, (lang, posterior, text_lang, rejected) in want.items():
        assert (got[k].lang, got[k].text_lang, got[k].rejected) == (lang, text_lang, rejected) and abs(got[k].posterior - posterior) < 3e-6


def test_op7(spark, docs):
    order = sorted(docs, key=lambda d: -d[0])
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = (chunkprint.entries(t) for t in (text, new, after))
        want[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), chunkprint.as_text(a), chunkprint.as_text(b), chunkprint.likeness(a, b), chunkprint.likeness(a, c))
    assert {r.doc_id: tuple(r)[1:] for r in _rows(spark, "op7_chunk_fingerprints").collect()} == want


def test_op8(spark):
    got = {r.page_id: r.text for r in _rows(spark, "op8_main_text").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = r.html[r.html.find("<article>") : r.html.find("</article>")]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<br>|</?(?:p|h1|article)>", " ", re.sub(r"</?b>", "", body))).split())
