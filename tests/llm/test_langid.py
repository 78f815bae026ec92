"""Language identification: held-out accuracy, the fusion against a plain computation, odd inputs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, styletree


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")


def test_held_out_accuracy(docs):
    model = langid.fit(docs.where("doc_id % 3 = 0"), sample=200)
    assert model.languages == ["de", "en", "es", "fr"]
    found = langid.identify(docs.where("doc_id % 3 = 1"), model, "text")
    right, n, gone = found.agg(F.count_if(F.col("lang") == F.col("found.lang")), F.count("*"), F.count_if("found.rejected")).first()
    assert right / n > 0.97 and gone / n < 0.01


def test_copies_and_rare_languages_in_the_sample(spark, docs):
    """Copies of a text fill no sample, and a language with three texts among thousands is learnt from them."""
    french = [r.doc_id for r in docs.where("lang = 'fr' and length(text) > 800").orderBy("doc_id").limit(3).collect()]
    few = docs.where(F.col("lang").isin("en", "de") | F.col("doc_id").isin(french))
    hot = few.where("lang = 'en'").orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(3000)).select((F.col("id") + 10**7).alias("doc_id"), "text", "lang", "source")
    model = langid.fit(few.unionByName(hot), sample=100)
    assert model.languages == ["de", "en", "fr"]
    plain = langid.fit(few, sample=100)
    assert (plain.logs == model.logs).all() and (plain.known == model.known).all()
    found = {r.doc_id: r.found for r in langid.identify(few, model, "text", F.col("lang")).where(F.col("doc_id").isin(french)).collect()}
    assert all(f.lang == "fr" and not f.rejected for f in found.values())


def _plain(rows, model):
    """The fusion in plain Python: rows of (text, declared, host)."""
    size = len(model.languages)
    scored = []
    for text, said, host in rows:
        logs, n, known = model.score(text or "")
        own = logs.index(max(logs)) if n and known >= 0.3 * n else None
        scored.append((logs, n, own, (said or "").strip().lower() or None, (host or "").strip().lower() or None))
    total = Counter(s[2] for s in scored)
    base = [(total[i] + 1) / (sum(total[j] for j in range(size)) + size) for i in range(size)]
    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else None
    domain = lambda h: ".".join(h.split(".")[-2:])
    count = lambda key, v: Counter(s[2] for s in scored if s[4] and key(s[4]) == v)
    norm = lambda a: [x / sum(a) for x in a]
    out = []
    for logs, n, own, said, host in scored:
        prior = base
        if host:
            lean = [16.0 * (langid._SUFFIX.get(suffix(host)) == x) + 8 * b for x, b in zip(model.languages, base)]
            a, b, c = count(suffix, suffix(host)), count(domain, domain(host)), count(lambda h: h, host)
            p_s = norm([a[i] + lean[i] for i in range(size)])
            p_d = norm([b[i] + 8 * p_s[i] for i in range(size)])
            prior = [max(c[i] + 8 * p_d[i] - (own == i), 1e-6) for i in range(size)]
        sums = [x * min(1, 60 / max(n, 1)) / 1024 + math.log(p) for x, p in zip(logs, prior)]
        if said:
            told = [s for s in scored if s[3]]
            n_said = Counter(s[2] for s in told)
            same = Counter(s[2] for s in told if s[3] == said)
            rate = (sum(same[i] for i in range(size)) + 1) / (sum(n_said[i] for i in range(size)) + 1)
            sums = [x + math.log((same[i] + 4 * rate) / (n_said[i] + 4)) for i, x in enumerate(sums)]
        top = max(sums)
        p = 1 / sum(math.exp(x - top) for x in sums)
        rejected = own is None or p < 0.5
        out.append(("und" if rejected else model.languages[sums.index(top)], round(p, 6), None if own is None else model.languages[own], rejected))
    return out


def test_fusion_equals_a_plain_computation(spark, docs):
    model = langid.fit(docs, sample=150)
    texts = [r.text for r in docs.where("length(text) < 700").limit(40).collect()]
    rows = [(t[: 5 + 7 * i], (None, "DE", "en-GB ", "", "xx")[i % 5], ("a.site.de", "b.site.de", "x.com", "plain", None, " ")[i % 6]) for i, t in enumerate(texts)]
    rows += [(None, "de", "a.site.de"), ("", None, None), ("汉字汉字汉字", "en", "x.com"), ("der", None, "a.site.de")] * 2
    plain = [(t, (s or "").strip().lower().split("-")[0] if s else s, h) for t, s, h in rows]
    df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "id int, text string, said string, host string, weight int, e int")
    got = langid.identify(df, model, "text", F.col("said"), F.col("host")).orderBy("id")
    assert got.columns == [*df.columns, "found"]
    for g, w in zip(got.collect(), _plain(plain, model), strict=True):
        assert (g.found.lang, g.found.text_lang, g.found.rejected) == (w[0], w[2], w[3])
        assert g.found.posterior == pytest.approx(w[1], abs=2e-6)


def test_no_model_and_no_rows(spark, docs):
    none = langid.fit(docs.where("false"))
    assert none.languages == []
    assert {r.found.lang for r in langid.identify(docs.limit(3), none, "text").collect()} == {"und"}
    model = langid.fit(docs, sample=50)
    assert langid.identify(docs.where("false"), model, "text", F.col("lang"), F.col("source")).count() == 0
    with pytest.raises(ValueError, match="column named"):
        langid.identify(docs, model, "text", taken="lang")


def test_pages(spark):
    page = "<html {}><nav>und die der</nav><article>{}</article>"
    df = spark.createDataFrame([(1, page.format('lang="EN"', "the and")), (2, page.format("", "x")), (3, None)], "page_id int, html string")
    assert [r[0] for r in df.select(langid.declared_language("html")).collect()] == ["EN", None, None]
    assert styletree.page_text(page.format("", "only &amp; this")) == "only & this"


def test_a_very_long_text(spark, docs):
    model = langid.fit(docs, sample=100)
    body = docs.where("lang = 'de' and length(text) > 1000").orderBy("doc_id").first().text
    df = spark.createDataFrame([(1, body * 2000), (2, body)], "id int, text string")
    got = langid.identify(df, model, "text", keep=["id"]).orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "found"} and [r.found.lang for r in got] == ["de", "de"]


def test_accuracy_by_text_alone(spark, docs):
    """What the text says by itself, fitted on other documents: the declaration is no evidence here."""
    model = langid.fit(docs.where("doc_id % 2 = 0"), sample=200)
    found = langid.identify(docs.where("doc_id % 2 = 1"), model, "text", keep=["doc_id", "lang"])
    right, n = found.agg(F.count_if(F.col("lang") == F.col("found.text_lang")), F.count("*")).first()
    print(f"text alone: {right} of {n}")
    assert right / n > 0.97
