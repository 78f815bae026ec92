"""Token counts against sentencepiece, byte-level BPE against tiktoken and a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from millrace.llm import bytebpe, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  a", "a▁b a b", "▁", "don't WE'LL 's", " 　x　 ", "\x1c\x1d a\x85b", "日本語テキスト", "👩‍👩‍👧é́", "a" * 700, " " * 600, "<s> </s> <|endoftext|>", "ab" * 400 + "  xy\r\n\r\n", "$$$%%%" * 80, "\x00q"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab 'stré\n1! 日") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(1, "twice"), (1, "twice"), (1, "other")] + [(900 + i, "copied many times") for i in range(50)]


def test_counts_equal_the_library(spark, rows, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, digest string, n_tokens int")
    want = sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 20) for i, t in rows), key=str)
    for _ in range(2):  # the second run takes all counts from the cache
        got = tokencount.count_tokens(df, MODEL, str(tmp_path), limit=20)
        assert sorted(map(tuple, got.collect()), key=str) == want
        cached = spark.read.parquet(str(tmp_path))
        assert cached.count() == len({(t or "").replace("▁", " ") for _, t in rows})
    more = spark.createDataFrame([(1, "new words"), (2, "twice")], "doc_id long, text string")
    assert tokencount.count_tokens(more, MODEL, str(tmp_path)).count() == 2
    assert spark.read.parquet(str(tmp_path)).count() == cached.count() + 1
    assert tokencount.count_tokens(more.where("false"), MODEL, str(tmp_path / "e")).count() == 0


def test_stored_counts_are_used(spark, tmp_path):
    version = tokencount.tokenizer_version(open(MODEL, "rb").read())
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    df.select(tokencount.content_digest("text").alias("digest")).selectExpr("digest", "77L AS n_tokens").write.parquet(f"{tmp_path}/version={version}")
    assert tokencount.count_tokens(df, MODEL, str(tmp_path)).first().n_tokens == 77


def _tiktoken():
    ranks = bytebpe.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_comes_back(spark, rows):
    enc = _tiktoken()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, ids string, c0 int")
    got = bytebpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "text", "ids_in", "c0", "n_tokens", "ids"]
    back = bytebpe.decode(got, RANKS, public_tokenizers.PATTERN)
    out = back.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = bytebpe.encode(df.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, ids=False, digests=True)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, digests.collect()), key=str) == sorted(want, key=str)
    assert bytebpe.encode(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_and_forgetting(monkeypatch):
    enc = _tiktoken()
    rng = random.Random(2)
    tool = bytebpe.Codec(bytebpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    monkeypatch.setattr(bytebpe, "_REMEMBER", 5)
    monkeypatch.setattr(bytebpe, "_WORDS", 7)
    for _ in range(3):
        texts = ["".join(rng.choice(abc) for _ in range(n)) for abc, n in (("aab", 900), ("abcdefgh", 700), ("a", 1500), ("xy z", 200))]
        assert [x.tolist() for x in tool.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_words_of_any_length():
    """Seams between the pieces of long words: random, periodic, unspaced and mixed with short words."""
    enc = _tiktoken()
    rng = random.Random(4)
    tool = bytebpe.Codec(bytebpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    letters = lambda n, abc="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(abc) for _ in range(n))
    texts = [letters(100_000), " ".join(letters(rng.choice([5, 40, 300, 700])) for _ in range(1000)), "abc" * 9000, "tions" * 5001, "=-" * 9001, letters(20_000, ["the", "ation", "xq"])]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), *[letters(n, "aab") for n in range(55, 200)], *[letters(n, "ab") for n in (63, 64, 65, 127, 128, 129)]]
    assert [x.tolist() for x in tool.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_ids_outside_the_vocabulary_end_the_job(spark):
    df = spark.createDataFrame([([60_000],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytebpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()
