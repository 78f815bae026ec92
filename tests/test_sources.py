"""Readers, writers and the streaming ledger on small files."""

import json
import zipfile

import numpy as np
import pytest

from millrace.sources import files
from millrace.streaming import ledger


def test_json_lines_with_a_cut_end(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y"}\n{"id": 3, "t": "z')
    got = files.read_json_lines(spark, f"{tmp_path}/a.jsonl", "id int, t string")
    assert sorted((r.id, r.t) for r in got.collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t\n{"id": 3, "t": "z"}\n')
    with pytest.raises(Exception, match="a bad line"):
        files.read_json_lines(spark, f"{tmp_path}/b.jsonl", "id int, t string").collect()


def test_archives_tables_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("b.json", '{"x": 1}')
        z.writestr("a.json", '{"x": 2}')
        z.writestr("skip.txt", "no")
    assert [(r.member, json.loads(r.body)["x"]) for r in files.read_zipped_json(spark, f"{tmp_path}/c.zip").collect()] == [("a.json", 2), ("b.json", 1)]
    (tmp_path / "d.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,' + "y" * 200_000 + "\n")
    rows = files.read_wide_csv(spark, f"{tmp_path}/d.csv").collect()
    assert rows[0].text == 'two\nlines, "quoted"' and len(rows[1].text) == 200_000
    (tmp_path / "e.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_json_array(spark, f"{tmp_path}/e.json").collect()) == [1, 2]


def test_writers(spark, tmp_path):
    docs = spark.range(400).selectExpr("id", "concat('w ', id) AS text")
    sides = {r.split: r.docs for r in files.write_split(docs, "id", f"{tmp_path}/split", 0.1).collect()}
    assert sum(sides.values()) == 400 and 15 < sides["val"] < 70
    path = f"{tmp_path}/ledger"
    assert files.append_new(path, docs.where("id < 10").union(docs.where("id < 3")), "id") == 10
    assert files.append_new(path, docs.where("id < 15"), "id") == 5 and spark.read.parquet(path).count() == 15
    files.replace_table(docs, f"{tmp_path}/t")
    files.replace_table(docs.where("id < 7"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7
    assert files.content_digest(docs, ["id"]) == files.content_digest(docs.repartition(7), ["id"]) != files.content_digest(docs.where("id > 0"), ["id"])


def test_published_versions(spark, tmp_path):
    path = f"{tmp_path}/p"
    with pytest.raises(ValueError, match="no table"):
        files.published(spark, path)
    assert files.publish_table(spark.range(5), path) == 1 and files.publish_table(spark.range(7), path) == 2
    (tmp_path / "p" / "v00000003").mkdir()  # a writer that did not end
    assert files.published(spark, path).count() == 7 and files.publish_table(spark.range(2), path) == 3


def test_digests_of_templates_and_vocabularies(spark):
    one = files.template_digest({"a": "x", "b": "yz"})
    assert one == files.template_digest({"b": "yz", "a": "x"}) != files.template_digest({"a": "xy", "b": "z"})
    v = spark.createDataFrame([("the", 1), ("a", 2)], "token string, id int")
    assert files.vocabulary_digest(v, "token", "id") == files.vocabulary_digest(v.orderBy("token").repartition(3), "token", "id") != files.vocabulary_digest(v.where("id = 1"), "token", "id")


def test_export_and_packing(spark):
    r = spark.createDataFrame([("p", ("n", 0.1, "acc")), ("nc", ("m", 0.2, "acc"))], "track string, generation_info struct<name:string,cost:double,account:string>")
    out = files.export_release(r, "train", "p", ["cost", "account"]).collect()
    assert len(out) == 1 and out[0].split == "train" and out[0].generation_info.asDict() == {"name": "n"}
    docs = spark.createDataFrame([(i, list(range(i))) for i in range(8)], "id int, ids array<int>")
    rows = files.pack_tokens(docs, "ids", 99, 10, ["id"]).collect()
    got = np.concatenate([np.frombuffer(r.tokens, "<u4") for r in sorted(rows, key=lambda r: r.n_tokens)])
    assert sum(r.n_tokens for r in rows) == sum(range(8)) + 8 and (got == 99).sum() == 8 and max(r.n_tokens for r in rows) <= 10


def test_stream_to_ledger(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/ledger"
    spark.range(5).selectExpr("id", "'a' AS t").write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, t string").parquet(source)
    ledger.stream_to_ledger(stream(), "id", path, f"{tmp_path}/ck").awaitTermination()
    spark.range(3, 9).selectExpr("id", "'b' AS t").write.mode("append").parquet(source)
    ledger.stream_to_ledger(stream(), "id", path, f"{tmp_path}/ck").awaitTermination()
    assert sorted((r.id, r.t) for r in spark.read.parquet(path).collect()) == [(i, "a" if i < 5 else "b") for i in range(9)]


def test_windowed_reasons(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' + make_interval(0, 0, 0, 0, 0, id) AS ts, IF(id % 2 = 0, 'x', 'y') AS reason FROM range(6)").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, reason string").parquet(f"{tmp_path}/in")
    q = ledger.reason_counts(s, "ts", "1 hour", "1 hour", "reason").writeStream.format("memory").queryName("reasons").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("reasons").collect()) == 6
