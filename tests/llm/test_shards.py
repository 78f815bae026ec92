"""The shard store: whole contents in every version, tiers, atomic commits."""

import pytest

from millrace.llm import shards


def _rows(spark, a, b, width=40):
    return spark.createDataFrame([(i, "x" * (i % width), "s", i) for i in range(a, b)], "doc_id long, text string, shard string, version int")


def _store(spark, path, **more):
    return shards.ShardStore(spark, f"file://{path}", **({"small": 500, "target": 3000} | more))


def test_arrivals_merges_and_versions(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.version() == 0 and store.manifest().count() == 0 and store.compact() == 0 and store.vacuum() == 0
    assert store.append(_rows(spark, 0, 100)) == 1
    assert store.append(_rows(spark, 100, 130)) == 2
    before = {r.shard: r.n_bytes for r in store.manifest().collect()}
    assert len(before) > 5
    assert store.compact() == 3
    after = store.manifest().collect()
    assert len(after) < len(before) and sum(r.n_docs for r in after) == 130 and sum(r.n_bytes for r in after) == sum(before.values())
    assert max(r.n_bytes for r in after) < 3000 + max(before.values())
    for v in (1, 2, 3):  # older versions stay readable until a vacuum
        got = store.read(v)
        assert sorted((r.doc_id, r.text, r.shard, r.version) for r in got.collect()) == sorted(tuple(r) for r in _rows(spark, 0, 100 if v == 1 else 130).collect())
    assert store.vacuum() >= len(before) - len(after)
    got = store.read()
    assert got.count() == 130 and got.columns == ["doc_id", "text", "shard", "version", "millrace_shard"]
    for r in got.groupBy("millrace_shard").count().collect():
        assert r.millrace_shard.n_docs == r["count"]
    again = _store(spark, tmp_path)
    assert again.version() == 3 and again.read().count() == 130
    assert again.append(_rows(spark, 0, 0)) == 3


def test_plan_keeps_tiers_apart(spark, tmp_path):
    store = _store(spark, tmp_path, target=1 << 20)
    sizes = {"a": 1000, "b": 1020, "c": 300, "d": 260, "e": 900, "f": 1 << 21}
    df = spark.createDataFrame([("r", s, 1, n, 1) for s, n in sizes.items()], shards._MANIFEST)
    got = {}
    for r in store.plan(df).collect():
        got.setdefault(r.merged, set()).add(r.shard)
    tiers = {}
    for s, n in sizes.items():
        if n < 1 << 20:
            tiers.setdefault((n.bit_length() + 1) // 2, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in tiers.values() if len(v) > 1)


def test_of_two_writers_one_loses(spark, tmp_path):
    one, two = _store(spark, tmp_path), _store(spark, tmp_path)
    one.append(_rows(spark, 0, 20))
    two.version = lambda: 0  # it has not seen the first commit
    with pytest.raises(Exception, match="exist"):
        two.append(_rows(spark, 50, 60))
    assert one.version() == 1 and sorted(r.doc_id for r in one.read().collect()) == list(range(20))


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "y" * 100_000)], "doc_id long, text string")
    store = _store(spark, tmp_path)
    store.append(df)
    store.compact()
    assert sorted(map(str, store.read().select("doc_id", "text").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="own columns"):
        store.append(df.withColumnRenamed("doc_id", "millrace_run"))
