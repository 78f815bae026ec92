"""Packed blocks, frozen splits, masked places and longest heads on odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import examples
from millrace.sources import frozen, packing


def test_blocks_are_the_stream_whatever_the_partitions(spark):
    rows = [(i, "s" if i % 3 else None, list(range(i % 11)) if i % 7 else None, i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows + [(5, "s", [70000, 4294967295], 1)], "id int, src string, ids array<long>, times int").withColumn("part", F.lit(0))
    want = []
    order = sorted((hashlib.sha1(f"7|{i}|{c}".encode()).hexdigest(), i, ids or []) for i, _, ids, n in rows + [(5, "s", [70000, 4294967295], 1)] for c in range(1, n + 1))
    for _, _, ids in order:
        want += [*ids, 99]
    out = []
    for n in (1, 7):
        got = sorted(packing.token_blocks(docs.repartition(n), "id", "ids", "src", 99, 16, 7, "times").collect())
        assert [r.n_tokens for r in got[:-1]] == [16] * (len(got) - 1) and [r.block for r in got] == list(range(len(got)))
        out.append(b"".join(bytes(r.tokens) for r in got))
    assert out[0] == out[1] and np.frombuffer(out[0], "<u4").tolist() == want
    totals = {r.src: (r.copies, r.tokens) for r in packing.stream_totals(docs, "id", "ids", "src", "times").collect()}
    assert sum(t for _, t in totals.values()) == len(want) and sum(c for c, _ in totals.values()) == len(order)
    assert packing.token_blocks(docs.where("false"), "id", "ids", "src", 99, 16, 7).count() == 0


def test_a_stale_or_changed_split_is_refused(spark, tmp_path):
    path = f"{tmp_path}/split"
    train, val, bank = spark.range(20), spark.range(20, 25), spark.createDataFrame([("q1", None)], "q string, x int")
    with pytest.raises(ValueError, match="no manifest"):
        frozen.frozen_split(spark, path, ["train", "val"], "p1")
    frozen.freeze_split(path, {"train": train, "val": val}, bank, "p1")
    assert frozen.frozen_split(spark, path, ["train", "val"], "p1")["train"].count() == 20
    with pytest.raises(ValueError, match="another plan"):
        frozen.frozen_split(spark, path, ["train", "val"], "p2")
    with pytest.raises(ValueError, match="not \\['bank', 'train'"):
        frozen.frozen_split(spark, path, ["train"], "p1")
    train.repartition(3).write.mode("overwrite").parquet(f"{path}/train")  # the same rows
    assert frozen.frozen_split(spark, path, ["train", "val"], "p1")["val"].count() == 5
    for name, changed in [("val", spark.range(21, 26)), ("bank", bank.union(bank))]:
        frozen.freeze_split(path, {"train": train, "val": val}, bank, "p1")
        changed.write.mode("overwrite").parquet(f"{path}/{name}")
        with pytest.raises(ValueError, match=f"{name} is not what"):
            frozen.frozen_split(spark, path, ["train", "val"], "p1")


def test_masks_keep_off_prompt_and_padding(spark):
    rows = spark.createDataFrame([(1, list(range(10, 210)), 150), (2, [7], 1), (3, None, 0), (4, [], 0)], "id int, ids array<int>, n int").withColumn("_row", F.lit("x"))
    got = {r.id: r for r in examples.masked_positions(rows, ["id"], "ids", F.col("n"), 0.5, -1, 9, F.lit(20)).collect()}
    hit = [i for i, x in enumerate(got[1].masked_ids) if x == -1]
    assert all(20 <= i < 150 for i in hit) and 45 <= len(hit) <= 85
    assert got[1].labels == [10 + i if i in hit else -100 for i in range(200)]
    assert got[2].masked_ids == [7] and got[3].masked_ids is None and got[4].labels == [] and got[1]["_row"] == "x"
    none = examples.masked_positions(rows, ["id"], "ids", F.col("n"), 1.0, -1, 9).where("id = 1").first()
    assert none.masked_ids[0] == 10 and none.masked_ids[1:150] == [-1] * 149


def test_heads_by_few_counts(spark):
    rows = spark.createDataFrame([(1, ["a b", "a", "c d", "e"], "x"), (2, ["a b c d e f"], None), (3, None, "x"), (4, ["a", None, "b"], ""), (5, [], "")], "id int, lines array<string>, frame string")
    got = {r.id: r.kept for r in examples.longest_heads(rows, "lines", "frame", 3, lambda ts: [len(set(t.replace("x", "x ").split())) for t in ts]).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 2, 5: 0}
    long = spark.createDataFrame([(1, ["w"] * 1000, "")], "id int, lines array<string>, frame string")

    def count(texts):
        if len(count.seen) + len(texts) > 12:  # in one worker: the whole text and some ten halvings
            raise ValueError("counted too often")
        count.seen.extend(texts)
        return [len(t) for t in texts]

    count.seen = []
    assert examples.longest_heads(long, "lines", "frame", 801, count).first().kept == 401
